"""Messages about a run and where they go.  Sending is opt-in and happens on the driver."""

from __future__ import annotations

import json
import logging
import os
import socket
import urllib.error
import urllib.request
from dataclasses import dataclass

TIMEOUT_S = 10


@dataclass
class Stats:
    bytes_saved: int = 0
    files_deduped: int = 0
    already_deduped: int = 0
    errors: int = 0


def size_text(b: int) -> str:
    """The same text as functions.scalars.format_size."""
    for k, unit in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")):
        if b >= 1024**k:
            return f"{b / 1024**k:.1f} {unit}"
    return f"{b} B"


def host_id() -> str:
    return os.environ.get("SIEVELAKE_HOST_ID") or socket.gethostname() or "unknown"


def update_text(stats: Stats, root: str, seconds: float, dry_run: bool = False, host: str | None = None) -> str:
    head = f"{'[dry-run] ' if dry_run else ''}{host or host_id()}: {root}"
    if stats.files_deduped == 0 and stats.errors == 0:
        return f"{head}: No changes ({seconds:.3f}s)"
    rows = [("Deduplicated", f"{stats.files_deduped:,}"), ("Saved", size_text(stats.bytes_saved)), ("Already shared", f"{stats.already_deduped:,}"), ("Errors", f"{stats.errors:,}"), ("Time", f"{seconds:.3f}s")]
    return "\n".join([head, "", "| | |", "|-|-|", *(f"| {a} | {b} |" for a, b in rows)])


def alert_text(stats: Stats, root: str, host: str | None = None) -> str | None:
    return f"{host or host_id()}: {root}: {stats.errors:,} errors need investigation" if stats.errors else None


def send(url: str, text: str) -> None:
    """Posts {"text": …}; an answer of 300 or more is an error."""
    request = urllib.request.Request(url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
        if answer.status >= 300:
            raise OSError(f"status {answer.status}")


def ping(url: str) -> None:
    """Tells a health check; failures are only logged."""
    try:
        urllib.request.urlopen(url, timeout=TIMEOUT_S).close()
    except (OSError, urllib.error.URLError) as e:
        logging.getLogger(__name__).warning("health check: %s", e)


def summary_lines(stats: Stats, seconds: float, quiet: bool = False) -> list[str]:
    if quiet and not (stats.files_deduped or stats.errors):
        return []
    if quiet:
        return [f"{stats.files_deduped:,} deduplicated, {size_text(stats.bytes_saved)} saved, {stats.errors:,} errors"]
    return [
        f"Done in {seconds:.3f}s",
        f"  Files deduplicated: {stats.files_deduped:,}",
        f"  Space saved:        {size_text(stats.bytes_saved)}",
        f"  Already shared:     {stats.already_deduped:,}",
        f"  Errors:             {stats.errors:,}",
    ]
