"""Command line: python -m sievelake.cli [options] ROOT.  Prints what could be saved and the plan."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import notify
from .operators import content, survey
from .plans.dry_run import Config, Result, parse_duration, run


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievelake")
    p.add_argument("roots", nargs="*", default=["."], metavar="ROOT")
    p.add_argument("--top", type=int, default=10_000)
    p.add_argument("--min-size", type=int, default=512 * 1024)
    p.add_argument("--max-time", help="such as 30m or 1h30m: take no more targets after it")
    p.add_argument("--snapshots", action="store_true")
    p.add_argument("--hardlink", action="store_true")
    p.add_argument("--raw-sizes", action="store_true", help="bytes as they are")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--no-report", action="store_true", help="don't log new kinds of errors")
    p.add_argument("--cache-dir", default=os.path.expanduser("~/.cache/sievelake"))
    p.add_argument("--commit", action="store_true", help="remember the targets as done")
    p.add_argument("--failures", help="JSON lines of path, err: planned files that failed when the plan was carried out")
    p.add_argument("--webhook", help="where to post a message about each run")
    p.add_argument("--alerts", help="where to post a message if there were errors")
    p.add_argument("--healthcheck", help="what to ping at the end")
    p.add_argument("-v", "--verbose", action="store_true", help="a line for each planned file on standard error")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(argv)
    try:
        max_time = parse_duration(a.max_time) if a.max_time else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    failures = spark.read.schema("path string, err string").json(a.failures) if a.failures else None
    code = 0
    for root in a.roots:
        try:
            result = run(
                spark,
                Config(
                    root, a.top, a.min_size, a.snapshots, None if a.no_cache else a.cache_dir, "hardlink" if a.hardlink else "reflink", a.commit, max_time, failures, not a.no_report
                ),
            )
        except (FileNotFoundError, BlockingIOError) as e:
            print(e, file=sys.stderr)
            code = 1
            continue
        show(result, a.quiet, a.verbose, a.raw_sizes)
        if a.webhook:
            _try(notify.send, a.webhook, notify.update_text(result.stats, root, result.seconds, dry_run=failures is None))
        if a.alerts and (text := notify.alert_text(result.stats, root)):
            _try(notify.send, a.alerts, text)
        code = 1 if result.stats.errors else code
    if a.healthcheck:
        notify.ping(a.healthcheck)
    return code


def _try(send, *args) -> None:
    """A message that doesn't arrive doesn't make the run fail."""
    try:
        send(*args)
    except OSError as e:
        print(e, file=sys.stderr)


def show(result: Result, quiet: bool = False, verbose: bool = False, raw: bool = False) -> None:
    """The table of targets with what it leaves out, the plan's lines and the summary."""
    if not quiet:
        if result.files_before is not None:
            print(f"files at the last run: {result.files_before:,}")
        for r in survey.display(result.targets, raw=raw).orderBy("rank").collect():
            print(f"{r['rank']:>5}  {r['size_text']:>12} x {r['count_text']:<8} {r['savings_text']}")
        rest = survey.remainder(result.targets, raw=raw).first()
        if rest["more"]:
            print(f"       ... and {rest['more']:,} more")
        print(f"{'total':>5}  {rest['files']:,} files, {rest['savings_text']}")
        for r in content.plan_lines(result.actions, raw).toLocalIterator():
            print(r["line"])
    if verbose and not quiet:
        for r in content.verbose_lines(result.actions).toLocalIterator():
            print(r["line"], file=sys.stderr)
    if result.late and not quiet:
        print("time is up: not all targets were reached", file=sys.stderr)
    print(*notify.summary_lines(result.stats, result.seconds, quiet), sep="\n")


if __name__ == "__main__":
    sys.exit(main())
