"""URL filtering by a sort-merge range join.

A canonical key turns hosts around, label by label, so that a host and all its
subdomains are one interval of keys.  Pages are dealt by ranges of keys; a rule
goes to every range that its interval meets.  In a range, rules and pages come
sorted together: a sweep keeps a stack of the rules' hosts whose intervals are
open, each nested in the one below, and a page asks the stack for the longest
rule whose path starts its own.

Rules are a table of any size (host, path, verdict).  A frequent host is cut at
path and page id, a frequent url at the page id, so it fills as many ranges as
its share of rows.

Defined results: a null url, or one without "://", has an empty host and path
and fits no rule; a page that fits none gets the default verdict; equal rules are
one, a later block winning over an allow; of two rules of equal length the one
with the longer host wins; repeated pages keep a row each; empty tables work.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {i: i + 32 for i in range(65, 91)}
SAMPLE_PER_RANGE = 60  # keys sampled for each range bound
ROWS = "part int, key binary, kind int, id long, host string, path string, verdict string"
RESULT = "page_id long, host string, path string, rule string, verdict string"


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


#: the bytes that part labels, hosts and paths, as they stand in a host's own text
_ESCAPES = {i: f"\x02{chr(i + 1)}" for i in range(3)}


def host_key(host: str) -> bytes:
    if host.isprintable():
        return "\x01".join(reversed(host.split("."))).encode()
    return "\x01".join(reversed(host.translate(_ESCAPES).split("."))).encode("utf-8", "replace")


def page_key(host: str, path: str) -> bytes:
    return host_key(host) + b"\x00" + path.encode("utf-8", "replace")


def interval(host: str) -> tuple[bytes, bytes]:
    """First key of a host and its subdomains, and the first one beyond."""
    low = host_key(host)
    return low, low + b"\x02"


class Sweep:
    """The stack of open intervals as a sweep goes over sorted keys."""

    def __init__(self):
        self.open: list[tuple[bytes, int, dict, list]] = []

    def _close(self, key: bytes) -> None:
        while self.open and not (key.startswith(low := self.open[-1][0]) and (len(key) == len(low) or key[len(low)] <= 1)):
            self.open.pop()

    def rule(self, low: bytes, host: str, path: str, verdict: str) -> None:
        self._close(low)
        if not self.open or self.open[-1][0] != low:
            self.open.append((low, len(host), {}, []))
        _, _, paths, sizes = self.open[-1]
        if paths.get(path, ("", ""))[1] != "block":
            paths[path] = (host + path, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def page(self, key: bytes, path: str) -> tuple[str, str] | None:
        self._close(key)
        best, found = -1, None
        for _, n, paths, sizes in reversed(self.open):
            for size in sizes:
                if n + size <= best:
                    break
                if size <= len(path) and (hit := paths.get(path[:size])):
                    best, found = n + size, hit
                    break
        return found


def _bounds(pages: DataFrame, n: int) -> list[bytes]:
    """Up to n - 1 keys that cut the pages into ranges of about equal size; a frequent key may stand in a row."""
    total = pages.count()
    if total == 0:
        return []
    want = SAMPLE_PER_RANGE * n
    sample = pages if total <= want else pages.sample(min(1.0, 1.2 * want / total), 7)
    keys = sorted(page_key(*parse(r[0])) for r in sample.select("url").limit(2 * want).collect())
    return [keys[len(keys) * k // n] for k in range(1, n)] if keys else []


def _place(bounds: list[bytes], key: bytes, salt: int) -> int:
    low, high = bisect_left(bounds, key), bisect_right(bounds, key)
    return low + salt % (high - low + 1) if high > low else low


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, or null), verdict.

    pages: page_id, url; rules: host, path, verdict.
    """
    n = shuffle_partitions(pages.sparkSession)
    bounds = _bounds(pages, n)

    def keyed(batches):
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            parsed = [parse(u) for u in urls]
            keys = [page_key(h, p) for h, p in parsed]
            parts = [_place(bounds, k, hash((i or 0, x)) & 0xFFFF) for x, (k, i) in enumerate(zip(keys, ids, strict=True))]
            yield _rows(parts, keys, 1, ids, [h for h, _ in parsed], [p for _, p in parsed], [None] * len(keys))

    def spread(batches):
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True):
                host, path = (host or "").translate(_UPPER), path or ""
                low, high = interval(host)
                out += [(p, low, host, path, verdict) for p in range(bisect_left(bounds, low), bisect_right(bounds, high) + 1)]
            if out:
                parts, keys, hosts, paths, verdicts = zip(*out, strict=True)
                yield _rows(parts, keys, 0, [None] * len(out), hosts, paths, verdicts)

    def sweep(batches):
        part, stack = None, None
        for batch in batches:
            ids, hosts, paths, found = [], [], [], []
            for now, key, kind, i, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != part:
                    part, stack = now, Sweep()
                if kind == 0:
                    stack.rule(key, host, path, verdict)
                else:
                    ids.append(i)
                    hosts.append(host)
                    paths.append(path)
                    found.append(stack.page(key, path) or (None, default))
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": pa.array(ids, pa.int64()),
                    "host": pa.array(hosts, pa.string()),
                    "path": pa.array(paths, pa.string()),
                    "rule": pa.array([r for r, _ in found], pa.string()),
                    "verdict": pa.array([v for _, v in found], pa.string()),
                }
            )

    both = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(keyed, ROWS).unionByName(
        rules.select("host", "path", "verdict").mapInArrow(spread, ROWS)
    )
    return both.repartition(n, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, RESULT)


def _rows(parts, keys, kind: int, ids, hosts, paths, verdicts) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(parts, pa.int32()),
            "key": pa.array(keys, pa.binary()),
            "kind": pa.array([kind] * len(parts), pa.int32()),
            "id": pa.array(ids, pa.int64()),
            "host": pa.array(hosts, pa.string()),
            "path": pa.array(paths, pa.string()),
            "verdict": pa.array(verdicts, pa.string()),
        }
    )
