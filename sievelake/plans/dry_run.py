"""The whole dataflow over a tree: survey, targets, plan, statistics, state.

Effects on files (reflinks, hard links) are rows of the plan, never carried out here.
Whoever carries them out can hand back the files that failed: they count as errors,
go into the report, and their sizes aren't remembered as done.

With a deadline the targets are taken in order, CHUNK at a time, until it has passed;
what was reached is whole, the rest is left for the next run.
"""

from __future__ import annotations

import functools
import os
import re
import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..notify import Stats
from ..operators import content, incremental, report, survey
from ..sources import state, tree

CHUNK = 500  # targets between two looks at the clock
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ms|h|m|s)")


def parse_duration(text: str) -> float:
    """Seconds of `30m`, `1h30m`, `1.5s`."""
    found = _DURATION.findall(text)
    if not found or "".join(a + b for a, b in found) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[unit] for n, unit in found)


@dataclass
class Config:
    root: str = "."
    top: int = 10_000
    min_size: int = 512 * 1024
    snapshots: bool = False
    cache_dir: str | None = None
    mode: str = "reflink"
    commit: bool = False  # take the targets as done and remember their fingerprints
    max_time: float | None = None  # seconds
    failures: DataFrame | None = None  # path, err of planned files that failed
    report: bool = True  # append new kinds of errors to the log in cache_dir
    version: str = "1"


@dataclass
class Result:
    survey: DataFrame
    targets: DataFrame
    actions: DataFrame
    stats: Stats
    unreadable: int
    skipped: int
    seconds: float
    errors: DataFrame | None = None
    reported: int = 0  # new kinds of errors in the log
    late: bool = False  # the deadline passed before all targets were reached
    files_before: int | None = None  # files of the run before


def _reached(files: DataFrame, targets: DataFrame, deadline: float | None) -> tuple[list[DataFrame], DataFrame, bool]:
    """Hashed files of the targets that were reached, those targets, and whether some weren't."""
    if deadline is None:
        return [tree.add_extents(tree.hash_files(content.candidate_files(files, targets))).persist()], targets, False
    ranked, parts, at = survey.ranked(targets).persist(), [], 0
    total = ranked.count()
    while at < total and time.monotonic() < deadline:
        now = ranked.where((F.col("rank") > at) & (F.col("rank") <= at + CHUNK)).drop("rank")
        part = tree.add_extents(tree.hash_files(content.candidate_files(files, now))).persist()
        part.count()
        parts.append(part)
        at += CHUNK
    return parts, ranked.where(F.col("rank") <= at).drop("rank"), at < total


def run(spark: SparkSession, config: Config) -> Result:
    began = time.monotonic()
    root = os.path.realpath(config.root)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such folder: {root}")
    files = tree.read_tree(spark, root, config.min_size, config.snapshots)
    # one scan of the tree: the listing is small beside the files
    files = files.select("path", "dir", "name", "size", F.concat_ws(":", F.col("dev").cast("string"), F.col("ino").cast("string")).alias("ino")).persist()
    by_size, prints = survey.size_survey(files), survey.fingerprints(files)
    place = state.cache_path(config.cache_dir, root) if config.cache_dir else None
    cache = state.load(spark, place) if place else spark.createDataFrame([], state.FINGERPRINTS)
    before = state.load(spark, state.meta_path(place), state.META).first() if place else None
    targets = incremental.next_targets(by_size, prints, cache, config.top).persist()
    skipped = incremental.skipped(survey.candidates(by_size), prints, cache).first()["skipped"]
    parts, reached, late = _reached(files, targets, None if config.max_time is None else began + config.max_time)
    wanted = functools.reduce(DataFrame.unionByName, parts) if parts else tree.add_extents(tree.hash_files(files.limit(0)))
    readable, failures = wanted.where("sha is not null"), config.failures
    judged = content.judged(readable)
    outcome = content.with_failures(judged, failures) if failures is not None else judged
    row = content.outcome_stats(outcome).first()
    actions = content.plan(readable, config.mode)
    unreadable = wanted.where("sha is null")
    errors = content.errors_of(outcome, config.mode) if failures is not None else None
    reported = 0
    if place:
        with state.locked(config.cache_dir, root):
            state.save(files.agg(F.count("*").alias("file_count")), state.meta_path(place))
            if config.commit:
                open_sizes = unreadable.select("size")
                if errors is not None:
                    open_sizes = open_sizes.unionByName(errors.select("size"))
                done = reached.join(open_sizes.distinct(), "size", "left_anti")
                state.save(incremental.merged(incremental.pruned(cache, by_size), done), place)
            if errors is not None and config.report:
                reported = report.append(spark, errors, state.report_path(config.cache_dir, root), config.version, F.current_timestamp())
    stats = Stats(*(row[k] for k in ("bytes_saved", "files_deduped", "already_deduped", "errors")))
    return Result(
        by_size, targets, actions, stats, unreadable.count(), skipped, time.monotonic() - began, errors, reported, late, before["file_count"] if before else None
    )


def run_all(spark: SparkSession, configs: list[Config]) -> tuple[list[Result], Stats]:
    """Several roots one after the other, and the sum of their statistics."""
    results = [run(spark, c) for c in configs]
    return results, Stats(*(sum(getattr(r.stats, f.name) for r in results) for f in fields(Stats)))
