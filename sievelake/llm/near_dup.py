"""Near-duplicate documents by HyperMinHash registers, bands and exact verification.

A document is its set of distinct word shingles, each a 64-bit hash.  Documents
with equal sets are one class from the start.  A class has BANDS * ROWS buckets;
a bucket's register keeps the leading zeros and ten more bits of its smallest
hash, 16 bits in all.  Equal bands of registers make candidates; a pair is tried
if its estimated Jaccard similarity, corrected for chance collisions of
registers, isn't far below the threshold, and linked if its full sets reach it.

Empty buckets of small sets borrow for banding from buckets in a fixed random
order, so that a band rests on several shingles whatever the set's size.

With bands of 8 rows, 48 of them, a pair at 0.85 shares no band with a
probability of 2.4e-7.  Band rows are dealt once, by ranges of (band, class), so
that a frequent band goes over many tasks; each task streams them and hangs every
member of a bucket on the bucket's first class.  Classes have one random order for
all bands, so the members of a group of near copies meet the same few pivots, and
a comparison or two for each of them makes one component of most of the group.
Only buckets that still hold two components go on: their members are compared
block by block where they lie, those of different components alone, and a block
gives no more links than it has members.  So every pair that shares a band is
either compared or connected by links, and no pairs of a group are ever listed.

Defined results: a null or empty text, or one without words, has an empty set, is
linked with nothing and is its own component; with fewer words than a shingle has,
the whole sequence is the one shingle; rows with the same doc_id are judged one
by one; a null doc_id counts for links but never names a component that has
another id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import bpe
from .common import octets, parts, remove, shuffle_partitions, stored, with_columns
from .components import components

BANDS, ROWS, MANTISSA = 48, 8, 10
REGISTERS = BANDS * ROWS
#: Collision constant of HyperMinHash (fixed value of the published estimator).
COLLISION = 0.169919487159739093975315012348
SIGMAS = 6.0
BORROWS = 32  # buckets that an empty one asks
BLOCK = 512  # members of a bucket that are compared with as many others at once
BROADCAST_ROWS = 2_000_000  # ids of 8 bytes, with their hash table some 50 MB; a shuffle beyond

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(raw: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased, words are runs of anything but ASCII white space."""
    data = b"".join(raw).lower()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    none = np.zeros(0, np.uint64)
    if not data:
        return [none] * len(raw)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    ends = np.cumsum(sizes)
    solid = ~space
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    opens[inner] |= solid[inner]
    closes[inner - 1] |= solid[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    cut = np.concatenate([[0], np.searchsorted(begin, ends)]).tolist()
    if not len(begin):
        return [none] * len(raw)
    one, two = bpe.span_keys(data, begin, end)
    word = bpe.mix64(one ^ bpe.mix64(two))
    n = len(word)
    rolled = word.copy()
    for k in range(1, min(words, n)):
        rolled[: n - k] = bpe.mix64(rolled[: n - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    sets = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in word[a:b]:
                h = bpe.mix64(h * np.uint64(0x9E3779B97F4A7C15) + x)
            sets.append(h)
        else:
            sets.append(none)
    return sets


def register_rows(sets: list[np.ndarray]) -> np.ndarray:
    """A row of uint16 registers for each sorted set of hashes; 0: the bucket is empty."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not sum(map(len, sets)):
        return out
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    scaled = (np.concatenate(sets) >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    place = row * REGISTERS + bucket
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    rest = (scaled[first] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
    mantissa, exponent = np.frexp(rest)
    out.reshape(-1)[place[first]] = ((32 - exponent) << MANTISSA) + ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64) + 1
    return out


def registers(s: np.ndarray) -> np.ndarray:
    return register_rows([s])[0]


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    return np.random.default_rng(384).integers(0, REGISTERS, (BORROWS, REGISTERS))


def filled(regs: np.ndarray) -> np.ndarray:
    """Rows of registers without empty ones: each borrows from the first of its lenders that isn't
    empty, else from the next one around.  Rows that are empty as a whole stay so."""
    out = regs.copy()
    rows = np.flatnonzero((regs == 0).any(1) & (regs > 0).any(1))
    for lender in _lenders():
        own, have = regs[rows], out[rows]
        out[rows] = np.where(have == 0, own[:, lender], have)
        rows = rows[(out[rows] == 0).any(1)]
        if not len(rows):
            return out
    own, have = regs[rows], out[rows]
    # the next register around that isn't empty
    place = np.where(np.concatenate([own, own], 1) > 0, np.arange(2 * REGISTERS), 2 * REGISTERS - 1)
    place = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :REGISTERS] % REGISTERS
    out[rows] = np.where(have == 0, np.take_along_axis(own, place, 1), have)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers; 0: an empty band."""
    rows = filled(regs).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = bpe.mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    key[key == 0] = 1
    key[~rows.any(2)] = 0
    return key.view(np.int64)


def estimates(a: np.ndarray, rows: np.ndarray, n: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of registers a with each of some rows, chance collisions taken off, and the
    buckets it rests on; n and sizes: of the sets."""
    used = np.count_nonzero(rows | a, axis=1)
    same = np.count_nonzero((rows == a) & (rows > 0), axis=1)
    ratio = n / sizes
    chance = COLLISION / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, same / used - chance), used


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """The same of two rows of registers."""
    similar, used = estimates(a, b[None], n, np.array([m]))
    return float(similar[0]), int(used[0])


def may_link(a: np.ndarray, rows: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Where the estimate isn't far below the threshold."""
    least = percent / 100
    similar, used = estimates(a, rows, n, sizes)
    return similar >= least - SIGMAS * np.sqrt(least * (1 - least) / used)


def _signatures(words: int, carried: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            raw = octets(batch, "text")
            for i, j in parts(raw, bpe.BLOCK_BYTES):
                sets = shingle_sets(raw[i:j], words)
                names, some = _names(sets)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: batch.column(c).slice(i, j - i) for c in ("doc_id", *carried)},
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "s1": pa.array(names[:, 0], mask=~some),
                        "s2": pa.array(names[:, 1], mask=~some),
                        "regs": pa.array([r.tobytes() if k else None for r, k in zip(register_rows(sets), some.tolist(), strict=True)], pa.binary()),
                    }
                )

    return run


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit name of each set as two numbers, and where a set has shingles."""
    names = np.frombuffer(b"".join([xxh3_128_digest(s) for s in sets]), np.int64).reshape(-1, 2)
    return names, np.array([len(s) > 0 for s in sets], bool)


def _bands(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(regs)
            row, band = np.nonzero(keys)
            yield pa.RecordBatch.from_pydict({"band": pa.array(keys[row, band]), "class": part.column("class").take(pa.array(row))})


def _buckets(batches):
    """Rows in the order of (band, class): every member of a bucket but its first with that first one, the
    pivot.  The pivots of a task's first and last buckets stand there with themselves, as others of these
    buckets may lie in other tasks."""
    first = last = pivot = None
    none = np.zeros(0, np.int64)
    out = lambda band, a, b, edge: pa.RecordBatch.from_pydict({"band": band, "a": a, "b": b, "edge": np.full(len(band), edge)})
    for batch in batches:
        if not batch.num_rows:
            continue
        band, cls = (batch.column(c).to_numpy() for c in ("band", "class"))
        start = np.concatenate([[last is None or band[0] != last], band[1:] != band[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(band)), -1))
        pivots = np.where(at >= 0, cls[at], pivot if pivot is not None else 0)
        if first is None:
            first = band[0]
            yield out(band[:1], cls[:1], cls[:1], True)
        yield out(band[~start], pivots[~start], cls[~start], False)
        last, pivot = band[-1], pivots[-1]
    if last is not None and last != first:
        yield out(np.array([last]), np.array([pivot]), np.array([pivot]), True)
    else:
        yield out(none, none, none, False)


def _full_sets(words: int):
    def run(batches):
        for batch in batches:
            raw = octets(batch, "text")
            for i, j in parts(raw, bpe.BLOCK_BYTES // 2):
                sets = shingle_sets(raw[i:j], words)
                names, some = _names(sets)
                yield pa.RecordBatch.from_pydict(
                    {"s1": pa.array(names[:, 0], mask=~some), "s2": pa.array(names[:, 1], mask=~some), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())}
                )

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                left, right = ([np.frombuffer(h, np.uint64) for h in part.column(c).to_pylist()] for c in ("hashes_a", "hashes_b"))
                for i, (a, b, x, y) in enumerate(zip(left, right, register_rows(left), register_rows(right), strict=True)):
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not may_link(x, y[None], len(a), np.array([len(b)]), percent)[0]:
                        continue
                    if len(a) > len(b):
                        a, b = b, a
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    shared = int(np.count_nonzero(b[at] == a))
                    if 100 * shared >= percent * (len(a) + len(b) - shared):
                        keep.append(start + i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def block_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of sets of different labels, those of side 0 with those of side 1 or, if there is one side only, with
    each other.  What a link joins has one label from then on, so there are fewer links than sets."""
    label = np.unique(label, return_inverse=True)[1]
    n = np.array([len(s) for s in sets], np.int64)
    regs, (_, codes) = register_rows(sets), np.unique(np.concatenate(sets), return_inverse=True)
    starts, held = np.cumsum(n) - n, np.zeros(int(codes.max()) + 1, bool)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = []
    for k, i in enumerate(first):
        others = second if len(second) else first[k + 1 :]
        others = others[(label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        if len(others):
            others = others[may_link(regs[i], regs[others], n[i], n[others], percent)]
        if not len(others):
            continue
        own = codes[starts[i] : starts[i] + n[i]]
        held[own] = True
        found, lengths = bpe.ragged_take(codes, starts, n, others)
        shared = np.add.reduceat(held[found], np.cumsum(lengths) - lengths, dtype=np.int64)
        held[own] = False
        for j in others[100 * shared >= percent * (n[i] + n[others] - shared)]:
            if label[j] != label[i]:
                links.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return links


def _compare(percent: int):
    """Rows in the order of (band, u, v): links within each such block."""

    def links(rows):
        cls, label, slot, hashes = zip(*rows, strict=True)
        found = block_links([np.frombuffer(h, np.uint64) for h in hashes], np.array(label), (np.array(slot) != min(slot)).astype(int), percent)
        return pa.RecordBatch.from_pydict({"a": pa.array([cls[i] for i, _ in found], pa.int64()), "b": pa.array([cls[j] for _, j in found], pa.int64())})

    def run(batches):
        key, rows = None, []
        for part in (batch.slice(i, 200) for batch in batches for i in range(0, batch.num_rows, 200)):
            for *now, cls, label, slot, data in zip(*(part.column(c).to_pylist() for c in ("band", "u", "v", "class", "label", "slot", "hashes")), strict=True):
                if now != key:
                    if len(rows) > 1:
                        yield links(rows)
                    key, rows = now, []
                rows.append((cls, label, slot, data))
        if len(rows) > 1:
            yield links(rows)

    return run


def _pivot_links(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between pivots and their buckets' members."""
    ends = shared.where("edge").select("band", "a")
    least = ends.groupBy("band").agg(F.min("a").alias("m"))
    across = ends.join(least, "band").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    pairs = shared.where("not edge and a <> b").select("a", "b").unionByName(across).distinct()
    a = sets.select(F.col("class").alias("a"), F.col("hashes").alias("hashes_a"))
    b = sets.select(F.col("class").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(_verify(percent), "a long, b long")


def _divided(shared: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """band, class, label, slot, slots of the buckets that hold two components.  Their pivots are left out, but
    for those that may have met a part of their bucket only."""
    rows = shared.select("band", F.col("b").alias("class")).join(labels.withColumnRenamed("id", "class"), "class", "left")
    rows = rows.withColumn("label", F.coalesce("label", "class"))
    split = rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x <> y")
    slots = F.ceil(F.col("m") / block).cast("int")
    return rows.join(split.select("band", slots.alias("slots")), "band").withColumn("slot", F.pmod(F.xxhash64("class"), "slots").cast("int"))


def _block_rows(divided: DataFrame, sets: DataFrame) -> DataFrame:
    """Every row of a divided bucket with its set, once for each pair of blocks it belongs to."""
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other")
    rows = divided.join(sets, "class").select("band", "class", "label", "slot", "hashes", other)
    rows = rows.select("band", F.least("slot", "other").alias("u"), F.greatest("slot", "other").alias("v"), "class", "label", "slot", "hashes")
    n = shuffle_partitions(sets.sparkSession)
    return rows.repartition(n, "band", "u", "v").sortWithinPartitions("band", "u", "v", "class")


def _labels(shared: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Labels (id, label) of the classes that are linked.  shared: band, a, b, edge of all buckets; sets: class, hashes."""
    spark = shared.sparkSession
    first, first_path = stored(_pivot_links(shared, sets, percent), "pivot-links")
    joined = components(first)
    divided, divided_path = stored(_divided(shared, joined, block), "divided")
    rest, rest_path = stored(_block_rows(divided, sets).mapInArrow(_compare(percent), "a long, b long"), "block-links")
    labels = joined
    if not rest.isEmpty():
        labels = components(joined.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(rest))
    for path in (first_path, divided_path, rest_path):
        remove(spark, path)
    return labels


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> tuple[DataFrame, str]:
    """class, hashes of some classes (class, s1, s2, doc_id): one document of each is read again."""
    readers = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        readers = F.broadcast(readers)
    again = docs.select("doc_id", "text").join(readers, docs.doc_id.eqNullSafe(readers.doc_id), "left_semi")
    full = again.mapInArrow(_full_sets(words), "s1 long, s2 long, hashes binary")
    # repeated ids bring other sets, or the same one again
    return stored(full.join(wanted.select("s1", "s2", "class"), ["s1", "s2"]).select("class", "hashes").dropDuplicates(["class"]), "sets")


def judged_rows(docs: DataFrame, words: int, percent: int, carried: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """doc_id and the columns in carried of every row, n (shingles), label (of its component; null: without
    shingles, on its own), component_id (smallest doc_id of the component, null if all are)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    schema = docs.select("doc_id", *carried).schema
    signed, _ = stored(docs.mapInArrow(_signatures(words, carried), with_columns(schema, n="long", s1="long", s2="long", regs="binary")), "signatures")
    one = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("regs").alias("regs"))
    # numbers in the order of the names' hashes
    classes, _ = stored(one.withColumn("class", F.monotonically_increasing_id()), "classes")
    n = shuffle_partitions(spark)
    banded = classes.select("class", "regs").mapInArrow(_bands, "band long, class long")
    dealt = banded.repartitionByRange(n, "band", "class").sortWithinPartitions("band", "class")
    shared, shared_path = stored(dealt.mapInArrow(_buckets, "band long, a long, b long, edge boolean"), "buckets")
    met = shared.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted, wanted_path = stored(classes.drop("regs", "copies").join(met, "class", "left_semi"), "wanted")
    sets, sets_path = _sets_of(docs, wanted, words)
    labels = _labels(shared, sets, percent, block)
    for path in (shared_path, wanted_path, sets_path):
        remove(spark, path)
    named = classes.select("class", "s1", "s2", "doc_id", "copies").join(labels, classes["class"] == labels.id, "left")
    least = labels.join(classes.select(F.col("class").alias("id"), "doc_id"), "id").groupBy("label").agg(F.min("doc_id").alias("others"))
    # a label is a class itself, the smallest one
    own = classes.select(F.col("class").alias("label"), F.col("doc_id").alias("own"))
    least = least.join(own, "label").select("label", F.least("others", "own").alias("component_id"))
    named = named.withColumn("label", F.coalesce("label", "class")).join(least, "label", "left")
    by_class = named.select("s1", "s2", "label", F.coalesce("component_id", "doc_id").alias("component_id"))
    return signed.select("doc_id", *carried, "n", "s1", "s2").join(by_class, ["s1", "s2"], "left").drop("s1", "s2")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    docs: doc_id, text.  Links: 100 * shared shingles >= percent * union; percent from 80, for which
    the bands are made.
    """
    out = judged_rows(docs, words, percent)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
