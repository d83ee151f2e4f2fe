"""Near-duplicate vectors by a forest of random-projection trees.

Each tree halves the vectors again and again at the widest gap, near the median,
of their projections on a random direction.  Vectors near a cut go to both sides:
the overlap is as wide as it must be to part no two linked vectors of a sample,
and SPILL standard deviations at least; where that leaves nothing to halve, as in
a dense cluster, the node stays a leaf.  Trees are fitted on a bounded sample
(SAMPLE vectors, links among LINK_SAMPLE of them) and sent to all tasks.

1. Vectors go to their leaves as 128 signs of random projections, 16 bytes.  Those
   that have another one of the leaf within RADIUS differing signs stay; two
   vectors at a cosine of 0.9 are farther with a probability of about 5e-5.
2. What stays meets once more in its leaves, whole, and is compared in double
   precision; a leaf's links become one star for each of its components.
3. Stars make components.  The members of each component are packed into blocks
   in the shared folder and all their pairs compared, so that a link that no leaf
   holds is counted all the same.  Two blocks are left out if the triangle
   inequality on the sphere rules links out, and counted without comparison if it
   makes every pair a link.  Pairs of blocks are spread over tasks, whatever
   component they come from.

Leaves with more vectors than a task should hold are compared in parts, each pair
of parts by itself.  Links aren't written, numbers of links are summed up.  Equal
vectors are one class from the start, so a frequent vector costs one row.  Up to
LINK_SAMPLE distinct vectors no link is lost; beyond it recall is measured in the
tests and stated in the README.

Defined results: a vector that is null, zero, empty or holds a null or non-finite
component links with nothing; vectors of different lengths don't link; rows with
the same vec_id are judged one by one; a null vec_id never names a component
that has another id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import file_system, remove, scratch, shuffle_partitions, stored
from .components import components

TREES = 6
SAMPLE = 20_000  # distinct vectors that the trees are fitted on, about
LINK_SAMPLE, LINKS = 8_000, 500_000  # of those, the ones whose links cuts must not part; links of them at most
LEAF = 1024  # vectors a leaf should hold
LEAST_SAMPLE = 24  # sampled vectors a node needs to be halved
PART = 1024  # vectors of a leaf or block that a task compares with as many others; four times as many by their signs
BLOCK_BYTES = 32 << 20
SPILL = 0.15  # overlap on each side of a cut, in standard deviations of the projection
TRIES = 4  # directions looked at for a cut
SIGNS, RADIUS = 128, 34
SEED = 5
ROUTED = "leaf long, u int, v int, slot int, class long, one long, two long"
BLOCKS = "file string, held int, low long, high long, centre binary, radius double"


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Rows as double vectors; None where a row can't link."""
    out = []
    for v in column.to_pylist():
        if not v or any(c is None for c in v):
            out.append(None)
            continue
        a = np.asarray(v, np.float64) + 0.0  # one zero only
        out.append(a if np.isfinite(a).all() and a.any() else None)
    return out


def _keys(kind: str):
    def run(batches):
        for batch in batches:
            rows = _vectors(batch.column("embedding"))
            # a scale that keeps squares finite; the cosine doesn't change
            rows = [v if v is None or 1e-100 < np.abs(v).max() < 1e100 else v / np.abs(v).max() for v in rows]
            data = [None if v is None else v.astype(kind).tobytes() for v in rows]
            able = np.array([d is not None for d in data], bool)
            names = np.frombuffer(b"".join([xxh3_128_digest(d or b"") for d in data]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "k1": pa.array(names[:, 0], mask=~able),
                    "k2": pa.array(names[:, 1], mask=~able),
                    "data": pa.array(data, pa.binary()),
                }
            )

    return run


def _matrix(rows: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1))


def _gap(p: np.ndarray) -> float:
    """The widest gap in the middle of the projections."""
    p = np.sort(p)
    a, b = int(len(p) * 0.35), max(int(len(p) * 0.65), int(len(p) * 0.35) + 2)
    gaps = np.diff(p[a:b])
    k = a + int(np.argmax(gaps)) if len(gaps) else a
    return float((p[k] + p[min(k + 1, len(p) - 1)]) / 2)


def sample_links(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rows of the first LINK_SAMPLE unit vectors that are linked, LINKS of them at most."""
    x, found = sample[:LINK_SAMPLE], [np.zeros((0, 2), np.int64)]
    for a in range(0, len(x), 1000):
        i, j = np.nonzero(x[a : a + 1000] @ x[a:].T >= threshold)
        found.append(np.stack([i + a, j + a], 1)[i < j])
    pairs = np.concatenate(found)
    return pairs if len(pairs) <= LINKS else pairs[np.random.default_rng(SEED).choice(len(pairs), LINKS, replace=False)]


def fit(sample: np.ndarray, links: np.ndarray, leaf: float, trees: int = TREES) -> list[list[tuple]]:
    """Trees as lists of nodes (direction, cut, overlap, left, right); a leaf is the number of sampled vectors
    it holds.  sample: unit vectors; leaf: sampled vectors a leaf should hold."""
    forest = []
    for t in range(trees):
        rng = np.random.default_rng((SEED, t))
        nodes: list = [len(sample)]
        todo = [(0, np.arange(len(sample)), links)]
        while todo:
            node, own, pairs = todo.pop()
            nodes[node] = len(own)
            if len(own) <= max(leaf, LEAST_SAMPLE if leaf < LEAF else 1):
                continue
            best = None
            for _ in range(TRIES):
                d = rng.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d)
                p = sample[own] @ d
                at = _gap(p)
                far = (sample @ d)[pairs] - at if len(pairs) else np.zeros((0, 2))
                # how far a pair on both sides reaches into the nearer one
                reach = np.where(far[:, 0] * far[:, 1] < 0, np.abs(far).min(1), 0)
                overlap = max(SPILL * float(p.std()), float(reach.max(initial=0)) * (1 + 1e-9))
                both = int(np.count_nonzero(np.abs(p - at) <= overlap))
                if best is None or both < best[0]:
                    best = (both, d, p, at, overlap)
            _, d, p, at, overlap = best
            left, right = own[p <= at + overlap], own[p >= at - overlap]
            if max(len(left), len(right)) > 0.9 * len(own):
                continue  # a cluster that no cut leaves whole
            nodes[node] = (d, at, overlap, len(nodes), len(nodes) + 1)
            for child, members in ((nodes[node][3], left), (nodes[node][4], right)):
                nodes.append(0)
                inside = np.zeros(len(sample), bool)
                inside[members] = True
                todo.append((child, members, pairs[inside[pairs].all(1)]))
        forest.append(nodes)
        if len(nodes) == 1:
            break  # nothing to halve: all trees are the same leaf
    return forest


def leaves(nodes: list, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Leaves of a tree and the rows of x (unit vectors) in each."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if isinstance(nodes[node], int):
            out.append((node, own))
            continue
        d, at, overlap, left, right = nodes[node]
        p = x[own] @ d
        todo += [(left, own[p <= at + overlap]), (right, own[p >= at - overlap])]
    return out


def signs(x: np.ndarray, tree: int) -> np.ndarray:
    """128 signs of random projections of unit vectors as two numbers a row; other ones for each tree."""
    planes = np.random.default_rng((SEED, 128, x.shape[1], tree)).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view("<i8").astype(np.int64)


def _pairs_of_slots(slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row once for every pair of slots it belongs to: places, u, v."""
    at = np.repeat(np.arange(len(slot)), slots)
    other = np.tile(np.arange(slots), len(slot))
    return at, np.minimum(slot[at], other), np.maximum(slot[at], other)


def _route(model, kind: str, part: int):
    """Rows of every leaf of every tree: model.value[dim] is (trees, vectors for each sampled one)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, cls = batch.column("data").to_pylist(), batch.column("class").to_numpy()
            dims = np.array([len(d) for d in data]) // np.dtype(kind).itemsize
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = _matrix([data[i] for i in own], kind)
                forest, share = model.value.get(dim, ([[0]], 1.0))
                for t, nodes in enumerate(forest):
                    sketch = signs(x, t)
                    for node, rows in leaves(nodes, x):
                        slots = max(1, math.ceil(nodes[node] * share / (4 * part)))
                        slot = cls[own[rows]] % slots
                        at, u, v = _pairs_of_slots(slot, slots)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "leaf": pa.array(np.full(len(at), (dim << 44) + (t << 36) + node, np.int64)),
                                "u": pa.array(u, pa.int32()),
                                "v": pa.array(v, pa.int32()),
                                "slot": pa.array(slot[at], pa.int32()),
                                "class": pa.array(cls[own[rows]][at]),
                                "one": pa.array(sketch[rows, 0][at]),
                                "two": pa.array(sketch[rows, 1][at]),
                            }
                        )

    return run


def _groups(batches, columns: tuple[str, ...]):
    """Rows of each (leaf, u, v), which come in order: key and a list of the other columns."""
    key, rows = None, []
    for part in (batch.slice(i, 2000) for batch in batches for i in range(0, batch.num_rows, 2000)):
        for *now, row in zip(*(part.column(c).to_pylist() for c in ("leaf", "u", "v")), zip(*(part.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if now != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = now, []
            rows.append(row)
    if len(rows) > 1:
        yield key, rows


def _near_signs(batches):
    """leaf, class of the vectors that have another one of their leaf within RADIUS."""
    for (leaf, u, v), rows in _groups(batches, ("slot", "class", "one", "two")):
        slot, cls, one, two = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        one, two = one.view(np.uint64), two.view(np.uint64)  # bits of negative numbers are counted otherwise
        a = np.flatnonzero(slot == u)
        b = a if u == v else np.flatnonzero(slot == v)
        near = np.zeros(len(cls), bool)
        for i in range(0, len(a), 256):
            p = a[i : i + 256]
            close = np.bitwise_count(one[p][:, None] ^ one[b]) + np.bitwise_count(two[p][:, None] ^ two[b]) <= RADIUS
            if u == v:
                close[np.arange(len(p)), np.arange(i, i + len(p))] = False
            near[p] |= close.any(1)
            near[b] |= close.any(0)
        if near.any():
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(np.full(int(near.sum()), leaf, np.int64)), "class": pa.array(cls[near])})


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Where the products of unit vectors reach the threshold: single precision where it can tell, else double."""
    slack = (a.shape[1] + 8) * 2.0**-22  # more than single precision can be off
    product = a.astype(np.float32) @ b.astype(np.float32).T
    close = product >= threshold + slack
    i, j = np.nonzero((product >= threshold - slack) & ~close)
    for s in range(0, len(i), 16_384):
        p, q = i[s : s + 16_384], j[s : s + 16_384]
        close[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return close


def _stars(close: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component; rows and columns: the nodes of close."""
    label = np.arange(n)
    while True:
        new = label.copy()
        new[rows] = np.minimum(new[rows], np.where(close, label[columns], n).min(1, initial=n))
        new[columns] = np.minimum(new[columns], np.where(close, new[rows][:, None], n).min(0, initial=n))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _leaf_links(kind: str, threshold: float):
    def run(batches):
        for (_, u, v), rows in _groups(batches, ("slot", "class", "data")):
            slot, cls, data = zip(*rows, strict=True)
            slot, x = np.array(slot), _matrix(list(data), kind)
            a = np.flatnonzero(slot == u)
            b = a if u == v else np.flatnonzero(slot == v)
            close = _close(x[a], x[b], threshold)
            if u == v:
                np.fill_diagonal(close, False)
            label = _stars(close, a, b, len(x))
            own = np.flatnonzero(label != np.arange(len(x)))
            yield pa.RecordBatch.from_pydict({"a": pa.array([cls[i] for i in own], pa.int64()), "b": pa.array([cls[label[i]] for i in own], pa.int64())})

    return run


def _model(classes: DataFrame, kind: str, threshold: float, trees: int, sample: int, leaf: int) -> dict:
    """For each length of vectors: its trees, and how many vectors a sampled one stands for."""
    total = classes.count()
    range_ = 1 << 40
    least = max(1, min(range_, int(sample / max(total, 1) * range_)))
    chosen = classes.where(F.pmod(F.xxhash64("k1", "k2", F.lit(SEED)), F.lit(range_)) < least).select("data")
    by_dim: dict[int, list] = {}
    for r in sorted((bytes(r[0]) for r in chosen.collect()), key=xxh3_128_digest):
        by_dim.setdefault(len(r) // np.dtype(kind).itemsize, []).append(r)
    share = max(1.0, range_ / least)
    out = {}
    for dim, rows in by_dim.items():
        x = _matrix(rows, kind)
        out[dim] = (fit(x, sample_links(x, threshold), leaf / share, trees), share)
    return out


def _candidates(classes: DataFrame, model, kind: str, part: int) -> DataFrame:
    """leaf, class of vectors with another one near by their signs."""
    n = shuffle_partitions(classes.sparkSession)
    routed = classes.select("class", "data").mapInArrow(_route(model, kind, part), ROUTED)
    dealt = routed.repartition(n, "leaf", "u", "v").sortWithinPartitions("leaf", "u", "v", "class")
    return dealt.mapInArrow(_near_signs, "leaf long, class long").distinct()


def _in_leaves(near: DataFrame, classes: DataFrame, kind: str, threshold: float, part: int) -> DataFrame:
    """Links a, b of each leaf's components.  near: leaf, class."""
    n = shuffle_partitions(classes.sparkSession)
    # two slots meet in a task: together they hold at most about a part
    held = F.count("*")
    sizes = near.groupBy("leaf").agg(F.when(held <= part, 1).otherwise(F.ceil(2 * held / part)).cast("int").alias("slots"))
    slot = F.pmod("class", "slots").cast("int")
    rows = near.join(sizes, "leaf").withColumn("slot", slot).join(classes.select("class", "data"), "class")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rows = rows.select("leaf", F.least("slot", "other").alias("u"), F.greatest("slot", "other").alias("v"), "slot", "class", "data")
    dealt = rows.repartition(n, "leaf", "u", "v").sortWithinPartitions("leaf", "u", "v", "class")
    return dealt.mapInArrow(_leaf_links(kind, threshold), "a long, b long")


def _cells(model, kind: str):
    """Adds the length of each vector and its first leaf in the first tree."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data = batch.column("data").to_pylist()
                dims = np.array([len(d) for d in data]) // np.dtype(kind).itemsize
                cell = np.zeros(len(dims), np.int64)
                for dim in set(dims.tolist()) & set(model.value):
                    own = np.flatnonzero(dims == dim)
                    for node, rows in leaves(model.value[dim][0][0], _matrix([data[i] for i in own], kind)):
                        cell[own[rows]] = node
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int64()), pa.array(cell)], names=[*batch.schema.names, "dim", "cell"])

    return run


def _pack(folder: str, kind: str, part: int):
    """Writes blocks of vectors that come in the order of their components."""

    def run(batches):
        store, root = file_system(folder)
        rows: list = []

        def flush():
            label, cls, data, copies = zip(*rows, strict=True)
            x = _matrix(list(data), kind)
            centre = x.sum(0)
            centre = unit(centre[None])[0] if centre.any() else x[0]
            name = uuid.uuid4().hex
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(np.array([cls, copies, label], "<i8").tobytes() + x.astype("<f8").tobytes())
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            rows.clear()
            return pa.RecordBatch.from_pydict(
                {
                    "file": [name],
                    "held": pa.array([len(cls)], pa.int32()),
                    "low": pa.array([label[0]], pa.int64()),
                    "high": pa.array([label[-1]], pa.int64()),
                    "centre": pa.array([centre.tobytes()], pa.binary()),
                    "radius": [radius],
                }
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "class", "data", "copies")), strict=True):
                most = max(1, min(part, BLOCK_BYTES // (8 * len(row[2]))))
                if rows and (len(rows) >= most or len(rows[-1][2]) != len(row[2])):
                    yield flush()
                rows.append(row)
        if rows:
            yield flush()

    return run


def _block_links(folder: str, threshold: float):
    """For pairs of blocks: for every vector that has links the number it gains, and the first vector of its
    part where that one is of another component."""
    angle = math.acos(max(-1.0, min(1.0, threshold)))

    def run(batches):
        store, root = file_system(folder)
        held: list = [None, None]

        def block(side: int, name: str, n: int):
            if held[side] is None or held[side][0] != name:
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                held[side] = (name, np.frombuffer(data, "<i8", 3 * n).reshape(3, n), np.frombuffer(data, "<f8", -1, 24 * n).reshape(n, -1))
            return held[side][1:]

        for batch in batches:
            for row in batch.to_pylist():
                same = row["a_file"] == row["b_file"]
                c, d = np.frombuffer(row["a_centre"]), np.frombuffer(row["b_centre"])
                apart = 0.0 if same else math.acos(max(-1.0, min(1.0, float(c @ d))))
                reach = row["a_radius"] + row["b_radius"] + 1e-6
                if apart > angle + reach:
                    continue
                (cls, copies, label), x = block(0, row["a_file"], row["a_held"])
                if same:
                    weight, y = copies, x
                else:
                    (others, weight, more), y = block(1, row["b_file"], row["b_held"])
                    cls, label = np.concatenate([cls, others]), np.concatenate([label, more])
                if apart + reach <= angle:
                    close = None  # every pair is a link
                    gained = np.full(len(x), weight.sum(), np.float64)
                    gained = gained - copies if same else np.concatenate([gained, np.full(len(y), copies.sum(), np.float64)])
                    star = np.zeros(len(gained), np.int64)
                else:
                    close = _close(x, y, threshold)
                    if same:
                        close |= close.T
                        np.fill_diagonal(close, False)
                    a, b = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
                    if not len(a):
                        continue
                    close = close[np.ix_(a, b)]
                    counted = close.astype(np.float64)
                    gained = np.zeros(len(x) + (not same) * len(y))
                    gained[a] += counted @ weight[b]
                    columns = b if same else b + len(x)
                    if not same:
                        gained[columns] += copies[a] @ counted
                    star = _stars(close, a, columns, len(gained))
                some = np.flatnonzero(gained)
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": pa.array(cls[some]),
                        "gained": pa.array(gained[some].astype(np.int64)),
                        "b": pa.array(cls[star[some]], mask=label[star[some]] == label[some]),
                    }
                )

    return run


def _within(classes: DataFrame, labels: DataFrame, model, kind: str, threshold: float, part: int) -> tuple[DataFrame, str]:
    """a, gained, b of all links within components.  labels: id, label."""
    spark = classes.sparkSession
    n = shuffle_partitions(spark)
    members = labels.select(F.col("id").alias("class"), "label").unionByName(labels.select(F.col("label").alias("class"), "label").distinct())
    rows = members.join(classes.select("class", "data", "copies"), "class").mapInArrow(
        _cells(model, kind), T._parse_datatype_string("class long, label long, data binary, copies long, dim long, cell long")
    )
    folder = scratch(spark, "blocks")
    order = ["dim", "label", "cell", "class"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks, path = stored(dealt.mapInArrow(_pack(folder, kind, part), BLOCKS), "block-list")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("file", "held", "centre", "radius")]
    alone = blocks.select(*side("a"), *side("b"))
    # components that go over several blocks
    ends = blocks.select("file", "held", "centre", "radius", F.explode(F.array_distinct(F.array("low", "high"))).alias("label"))
    several = ends.join(ends.groupBy("label").agg(F.count("*").alias("k")).where("k > 1").select("label"), "label", "left_semi")
    a, b = several.select("label", *side("a")), several.select("label", *side("b"))
    pairs = a.join(b, "label").where("a_file < b_file").drop("label").unionByName(alone)
    links = pairs.repartition(n).mapInArrow(_block_links(folder, threshold), "a long, gained long, b long")
    found, found_path = stored(links, "gained")
    for p in (folder, path):
        remove(spark, p)
    return found, found_path


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, trees: int | None = None, sample: int = SAMPLE, leaf: int = LEAF, max_leaf: int | None = None
) -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of threshold or more), component_id (smallest vec_id
    reachable), kept (vec_id = component_id).

    vectors: vec_id, embedding.  leaf: vectors a leaf should hold; max_leaf: vectors compared with as many
    others at once; threshold from 0.9, for which RADIUS is made.
    """
    spark = vectors.sparkSession
    part = max_leaf or PART
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "<f4" if source.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    keyed, _ = stored(source.mapInArrow(_keys(kind), "vec_id long, k1 long, k2 long, data binary"), "vectors")
    one = keyed.where("data is not null").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("data").alias("data"))
    classes, _ = stored(one.withColumn("class", F.monotonically_increasing_id()), "classes")
    model = spark.sparkContext.broadcast(_model(classes, kind, threshold, trees or TREES, sample, leaf))
    near, near_path = stored(_candidates(classes, model, kind, part), "near")
    links, links_path = stored(_in_leaves(near, classes, kind, threshold, part), "leaf-links")
    labels = components(links)
    found, _ = _within(classes, labels, model, kind, threshold, part)
    across = found.where("b is not null").select("a", "b")
    if not across.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(across))
    for path in (near_path, links_path):
        remove(spark, path)
    gained = found.groupBy(F.col("a").alias("class")).agg(F.sum("gained").alias("gained"))
    named = classes.select("class", "k1", "k2", "copies", "first").join(labels.withColumnRenamed("id", "class"), "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    least = labels.join(classes.select(F.col("class").alias("id"), "first"), "id").groupBy("label").agg(F.min("first").alias("others"))
    # a label is a class itself, the smallest one
    least = least.join(classes.select(F.col("class").alias("label"), F.col("first").alias("own")), "label").select("label", F.least("others", "own").alias("component_id"))
    by_class = named.join(least, "label", "left").join(gained, "class", "left").select(
        "k1", "k2", (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")
    )
    component = F.coalesce("component_id", "vec_id")
    return keyed.select("vec_id", "k1", "k2").join(by_class, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
