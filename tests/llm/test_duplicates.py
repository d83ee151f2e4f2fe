import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sievelake.llm import components, forest, lines, near_dup, toxicity


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = Sets(range(600))
    for a, b in links:
        want.join(a, b)
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for x in {x for link in links for x in link}:
        assert got.get(x, x) == want.find(x)
    beyond = components.components(spark.createDataFrame(links, "a long, b long"), local=0)
    assert {r["id"]: r["label"] for r in beyond.collect()} == got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


SPACES = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_lines(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(SPACES).translate(LOWER)
            if len(key) >= 20:
                holders[key].add(-1 if i is None else i)
    out = []
    for i, t in docs:
        keep, every = [], (t or "").split("\n")
        for line in every:
            own = holders.get(line.strip(SPACES).translate(LOWER), ())
            if len(own) < 3 or max(own) == (-1 if i is None else i):
                keep.append(line)
        out.append((i, len(every), len(every) - len(keep), "\n".join(keep)))
    return out


def test_line_dedup(spark):
    rng = random.Random(6)
    common = ["The very same line of text", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "short one", "x" * 19, "y" * 20, "Second repeated line here"]
    docs = [(i, "\n".join(rng.choice([*common, f"own line number {i} {k} of its own"]) + rng.choice(["", " ", "\t\r"]) for k in range(rng.randint(1, 9)))) for i in range(120)]
    docs += [(i, common[0].upper() if i % 2 else common[0]) for i in range(200, 400)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, common[0]), (None, common[4]), (7, common[4] + "\n" + common[5]), (600, ("z" * 30 + "\n") * 2000)]
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, doc string").repartition(5)
    got = [(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"] or "") for r in lines.dedup_lines(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(docs)))
    assert lines.dedup_lines(df).columns == ["doc_id", "text", "doc", "__n_lines", "__n_dropped"]
    assert lines.dedup_lines(df.limit(0)).count() == 0
    odd = df.selectExpr("doc_id", "text", "doc `__doc`", "1 `__SEAL`", "2 `__bitmap`", "3 `__n_lines`", "4 `a.b`")
    same = [(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"] or "") for r in lines.dedup_lines(odd).collect()]
    assert sorted(map(str, same)) == sorted(map(str, got))
    assert lines.dedup_lines(odd).columns == ["doc_id", "text", "__doc", "__SEAL", "__bitmap", "a.b", "__n_lines", "__n_dropped"]
    rows = df.selectExpr("coalesce(doc_id, -1) doc", "xxhash64(coalesce(text, '')) seal", "text")
    for r in lines.keep_bitmaps(rows).collect():
        keep = np.unpackbits(np.frombuffer(zlib.decompress(r["bitmap"]), np.uint8), count=r["n_lines"])
        assert r["n_lines"] - keep.sum() == r["n_dropped"] > 0


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_near(docs, k, percent):
    sets = []
    for _, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append(set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set())
    own = Sets(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                own.join(a, b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        root = own.find(i)
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return sorted(str((doc, len(sets[i]), least.get(own.find(i), doc), least.get(own.find(i), doc) == doc)) for i, (doc, _) in enumerate(docs))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def near(words, share):
        return [rng.choice(vocabulary) if rng.random() < share else w for w in words]

    docs = []
    for n in (6, 12, 30, 100, 400):
        for _ in range(5):
            base = prose(n)
            docs += [base] + [near(base, s) for s in (0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    chain = prose(200)
    for i in range(25):  # each is near the one before, the ends aren't
        chain = chain[4:] + prose(4)
        docs.append(chain)
    passage = prose(48)
    docs += [prose(3) + passage + prose(4) for _ in range(60)]
    texts = [" ".join(d) for d in docs] + ["", None, " \n", "One", "one", "Two words", "two  words", "a b c", "x " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(3, texts[3]), (None, texts[0]), (None, "lonely text of its own here"), (2, "two words")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, set_id string").repartition(4)
    got = sorted(str(tuple(r)) for r in near_dup.near_duplicates(df, k, percent).collect())
    assert got == brute_near(rows, k, percent)
    assert near_dup.near_duplicates(df.limit(0), k, percent).count() == 0


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Groups of near copies and of texts around one passage go over many small blocks and all tasks."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(300)]
    base, passage = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 45)]
    docs = [[rng.choice(vocabulary) if rng.random() < share else w for w in base] for share in (0.01, 0.03, 0.08) for _ in range(70)]
    docs += [[rng.choice(vocabulary) for _ in range(rng.randint(4, 12))] + passage for _ in range(120)] + [base] * 90
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, class string, band int").repartition(4)
    want = brute_near(rows, 3, 85)
    for block in (near_dup.BLOCK, 7):
        got = near_dup.judged_rows(df, 3, 85, block=block).selectExpr("doc_id", "n", "coalesce(component_id, doc_id) c", "doc_id = coalesce(component_id, doc_id) k")
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_the_ways_beyond_broadcasts(spark, monkeypatch):
    """What is done by shuffles where tables are too large to send to every task gives the same."""
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(12)) + "\nA line that many of the texts share") for i in range(150)]
    rows += [(i + 200, t + " end") for i, t in rows[:40]] + [(None, rows[3][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    every = lambda d: sorted(str(tuple(r)) for r in d.collect())
    near, cut = every(near_dup.near_duplicates(df, 3, 85)), every(lines.dedup_lines(df))
    assert near == brute_near(rows, 3, 85)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lines, "BROADCAST_TASKS", 0)
    local = near_dup.components
    monkeypatch.setattr(near_dup, "components", lambda links: local(links, local=0))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert every(near_dup.near_duplicates(df, 3, 85)) == near and every(lines.dedup_lines(df)) == cut
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_block_links_are_a_forest():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.03], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(5)]
    label = np.arange(45) * 10
    label[:4] = 0
    links = near_dup.block_links(sets, label, np.zeros(45, int), 85)
    assert len(links) == 36 and all(i < 40 and j < 40 for i, j in links)
    side = (np.arange(45) % 2).astype(int)
    assert all(side[i] != side[j] for i, j in near_dup.block_links(sets, np.arange(45), side, 85))


def test_register_estimates():
    rng = np.random.default_rng(7)
    off = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(30):
            both = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
            n = int(len(both) * (1 + share) / 2)
            a, b = both[:n], both[len(both) - n :]
            a, b = np.sort(a), np.sort(b)
            true = len(np.intersect1d(a, b)) / len(both)
            off.append(near_dup.estimate(near_dup.registers(a), near_dup.registers(b), len(a), len(b))[0] - true)
    assert abs(np.mean(off)) < 0.05 and np.max(np.abs(off)) < 0.8


def brute_vectors(rows, threshold):
    dim = 8
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    own, links = Sets(range(len(rows))), defaultdict(int)
    for a in good:
        for b in good:
            if a < b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                own.join(a, b)
                links[a] += 1
                links[b] += 1
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[own.find(i)] = min(least.get(own.find(i), v), v)
    return sorted(str((v, links[i], least.get(own.find(i), v), least.get(own.find(i), v) == v)) for i, (v, _) in enumerate(rows))


@pytest.mark.parametrize("deep", [False, True])
def test_near_vectors(spark, deep):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] + rng.standard_normal(8) * rng.choice([0.02, 0.1, 1.0])).tolist()) for i in range(500)]
    rows += [(600 + i, rows[0][1]) for i in range(20)]
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [1.0] * 7), (704, [float("nan")] + [1.0] * 7), (705, [None] + [1.0] * 7), (None, rows[3][1]), (5, rows[6][1]), (706, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, key string").repartition(3)
    options = {"sample": 60, "leaf": 40, "max_leaf": 120, "trees": 14} if deep else {}
    got = forest.near_vectors(df, 0.9, **options)
    found = sorted(str(tuple(r)) for r in got.collect())
    want = brute_vectors(rows, 0.9)
    if deep:  # small leaves everywhere: the recall that is asked for, and no link that isn't one
        total = lambda x: sum(int(s.split(", ")[1]) for s in x)
        assert 0.9 * total(want) <= total(found) <= total(want)
    else:
        assert found == want
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    neutral = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    bad = ["vileness", "grubbery", "oafish", "snotgob"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rng.choice(neutral) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "en"))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(1000, "", "en"), (1001, None, "en"), (1002, "you OAFISH thing", "de"), (1003, "you oafish thing", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, feature string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["__score"] for r in toxicity.score(df, toxicity.fit(df, table)).collect()}
    assert all((scores[i] >= 0.5) == (i % 6 == 0) for i in range(900))
    assert scores[1000] == scores[1001] < 0.5 < scores[1002] == scores[1003]
    # labels of held-out rows aren't read
    turned = spark.createDataFrame([(i, q, 1 - t if toxicity.held_out(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["__score"] for r in toxicity.score(df, toxicity.fit(df, turned)).collect()} == scores
    none = toxicity.fit(df, table.limit(0))
    assert {r["__score"] < 0.5 for r in toxicity.score(df, none).collect()} == {True}
    assert toxicity.score(df.limit(0), none).count() == 0


def test_toxicity_of_odd_words_and_rows(spark):
    """Short words, runs without spaces, very long texts, null and repeated doc_ids, columns of the result's name."""
    rng = random.Random(14)
    neutral = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(neutral) for _ in range(rng.randint(10, 60))]
        if i % 6 == 0:
            words.insert(rng.randrange(len(words)), "zq" if i % 4 == 0 else "oafish")
        docs.append((i, " ".join(words), i))
        labels.append((i, 1, int(i % 6 == 0)))
    run = "".join(rng.choice(neutral) for _ in range(20_000))
    odd = [(1000, run[:70_000] + "oafish" + run[70_000:], 0), (1001, run, 0), (1002, "zq", 0), (1003, "zqx", 0), (None, "oafish", 0), (None, "", 0), (7, docs[7][1], 0), (7, "oafish", 0)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, `__score` int").repartition(3)
    table = spark.createDataFrame([*labels, (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(df, toxicity.fit(df, table))
    assert scored.columns == ["doc_id", "text", "__score"]
    found = {(r["doc_id"], r["text"]): r["__score"] >= 0.5 for r in scored.collect()}
    assert all(found[i, t] == (i % 6 == 0) for i, t, _ in docs)
    assert [found[i, t] for i, t, _ in odd] == [True, False, True, False, True, False, False, True]
    few, path = toxicity.training_rows(df, table, 100)
    assert 60 <= few.count() <= 140
    repeated = spark.createDataFrame([(1, f"text {i % 4}") for i in range(200)], "doc_id long, text string")
    assert toxicity.training_rows(repeated, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), 10)[0].count() == 4


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(10)
    truth = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.85)]
    weak = [np.where(rng.random(4000) < 0.55, truth, ~truth) * 2 - 1]
    votes = np.stack([*good, *weak, weak[0], weak[0]], 1).astype(np.int8)
    model = toxicity.LabelModel()
    p = model.fit(votes, np.clip(0.5 + 0.1 * votes.sum(1), 0.05, 0.95))
    assert ((p > 0.5) == truth).mean() > 0.93
    assert model.correlated[3, 4] and model.correlated[4, 5] and not model.correlated[0, 1]
