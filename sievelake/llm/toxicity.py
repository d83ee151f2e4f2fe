"""Toxicity by weak supervision.

Many voters look at a text: lexicons of words and word beginnings, and patterns
over them.  A generative label model estimates from their votes alone how
accurate each one is and which ones are correlated, and gives every text a
posterior probability.  A linear classifier over words and word beginnings is
trained on these posteriors and scores all texts; its intercept puts 0.5 in the
gap between the sample's toxic and clean rows.

Fitting sees a bounded sample of labelled rows (SAMPLE_ROWS, chosen by hashes),
written to the shared folder; labels of rows with crc32(doc_id) mod 5 = 0 are never
read.  Labels serve to find the lexicons and to fix which of the model's two sides
is toxic.  Features are counted, and those that tell the sides apart chosen, where
the rows are; the driver gets the chosen ones and their places in sampled rows.
Inputs of a score are the text's words only, whatever their length: a run of more
than LONG characters, as of scripts without spaces, has the beginnings that start
at any of its characters.  Scoring covers every row and takes no shuffle.

Defined results: null and empty texts score as texts without words; a text's
score doesn't depend on its other columns, so repeated texts score alike; labels
of a null doc_id are not read, and of several labels of a doc_id the highest
counts; without any labelled toxic or clean row all scores are the share of toxic
rows (0 without labels); an empty table gives no rows; a column of the result's
name in the input is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, near_dup
from .common import map_columns, octets, parts, remove, stored, with_columns, without

SAMPLE_ROWS = 20_000  # labelled rows that fitting may see
FOLDS = 5  # rows with crc32(doc_id) mod FOLDS = 0 are held out
BEGINNINGS = (4, 5, 6, 7)  # characters of word beginnings
MIN_TOXIC, MIN_LIFT = 5, 40.0  # rows with the feature among toxic ones; odds against clean ones
ROUGH_LIFT = MIN_LIFT / 8  # the same before copies of a text are counted once
LONG = 40  # characters of a word; longer ones are runs
PIECE = 1 << 20  # characters of a run whose beginnings are gathered at once in counting
COPY_PAIRS = 4  # smallest hashes of pairs of words that copies of a text share
LEXICONS = 12  # voters that share out a kind of feature


#: First characters of features: a word, a beginning, a beginning of two words or more, of four or more.
WORD, ONE, TWO, FOUR = "=bcd"
KINDS = WORD + ONE + TWO + FOUR


def features_of(word: str) -> list[str]:
    """A word and its beginnings, told apart by a mark."""
    if len(word) > LONG:
        return list(dict.fromkeys(ONE + word[i : i + k] for i in range(len(word) - BEGINNINGS[0] + 1) for k in BEGINNINGS if i + k <= len(word)))
    return [WORD + word, *(ONE + word[:k] for k in BEGINNINGS if len(word) >= k)]


def _lower(raw: list[bytes]) -> list[bytes]:
    return [x.decode("utf-8", "replace").lower().encode() for x in raw]


def features_of_text(text: bytes) -> set[str]:
    """All features of a text."""
    words = bpe.split_bytes(_lower([text]), bpe.word_starts, drop_space=True)
    return _features([w.decode("utf-8", "replace") for w in words.distinct()])


def _features(words: list[str]) -> set[str]:
    counts = Counter(f for w in words for f in features_of(w))
    more = {TWO + f[1:] for f, n in counts.items() if n >= 2 and f[0] == ONE} | {FOUR + f[1:] for f, n in counts.items() if n >= 4 and f[0] == ONE}
    return more | counts.keys()


class Finder:
    """Finds the named features in texts, a batch at a time."""

    def __init__(self, names: dict[str, int]):
        self.n = len(names)
        ids = dict(names)
        for f in names:  # what features of several words count
            if f[0] in TWO + FOUR:
                ids.setdefault(ONE + f[1:], len(ids))
        self.several = [np.full(len(ids), -1, np.int64) for _ in range(2)]
        for f, i in ids.items():
            for table, kind in zip(self.several, (TWO, FOUR), strict=True):
                if f[0] == ONE:
                    table[i] = names.get(kind + f[1:], -1)

        heads = {f[1 : 1 + BEGINNINGS[0]] for f in ids if f[0] == ONE}

        def encode(words: list[bytes]) -> list[list[int]]:
            return [_known(w.decode("utf-8", "replace")) for w in words]

        def _known(word: str) -> list[int]:
            if len(word) <= LONG:
                return [ids[f] for f in features_of(word) if f in ids]
            k = BEGINNINGS[0]
            at = [i for i in range(len(word) - k + 1) if word[i : i + k] in heads]
            return list({ids[f]: 0 for i in at for f in features_of(word[i : i + BEGINNINGS[-1]]) if f[0] == ONE and f in ids})

        self.cache = bpe.WordCache(encode)

    def present(self, raw: list[bytes]) -> list[np.ndarray]:
        """Distinct features of each text."""
        words = bpe.split_bytes(_lower(raw), bpe.word_starts, drop_space=True)
        if not len(words.codes):
            return [np.zeros(0, np.int64)] * len(raw)
        flat, start, size = self.cache.spans(words)
        cut, out = np.concatenate([[0], np.cumsum(words.counts)]).tolist(), []
        useful = size > 0
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            codes = words.codes[a:b]
            own = np.unique(codes[useful[codes]])
            ids, counts = np.unique(bpe.ragged_take(flat, start, size, own)[0], return_counts=True)
            more = [table[ids[counts >= n]] for table, n in zip(self.several, (2, 4), strict=True)]
            every = np.concatenate([ids, *more])
            out.append(np.unique(every[(every >= 0) & (every < self.n)]))
        return out


@dataclass
class LabelModel:
    """Votes are 1 (toxic), -1 (clean) or 0 (none); voters may be correlated.

    Expectation and maximisation over the two classes.  Voters that vote almost alike
    count as correlated from the start; after a first fit also those whose votes go
    together beyond what the class explains.  A voter's evidence is divided by the
    number of its correlated companions (itself included), and the model fitted again.
    """

    rounds: int = 30
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlated: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), bool))
    prior: float = 0.5

    def fit(self, votes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """votes: texts x voters; start: first guess of each text's probability.  Returns posteriors."""
        seen = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(np.float64)
        x = votes - votes.mean(0)
        scale = np.sqrt(np.maximum((x * x).mean(0), 1e-12))
        self.correlated = np.abs(x.T @ x / len(x) / scale / scale[:, None]) > 0.9
        np.fill_diagonal(self.correlated, True)
        self.weight = 1.0 / self.correlated.sum(1)
        p = start
        for again in range(2):
            for _ in range(self.rounds):
                self.prior = float(np.clip(p.mean(), 1e-4, 1 - 1e-4))
                table = np.stack([np.einsum("n,nvk->vk", q, seen) for q in (1 - p, p)], 1) + 0.5
                self.accuracy = table / table.sum(2, keepdims=True)
                new = self.posterior(votes)
                done = np.abs(new - p).max() < 1e-6
                p = new
                if done:
                    break
            if not again:
                self._correlations(votes, p)
                self.weight = 1.0 / self.correlated.sum(1)
                p = self.posterior(votes)
        return p

    def _correlations(self, votes: np.ndarray, p: np.ndarray) -> None:
        x = votes.astype(np.float64)
        value = np.array([-1.0, 0.0, 1.0])
        mean = self.accuracy @ value  # voters x classes
        left = x - (1 - p)[:, None] * mean[:, 0] - p[:, None] * mean[:, 1]
        cov = left.T @ left / len(x)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        self.correlated |= np.abs(cov / scale / scale[:, None]) > 0.5
        np.fill_diagonal(self.correlated, True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.accuracy)
        gain = log[:, 1, :] - log[:, 0, :]
        z = np.log(self.prior / (1 - self.prior)) + (gain[np.arange(votes.shape[1]), votes + 1] * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def voters(rows: list[np.ndarray], kinds: np.ndarray, lift: np.ndarray, n: int) -> np.ndarray:
    """Votes of lexicons and patterns.

    A lexicon holds a share of the features of one kind (words, beginnings, beginnings of
    several words), the strongest ones dealt out in turn; it votes toxic on a hit.  Patterns:
    two features or more; three or more; a very strong one; a word together with its own
    beginning; and, for clean, no feature at all, and none of each kind.
    """
    order = np.argsort(-lift, kind="stable")
    share = np.zeros(len(kinds), np.int64)
    for kind in range(len(KINDS)):
        own = order[kinds[order] == kind]
        share[own] = kind * LEXICONS + np.arange(len(own)) % LEXICONS
    strong = lift >= np.quantile(lift, 0.5)
    votes = np.zeros((n, 4 * LEXICONS + 9), np.int8)
    for i, own in enumerate(rows):
        votes[i, share[own]] = 1
        by_kind = np.bincount(kinds[own], minlength=4)
        base = 4 * LEXICONS
        votes[i, base] = 1 if len(own) >= 2 else 0
        votes[i, base + 1] = 1 if len(own) >= 3 else 0
        votes[i, base + 2] = 1 if strong[own].any() else 0
        votes[i, base + 3] = 1 if by_kind[0] and by_kind[1:].any() else 0
        votes[i, base + 4] = -1 if not len(own) else 0
        votes[i, base + 5 : base + 9] = np.where(by_kind == 0, -1, 0)
    return votes


def fit_linear(rows: list[np.ndarray], target: np.ndarray, n_features: int, penalty: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a penalty on absolute weights, by accelerated proximal gradient.
    Features are present or not.  Weights of absent evidence are never negative, so no word makes a text clean."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(rows)), sizes)
    w, b = np.zeros(n_features), -1.0
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (1 + float(np.mean(sizes)) + float(np.max(sizes, initial=0)) ** 0.5)
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
    for _ in range(steps):
        z = np.bincount(line, v[cols], len(rows)) + c
        error = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        new_w = np.maximum(v - step * (np.bincount(cols, error[line], n_features) + penalty), 0)
        new_b = c - step * float(error.sum())
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, own: np.ndarray) -> float:
        z = self.bias + float(self.weights[own].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _share(wanted: int, there: int, *columns: str):
    """Condition that about wanted of there rows meet, by a hash of columns; all do if they aren't more."""
    whole = 1 << 40
    return F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(whole)) < max(1, min(whole, int(wanted / max(there, 1) * whole)))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """doc_id, text, toxic of about sample_rows labelled rows at most, none held out, written to the shared folder.
    Several labels of a doc_id: the highest counts.  Several rows of a doc_id: those with equal texts are one."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = known.where(_share(sample_rows, known.count(), "doc_id"))
    # about sample_rows rows of two numbers: small enough to send to every task at any size of the input
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.withColumn("seal", F.md5(F.coalesce("text", F.lit(""))))
    first, path = stored(rows.groupBy("doc_id", "seal").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    there = first.count()
    return (first if there <= 1.2 * sample_rows else first.where(_share(sample_rows, there, "doc_id", "seal"))), path


def _counts(batches):
    """Toxic and clean rows that have each feature, by batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(part.column("toxic").to_pylist(), octets(part, "text"), strict=True):
                words = [w.decode("utf-8", "replace") for w in bpe.split_bytes(_lower([text]), bpe.word_starts, drop_space=True).distinct()]
                counts[toxic != 1].update(_features([w for w in words if len(w) <= PIECE]))
                for w in words:  # a run of a million characters is several holders of its beginnings
                    for i in range(0, len(w) if len(w) > PIECE else 0, PIECE):
                        counts[toxic != 1].update(_features([w[i : i + PIECE + BEGINNINGS[-1]]]))
            names = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(names), 100_000):
                own = names[i : i + 100_000]
                yield pa.RecordBatch.from_pydict(
                    {"feature": pa.array(own, pa.string()), "n_toxic": pa.array([counts[0][f] for f in own], pa.int64()), "n_clean": pa.array([counts[1][f] for f in own], pa.int64())}
                )


def _telling(rows: DataFrame) -> list[str]:
    """Features that enough toxic rows have and few clean ones: only these come to the driver."""
    toxic, every = rows.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    if not toxic or toxic == every:
        return []
    counted = rows.select("text", "toxic").mapInArrow(_counts, "feature string, n_toxic long, n_clean long")
    counted = counted.groupBy("feature").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"))
    lift = (F.col("t") + 0.5) / (F.col("c") + 0.5) * ((every - toxic + 1) / (toxic + 1))
    enough, path = stored(counted.where(F.col("t") >= min(MIN_TOXIC, max(2, toxic // 4))).withColumn("lift", lift), "features")
    found = enough.where(F.col("lift") >= ROUGH_LIFT).orderBy(F.desc("t"), "feature").collect() or enough.orderBy(F.desc("lift"), "feature").limit(1).collect()
    remove(rows.sparkSession, path)
    return [r["feature"] for r in found]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits all parts on the sample.  The driver gets telling features and for each sampled row the
    numbers of those it holds: bounded by sample_rows."""
    rows, path = training_rows(docs, labels, sample_rows)
    found = _telling(rows)
    names = {f: i for i, f in enumerate(found)}

    def held(batches):
        finder = Finder(names)
        for batch in batches:
            raw = octets(batch, "text")
            for i, j in parts(raw, bpe.BLOCK_BYTES):
                own = finder.present(raw[i:j])
                copy = [x[:COPY_PAIRS].tobytes() for x in near_dup.shingle_sets(raw[i:j], 2)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "toxic": batch.column("toxic").slice(i, j - i).cast(pa.int32()),
                        "own": pa.array([x.astype("<i4").tobytes() for x in own], pa.binary()),
                        "copy": pa.array(copy, pa.binary()),
                    }
                )

    sample = rows.select("doc_id", "text", "toxic").mapInArrow(held, "doc_id long, toxic int, own binary, copy binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["own"], r["copy"]))
    remove(docs.sparkSession, path)
    toxic = np.array([r["toxic"] == 1 for r in sample], bool)
    if not toxic.any() or toxic.all() or not found:
        return Model({}, np.zeros(0), float(np.log(max(toxic.mean() if len(toxic) else 0, 1e-9) / max(1 - (toxic.mean() if len(toxic) else 0), 1e-9))))
    own = [np.frombuffer(r["own"], "<i4") for r in sample]
    # near copies of one text would make each of its words look toxic: rows with the same smallest pairs of words count once
    seen, side, by_side = set(), [0, 0], np.zeros((2, len(found)), np.int64)
    for t, x, r in zip(toxic.tolist(), own, sample, strict=True):
        if (name := (t, bytes(r["copy"]))) not in seen:
            seen.add(name)
            side[not t] += 1
            by_side[int(not t), x] += 1  # a row's features are distinct
    n_toxic, n_clean = by_side
    lift = (n_toxic + 0.5) / (n_clean + 0.5) * ((side[1] + 1) / (side[0] + 1))
    good = np.flatnonzero((n_toxic >= min(MIN_TOXIC, max(2, side[0] // 4))) & (lift >= MIN_LIFT))
    good = good[np.lexsort((good, -n_toxic[good]))]
    kind_of = np.array([KINDS.index(f[0]) for f in found], np.int64)
    good = np.concatenate([g[_needed(own, toxic, g)] for g in (good[kind_of[good] == k] for k in range(1 + len(BEGINNINGS)))])
    if not len(good):
        good = np.array([int(np.argmax(lift))])
    place = np.full(len(found), -1, np.int64)
    place[good] = np.arange(len(good))
    rows_of = [p[p >= 0] for p in (place[x] for x in own)]
    votes = voters(rows_of, kind_of[good], lift[good], len(rows_of))
    votes = votes[:, np.any(votes != 0, 0)]
    # the first guess is the voters' majority; labels only say which side is which
    guess = np.clip(0.5 + 0.1 * votes.astype(np.int64).sum(1), 0.02, 0.98)
    posterior = LabelModel().fit(votes, guess)
    if posterior[toxic].mean() < posterior[~toxic].mean():
        posterior = 1 - posterior
    weights, bias = fit_linear(rows_of, posterior, len(good))
    z = np.array([weights[x].sum() for x in rows_of]) + bias
    bias -= _cut(z, toxic)
    return Model({found[g]: i for i, g in enumerate(good)}, weights, bias)


def _cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """A point in the gap (a third of the way up) that parts the sample's toxic rows from its clean ones with the fewest errors."""
    order = np.argsort(z, kind="stable")
    z, mark = z[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(mark)]) + np.concatenate([[0], np.cumsum(~mark[::-1])])[::-1]
    errors[1:-1] += (z[1:] == z[:-1]) * len(z)  # no cut between equal scores
    errors[0] += len(z)
    k = int(np.argmin(errors))
    return float((2 * z[k - 1] + z[min(k, len(z) - 1)]) / 3)


def _needed(own: list[np.ndarray], toxic: np.ndarray, good: np.ndarray, least: int = 3) -> np.ndarray:
    """Greedy cover by features of one kind, the most frequent first, that find at least `least` toxic rows not found twice before.
    Words that merely stand beside others in copies of a text add nothing and stay out."""
    place = {int(g): i for i, g in enumerate(good)}
    holders: list[list[int]] = [[] for _ in good]
    for row in np.flatnonzero(toxic).tolist():
        for f in own[row].tolist():
            if f in place:
                holders[place[f]].append(row)
    times = np.zeros(len(own), np.int64)
    keep = []
    for i, rows in enumerate(holders):
        fresh = [r for r in rows if times[r] < 2]
        if len(fresh) >= least:
            keep.append(i)
            times[rows] += 1
    return np.array(keep, np.int64)


def score(docs: DataFrame, model: Model, into: str = "__score") -> DataFrame:
    """All rows and columns of docs, and the score in a column named into."""
    docs = without(docs, into)
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))

    def run(batches):
        own_model = Model(*shared.value)
        finder = Finder(own_model.names)
        for batch in batches:
            raw = [x or b"" for x in batch.column(text_at).cast(pa.binary()).to_pylist()]
            scores = []
            for i, j in parts(raw, bpe.BLOCK_BYTES):
                scores += [own_model.score(x) for x in finder.present(raw[i:j])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    schema = with_columns(docs.schema, **{into: "double"})
    names = schema.fieldNames()
    return map_columns(docs, run, schema)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
