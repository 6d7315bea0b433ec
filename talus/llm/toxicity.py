"""Toxicity by non-negative positive-unlabelled learning of numpy classifiers.

Confirmed toxic rows are the positives; the unlabelled text is a sample of all training rows,
whatever their labels say. The risk is  pi*E_p[l(+f)] + max(0, E_u[l(-f)] - pi*E_p[l(-f)])  with the
logistic loss; where the second term is negative, the step goes up that term instead.
Features are a text's distinct words and their first four to six characters, hashed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.text import CACHE_WORDS, binary, mix, slices
from talus.runtime import stage

#: Hashed features.
BITS = 20
#: Bounds of the rows that the classifiers are fitted on, unless given, and the share of the unlabelled ones that each classifier gets.
MAX_POSITIVE, MAX_UNLABELLED, MEMBER_SHARE = 3000, 6000, 0.5
#: What a feature needs to take part, and the shrinkage of a step.
MIN_SHARE, MIN_LIFT, MIN_SIGMAS, SHRINK = 0.02, 3.0, 6.0, 0.003
#: The loss is flat above this margin: a prior that is a little off then can't outweigh the clean rows.
CEILING = 4.0
STRIP = b".,;:!?()[]{}<>\"'|*_-"
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)


def word_features(word: bytes) -> list[int]:
    word = word.strip(STRIP)
    if not word:
        return []
    keys = [b"w" + word]
    if len(word) > 3:
        text = word.decode("utf-8", "ignore")
        keys += [b"%d" % n + text[:n].encode() for n in PREFIXES if len(text) >= n]
    return [zlib.crc32(k) & ((1 << BITS) - 1) for k in keys]


def text_features(text: bytes | None) -> np.ndarray:
    """Feature ids, one entry for each distinct word that has the feature."""
    out: list[int] = []
    for word in set((text or b"").lower().split()):
        out += word_features(word)
    return np.array(out, np.uint32)


def signature(text: bytes | None, bands: int = 24, width: int = 2) -> np.ndarray:
    """Keys of the text's two-word shingles by bands of least hashes: copies, even much edited, share one."""
    words = (text or b"").lower().split()
    pairs = {zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])} or {zlib.crc32(b" ".join(words))}
    x = np.fromiter(pairs, np.uint64, len(pairs))
    least = np.array([mix(x ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)).min() for k in range(1, bands * width + 1)]).reshape(bands, width)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64)
        for k in range(width):
            key = mix(key ^ least[:, k])
    return key


def distinct_rows(signatures: list[np.ndarray]) -> list[int]:
    """The positions of the rows that share no key with an earlier one: copies count once."""
    seen: set[int] = set()
    out = []
    for i, keys in enumerate(s.tolist() for s in signatures):
        if seen.isdisjoint(keys):
            out.append(i)
        seen.update(keys)
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, of 1 << BITS
    bias: float
    prior: float
    positives: int


def speaking(toxic: np.ndarray, other: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The features that may speak for the positive class, of those in so many positive and unlabelled rows.

    Such a feature is in three of the positive rows and MIN_SHARE of them, MIN_LIFT times as
    frequent there as in unlabelled text and by MIN_SIGMAS standard deviations more often than
    chance would have it.
    """
    expected = np.maximum(0.5, n_p * (other + 1) / (n_u + 1))
    often = (toxic >= max(min(3, n_p), MIN_SHARE * n_p)) & (toxic - expected >= MIN_SIGMAS * np.sqrt(expected))
    return np.flatnonzero(often & (toxic >= MIN_LIFT * expected))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, members: int = 3, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Mean weights and bias of `members` linear classifiers, each fitted on the positive rows and MEMBER_SHARE of the unlabelled ones.

    Features that don't speak for the positive class have the weight 0. Weights are held at 0
    or more, so that no harmless word, however often it occurs, hides a toxic one.
    """
    size = 1 << BITS
    weights, bias = np.zeros(size, np.float64), 0.0
    if not positive.any() or positive.all():
        return weights.astype(np.float32), -4.0 if not positive.any() else 0.0
    seen = {True: np.zeros(size), False: np.zeros(size)}
    for r, p in zip(rows, positive):
        seen[bool(p)][np.unique(r)] += 1
    known = speaking(seen[True], seen[False], int(positive.sum()), int((~positive).sum()))
    to = np.full(size, -1, np.int64)
    to[known] = np.arange(len(known))
    kept = [to[r][to[r] >= 0] for r in rows]
    for seed in range(members):
        rng = np.random.default_rng(seed)
        chosen = np.flatnonzero(positive | (rng.random(len(rows)) < MEMBER_SHARE))
        y, each = positive[chosen], [kept[i] for i in chosen]
        counts = np.array([len(x) for x in each])
        flat, owner = (np.concatenate(each) if len(each) else np.zeros(0, np.int64)), np.repeat(np.arange(len(each)), counts)
        n_p, n_u = max(1, y.sum()), max(1, (~y).sum())
        w, b = np.zeros(len(known)), -2.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, rounds + 1):
            f = np.bincount(owner, w[flat], len(each)) + b
            over = f > CEILING
            f = np.minimum(f, CEILING)
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            plus, minus = np.logaddexp(0, -f), np.logaddexp(0, f)
            negative_risk = minus[~y].sum() / n_u - prior * minus[y].sum() / n_p
            g = np.zeros(len(each))
            if negative_risk >= 0:
                g[y] = prior / n_p * ((p[y] - 1) - p[y])
                g[~y] = p[~y] / n_u
            else:
                g[y], g[~y] = prior / n_p * p[y], -p[~y] / n_u
            g[over] = 0.0
            gw, gb = np.bincount(flat, g[owner], len(known)), g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            rate = 0.15
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
            w = np.maximum(w - SHRINK, 0)
            b = min(b, float(np.log(prior / (1 - prior))))  # without evidence a text is toxic with the prior at most
        weights[known] += w / members
        bias += b / members
    return weights.astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel:
    """Fit on rows whose crc32(doc_id as text) mod fold is not held, at most max_positive confirmed
    toxic and max_unlabelled other ones, chosen by a hash of the id.

    The class prior is the toxic share of the training labels, between 0.005 and 0.5. An id is
    toxic if any of its labels says so; all rows of a chosen id take part, up to the same bounds
    in all, but copies, edited ones too, count once. Null ids and labels are left out; null and empty texts have no
    features; texts are read whole. Without toxic labels nothing is predicted toxic; an empty
    table gives such a model too. Columns but doc_id, text and toxic are ignored.
    """
    fit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != held
    order = F.xxhash64("doc_id", F.lit(17))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & fit)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    prior = min(0.5, max(0.005, share.p / share.n if share.n else 0.05))
    toxic = marks.where("toxic = 1").select("doc_id")
    some = docs.where(F.col("doc_id").isNotNull() & fit).select("doc_id")
    ids = toxic.orderBy(order, "doc_id").limit(max_positive).withColumn("positive", F.lit(True)).unionByName(
        some.distinct().orderBy(order, "doc_id").limit(max_unlabelled).withColumn("positive", F.lit(False))
    )  # unlabelled text is a sample of all text, so some ids may be in both

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = binary(batch.column("text"))
            found = [pa.array([f(t).tobytes() for t in texts], pa.binary()) for f in (text_features, signature)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), *found], ["doc_id", "positive", "features", "signature"])

    # at most max_positive + max_unlabelled ids, and as many rows: of an id that repeats, equal texts are one row
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    keyed = chosen.withColumn("t", F.xxhash64("text"))
    pairs = keyed.select("doc_id", "positive", "t").distinct()
    picked = [pairs.where(side).orderBy(order, "doc_id", "t").limit(n) for side, n in (("positive", max_positive), ("NOT positive", max_unlabelled))]
    rows = keyed.join(F.broadcast(picked[0].unionByName(picked[1])), ["doc_id", "positive", "t"]).groupBy("doc_id", "positive", "t").agg(F.first("text").alias("text"))
    made = stage(rows.select("doc_id", "positive", "text").mapInArrow(features, "doc_id long, positive boolean, features binary, signature binary").withColumn("key", F.xxhash64("doc_id", "positive", "features")), "tox-rows")
    signed = sorted(made.select("doc_id", "positive", "key", "signature").collect(), key=lambda r: (r.doc_id, r.key))
    sides = [[r for r in signed if r.positive == side] for side in (True, False)]
    kept = {(r.positive, r.key) for side in sides for r in (side[k] for k in distinct_rows([np.frombuffer(r.signature, np.uint64) for r in side]))}
    n_p, n_u = sum(p for p, _ in kept), sum(not p for p, _ in kept)
    short: list[tuple[bool, int, np.ndarray]] = []
    if n_p and n_u:
        # which features may speak is found by Spark; whole texts' features never come to the driver
        speaks = np.zeros(1 << BITS, bool)
        speaks[_speaking_of(made, kept, n_p, n_u)] = True
        short = _short_rows(made, kept, speaks)
    elif kept:
        short = [(p, key, np.zeros(0, np.uint32)) for p, key in sorted(kept, key=lambda r: (not r[0], r[1]))]
    weights, bias = fit_nnpu([x for _, _, x in short], np.array([p for p, _, _ in short], bool), prior)
    return ToxicityModel(weights, bias, prior, n_p)


def _speaking_of(made: DataFrame, kept: set[tuple[bool, int]], n_p: int, n_u: int) -> np.ndarray:
    """The features that may speak for the positive class, from counts that the tasks sum up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, 1 << BITS), np.int32), set()
        for batch in batches:
            for p, key, x in zip(*(batch.column(c).to_pylist() for c in ("positive", "key", "features"))):
                if (p, key) in kept and (p, key) not in seen:
                    seen.add((p, key))
                    counts[int(p)][np.unique(np.frombuffer(x, np.uint32))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[1][at]), pa.array(counts[0][at])], ["feature", "toxic", "other"])

    sums = made.select("positive", "key", "features").mapInArrow(run, "feature int, toxic int, other int").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # a first cut by Spark, so that few come to the driver; the rule itself is speaking()
    some = sums.where(F.col("toxic") >= min(3, n_p)).where(F.col("toxic") >= MIN_SHARE * n_p).collect()
    toxic, other = (np.array([r[c] for r in some], np.float64) for c in ("toxic", "other"))
    return np.array([r.feature for r in some], np.int64)[speaking(toxic, other, n_p, n_u)]


def _short_rows(made: DataFrame, kept: set[tuple[bool, int]], speaks: np.ndarray) -> list[tuple[bool, int, np.ndarray]]:
    """(positive, key, features that speak) of the kept rows, in a fixed order."""
    known = np.flatnonzero(speaks).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.uint32) for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("key"), pa.array([x[np.isin(x, known)].tobytes() for x in found], pa.binary())], ["positive", "key", "features"])

    rows = {(r.positive, r.key): np.frombuffer(r.features, np.uint32) for r in made.select("positive", "key", "features").mapInArrow(run, "positive boolean, key long, features binary").toLocalIterator() if (r.positive, r.key) in kept}
    return [(p, key, rows[p, key]) for p, key in sorted(rows, key=lambda r: (not r[0], r[1]))]


class _Scorer(dict):
    """word -> the sum of its features' weights."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = word_features(word)
        found = self[word] = float(self.weights[ids].sum()) if ids else 0.0
        return found


def scores(spark, model: ToxicityModel):
    """A function from a list of UTF-8 texts to their scores, for use in tasks; the model is 1 << BITS floats."""
    kept = np.flatnonzero(model.weights).astype(np.uint32)
    shared = spark.sparkContext.broadcast((kept, model.weights[kept]))
    bias = model.bias

    def make():
        kept, values = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[kept] = values
        table = _Scorer(weights)

        def run(texts: list[bytes | None]) -> np.ndarray:
            get = table.__getitem__
            f = np.array([sum(map(get, sorted(set((t or b"").lower().split())))) for t in texts], np.float64) + bias
            return 1 / (1 + np.exp(-np.clip(f, -500, 500)))

        return run

    return make


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts get the score of no words.

    Repeated rows are scored one by one; labels, language and source are not read.
    """
    make = scores(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches, "text"):
            s = f(binary(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    make = scores(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(f(binary(batch.column("text"))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
