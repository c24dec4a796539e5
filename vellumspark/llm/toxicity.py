"""Toxicity: vectors of character n-grams, averaged over words and texts, into a linear softmax; both are trained together in numpy.

A word's vector is the mean of the vectors of its n-grams (3 to 5 letters with the word's ends, and the whole word), a text's vector the mean
of its words', so a misspelling that training never saw shares most of its parts with the word it stands for. N-grams whose counts of
documents differ between the classes no more than by chance keep the vector 0: left in, their noise is learned by heart. With the weights
trained, a part counts by one number, its vector times the difference of the two classes' weights, which is what texts are scored with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, read

#: Labelled rows of each class that training uses at most, those with the smallest hash of their id.
TRAIN_ROWS = 4000
BUCKETS = 1 << 18
SHORTEST, LONGEST = 3, 5
#: An n-gram has a vector if the chi-square (with Yates' correction) of its documents by class is this or more; the TELLING highest at most.
CHI, TELLING = 16.0, 4096
#: Letters of a word; longer runs are several words.
WORD = 40
WIDTH = 4
THRESHOLD = 0.7
#: Words that a worker remembers.
MEMO = 200_000
#: A text's mean vector times this goes into the softmax, so that weights of usual size can see one word in fifty.
GAIN = 40.0
#: How probable a label must be under the calibration before it counts as half a slip.
LAPSE = 0.05

WORDS = re.compile(r"[^\W_]{1,%d}" % WORD)


def parts(word: str) -> list[int]:
    """The buckets of a word's n-grams and of the word itself; an n-gram that comes twice counts twice."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in [*grams, f"{marked}{marked}"]]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's mean vector as (buckets, shares): shares add up to 1 over all parts of all words; both are empty without words."""
    words = Counter(WORDS.findall(text.lower())) if text else Counter()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, share, total = [], [], sum(words.values())
    for w, n in words.items():
        p = parts(w)
        at += p
        share += [n / total / len(p)] * len(p)
    own, back = np.unique(np.array(at, np.int32), return_inverse=True)
    return own, np.bincount(back, share, len(own)).astype(np.float32)


def telling(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Chi-square of 2 x 2 tables: documents of each class with and without an n-gram."""
    d, n = (n0 + n1).astype(float), float(all0 + all1)
    expected = d * all1 / n
    apart = np.maximum(np.abs(n1 - expected) - 0.5, 0.0) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = apart * (1 / expected + 1 / (d - expected) + 1 / (all1 - expected) + 1 / (all0 - d + expected))
    return np.where(np.isfinite(chi), chi, 0.0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, mean: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (mean * GAIN + self.bias) + self.offset, -30, 30))))


class Words(dict):
    """The mean weight of a word's parts, worked out on first use."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        p = parts(word)
        v = self[word] = float(self.weights[p].sum() / len(p))
        return v

    def mean(self, text: str | None) -> float:
        found = WORDS.findall(text.lower()) if text else []
        return sum(map(self.__getitem__, found)) / len(found) if found else 0.0


def fit(own: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, epochs: int = 30, batch: int = 48, rate: float = 0.5, decay: float = 1e-3, seed: int = 1) -> Model:
    """Vectors of the buckets `own` and softmax weights by Adagrad on the cross-entropy, both classes weighed alike; calibrated on every fifth row, which training leaves out for that.

    bags: each text's positions in `own` and shares.
    """
    if len(y) == 0 or y.min() == y.max() or len(own) == 0:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))), 1.0, 0.0)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.05, (len(own), WIDTH)), rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    grown_e, grown_w = np.full_like(e, 1e-6), np.full_like(w, 1e-6)
    class_weight = len(use) / (2 * np.bincount(y[use], minlength=2))
    order, batches = rng.permutation(use), []
    for k in range(0, len(order), batch):
        at = order[k : k + batch]
        touched, back = np.unique(np.concatenate([bags[i][0] for i in at]), return_inverse=True)
        batches.append((at, np.repeat(np.arange(len(at)), [len(bags[i][0]) for i in at]), np.concatenate([bags[i][1] for i in at]) * GAIN, touched, back))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            at, text, share, touched, back = batches[k]
            v = e[touched]
            h = np.stack([np.bincount(text, share * v[back, c], len(at)) for c in range(WIDTH)], axis=1)
            logit = h @ w + b
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= (class_weight[y[at]] / len(at))[:, None]
            out = p @ w.T
            ge, gw = np.stack([np.bincount(back, share * out[text, c], len(touched)) for c in range(WIDTH)], axis=1) + decay * v, h.T @ p
            grown_e[touched] += ge * ge
            e[touched] -= rate * ge / np.sqrt(grown_e[touched])
            grown_w += gw * gw
            w -= 0.2 * rate * gw / np.sqrt(grown_w)
            b -= 0.1 * rate * p.sum(axis=0)
    each = e @ (w[:, 1] - w[:, 0])
    model = Model(np.zeros(BUCKETS, np.float32), float(b[1] - b[0]), 1.0, 0.0)
    model.weights[own] = each
    at = np.flatnonzero(held) if held.any() else use
    margin = np.array([float((each[bags[i][0]] * bags[i][1]).sum()) * GAIN + model.bias for i in at])
    model.slope, model.offset = calibrate(margin, y[at].astype(float), prior)
    return model


def calibrate(margin: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins by Newton steps; rows are weighed so that the classes have their shares among all labels.

    Labels that the curve finds all but impossible (below LAPSE) are taken as slips: they would flatten it for all others.
    """
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    n1, n0 = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(np.median(np.abs(margin))), 1e-6)
    m, theta, trust = margin / spread, np.array([1.0, 0.0]), np.ones(len(y))
    for _ in range(6):
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(theta[0] * m + theta[1], -30, 30)))
            d, h = trust * weight * (p - soft), trust * weight * p * (1 - p) + 1e-9
            gradient = np.array([(d * m).sum() + 1e-4 * theta[0], d.sum()])
            step = np.linalg.solve(np.array([[(h * m * m).sum() + 1e-4, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]]), gradient)
            theta -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-7:
                break
        p = 1 / (1 + np.exp(-np.clip(theta[0] * m + theta[1], -30, 30)))
        own = np.where(y > 0, p, 1 - p)
        trust = own / (own + LAPSE)
    return float(max(theta[0], 1e-3) / spread), float(theta[1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS):
    """A broadcast model from at most `rows` labelled texts of each class outside the held-out rows.

    Labels without id or value are unused; an id with both labels counts as 0. Without labelled texts of both classes all scores are the share
    of label 1 (0.5 without labels). The sample's ids are broadcast to find its texts; of rows with one id, one text counts. The n-grams'
    documents are counted by Spark; the driver sees the telling ones and, of them, each text's shares.
    """
    prepare(spark)
    scratch = Scratch(spark)
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).where(F.col("lid").isNotNull() & F.col("y").isin(0, 1) & ~held_out("lid")).groupBy("lid").agg(F.min("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    picked = None
    for c in (0, 1):
        one = known.where(F.col("y") == c).orderBy(F.xxhash64("lid"), "lid").limit(rows)
        picked = one if picked is None else picked.union(one)
    texts = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(picked), "lid").groupBy("lid").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    texts = scratch.keep(texts.select("lid", "y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                n[y, bag(t.as_py())[0]] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "n0", "n1"])

    size = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    all0, all1 = size.get(0, 0), size.get(1, 0)
    counts = texts.mapInArrow(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # a bucket in few documents can't reach CHI, so few rows come to the driver
    rare = counts.where(F.col("n0") * all1 != F.col("n1") * all0).where(F.col("n0") + F.col("n1") > 2).withColumn("d", F.abs(F.col("n1") * F.lit(all0) - F.col("n0") * F.lit(all1)) / F.sqrt((F.col("n0") + F.col("n1")).cast("double")))
    got = rare.orderBy(F.desc("d"), "bucket").limit(4 * TELLING).toPandas() if all0 and all1 else None
    own = np.zeros(0, np.int64)
    if got is not None and len(got):
        chi = telling(got.n0.to_numpy(), got.n1.to_numpy(), all0, all1)
        best = sorted((-c, b) for c, b in zip(chi.tolist(), got.bucket.tolist(), strict=True) if c >= CHI)[:TELLING]
        own = np.array(sorted(b for _, b in best), np.int64)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int32)
        number[own] = np.arange(len(own))
        for batch in batches:
            packed = []
            for t in batch.column(2):
                at, part = bag(t.as_py())
                keep = number[at] >= 0
                packed.append(number[at][keep].astype("<i4").tobytes() + part[keep].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(packed, pa.binary())], names=["lid", "y", "bag"])

    found = texts.mapInArrow(shares, "lid string, y int, bag binary").orderBy(F.xxhash64("lid"), "lid").collect()
    bags = [(np.frombuffer(r.bag, "<i4", len(r.bag) // 8), np.frombuffer(r.bag, "<f4", len(r.bag) // 8, len(r.bag) // 2)) for r in found]
    scratch.drop(texts)
    return spark.sparkContext.broadcast(fit(own, bags, np.array([r.y for r in found], np.int64), 0.5 if share is None else share))


def score(df: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`df` with the probability of label 1 for each whole text; null and empty texts and those without letters or digits share one score.

    Rows are kept one for one; a column that is already named `out` is replaced, all others are kept. No shuffle.
    """
    names = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known = Words(m.weights)
        for batch in batches:
            s = [m.probability(known.mean(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(spark, docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
