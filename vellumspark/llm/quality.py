"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear hinge-loss model.

The model is fitted on the driver from a bounded sample of labelled rows and scores every text on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read

#: Labelled rows of each class that training uses at most, those with the smallest hash of their id.
TRAIN_ROWS = 4000
DIMS = 1 << 20
THRESHOLD = 0.7
MEMO = 200_000

PIECES = re.compile(r"[^\W_]+|[\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


class Hashes(dict):
    """A word's number, and by number the hashes of the word in lower case and of its outline; filled on first use."""

    def __init__(self):
        super().__init__()
        self.word, self.outline = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n == len(self.word):
            self.word, self.outline = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.outline))
        self.word[n], self.outline[n] = _hash(word.lower()), _hash("/" + shape(word))
        return n


def shape(word: str) -> str:
    """A word's outline: runs of letters as x, X or Xx, of digits as 0, and other signs as they are, three at most."""
    out = []
    for p in PIECES.findall(word):
        if p[0].isalnum():
            out.append("0" if p.isdigit() else "x" if p.islower() else "X" if p.isupper() and len(p) > 1 else "Xx" if p[0].isupper() else "m")
        else:
            out.append(p[:3])
    return "".join(out[:4])


class Grams:
    """The distinct n-gram indicators of a text, as numbers below DIMS.

    Words (alone and in pairs, lower case), word outlines (alone, in pairs and threes), and in steps of a tenth the
    share of words that equal the word 1 to 6 places back, and of distinct pairs of words.
    """

    def __init__(self):
        self.memo = Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        chunks = text.split() if text else []
        if not chunks:
            return np.array([_hash("empty") % DIMS], np.int64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        at = np.array(list(map(memo.__getitem__, chunks)), np.int64)
        w, s = memo.word[at], memo.outline[at]
        parts = [w, s]
        if len(w) > 1:
            two = _spread(w[:-1] * MIX + w[1:])
            parts += [two, _spread(s[:-1] * MIX + s[1:])]
            if len(w) > 2:
                parts.append(_spread((s[:-2] * MIX + s[1:-1]) * MIX + s[2:]))
            extra = [_hash(f"r{p}:{int(10 * np.mean(w[p:] == w[:-p]))}") for p in range(1, 7) if len(w) > p]
            extra.append(_hash(f"d:{int(10 * len(np.unique(two)) / len(two))}"))
            parts.append(np.array(extra, np.uint64))
        return np.unique((np.concatenate(parts) % np.uint64(DIMS)).astype(np.int64))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, grams: np.ndarray, norms: np.ndarray) -> float:
        """The decision value: the sum of weights over the length of the scaled indicator vector."""
        return float(self.weights[grams].sum() / (np.sqrt(norms[grams].sum()) + 1e-12) + self.bias)

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12) -> tuple[Model, np.ndarray]:
    """NB-SVM by dual coordinate descent, its margins calibrated on every fifth row, which the descent leaves out for that."""
    if len(rows) == 0 or y.min() == y.max():
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(DIMS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p)))), np.ones(DIMS, np.float32)
    held = np.arange(len(rows)) % 5 == 4
    if len(rows) < 50 or len(set(y[~held])) < 2:
        held[:] = False
    counts = [np.full(DIMS, alpha), np.full(DIMS, alpha)]
    for g, label in zip(rows, y, strict=True):
        counts[int(label)][g] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    length = [np.sqrt((ratio[g] ** 2).sum()) + 1e-12 for g in rows]
    # one dual variable for each row, the bias as one more feature of value 1; squared norms are 2 then
    w, b, dual = np.zeros(DIMS), 0.0, np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    n1, use = max(1, int((y[~held] > 0).sum())), np.flatnonzero(~held)
    upper = np.where(y > 0, cost * len(use) / (2 * n1), cost * len(use) / (2 * max(1, len(use) - n1)))
    rand = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rand.permutation(use):
            g = rows[i]
            x = ratio[g] / length[i]
            gradient = sign[i] * (w[g] @ x + b) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), upper[i])
            if (d := (new - dual[i]) * sign[i]) != 0:
                w[g] += d * x
                b += d
                dual[i] = new
    model, norms = Model((w * ratio).astype(np.float32), b, 1.0, 0.0), (ratio**2).astype(np.float32)
    at = np.flatnonzero(held) if held.any() else use
    m = np.array([model.margin(rows[i], norms) for i in at])
    t = y[at].astype(float)
    # weights bring the sample's classes to their shares among all labels
    weight = np.where(t > 0, prior / max(t.mean(), 1e-9), (1 - prior) / max(1 - t.mean(), 1e-9))
    n1, n0 = t.sum(), len(t) - t.sum()
    soft = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
        d, h = weight * (p - soft), weight * p * (1 - p) + 1e-9
        g = np.array([(d * m).sum() + 1e-3 * slope, d.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-7:
            break
    model.slope, model.offset = float(max(slope, 1e-3)), float(offset)
    return model, norms


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS):
    """A broadcast (model, norms) from at most `rows` labelled texts of each class outside the held-out rows.

    Labels without id or value are unused; an id with both labels counts as 0. Without any labelled text all scores are the
    share of label 1 (0.5 without labels). The sample is broadcast to find its texts: 2 * `rows` ids.
    """
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).where(F.col("lid").isNotNull() & F.col("y").isin(0, 1) & ~held_out("lid")).groupBy("lid").agg(F.min("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    picked = None
    for c in (0, 1):
        one = known.where(F.col("y") == c).orderBy(F.xxhash64("lid"), "lid").limit(rows)
        picked = one if picked is None else picked.union(one)
    texts = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(picked), "lid").select("lid", "y", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grams()
        for batch in batches:
            made = pa.array([g(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), made], names=["lid", "y", "g"])

    # an id may stand on several rows: one of them counts, whichever has the least indicators in byte order
    found = texts.mapInArrow(grams, "lid string, y int, g binary").groupBy("lid").agg(F.min("y").alias("y"), F.min("g").alias("g")).orderBy(F.xxhash64("lid"), "lid").toArrow().combine_chunks()
    g = found.column("g").combine_chunks() if found.num_rows else pa.array([], pa.binary())
    cuts = np.frombuffer(g.buffers()[1], np.int32, len(g) + 1, g.offset * 4) // 4 if len(g) else np.zeros(1, np.int32)
    flat = np.frombuffer(g.buffers()[2] or b"", "<i4") if len(g) else np.zeros(0, "<i4")
    rows_of = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # views of Arrow's own memory
    model = fit(rows_of, found.column("y").to_numpy() if found.num_rows else np.zeros(0, int), 0.5 if share is None else share)
    return spark.sparkContext.broadcast(model)


def score(df: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`df` with the probability of label 1 for each whole text; null and empty texts share one score of their own.

    Rows are kept one for one; a column that is already named `out` is replaced, all others are kept. No shuffle.
    """
    names = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, norms), g = model.value, Grams()
        for batch in batches:
            s = [m.probability(m.margin(g(t), norms)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with their columns."""
    prepare(spark)
    name = "_quality_score"
    return score(docs, train(spark, docs, labels), out=name).where(F.col(name) >= threshold).drop(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(spark, docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
