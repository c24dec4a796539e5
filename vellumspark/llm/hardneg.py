"""Hard negatives by angular triangle filtering.

Every row's angles to a few reference directions are stored with it. The angle between an anchor and a row lies between the difference and the
sum of their angles to any reference, so each reference gives an interval for the cosine; times both norms, with room for rounding, it bounds
the score. Rows go in cells of one nearest reference and similar angles: cells whose bounds miss all score windows of an anchor are left out
for it, then single rows, and what is left is scored as an integer inner product.

Two passes over the cells for each block of anchors: the best rows of an anchor's own label (its positives) set the windows of the second,
which looks for rows of other labels. The best rows known so far raise a window's lower end as a task goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, prepare, read
from .topk import finite

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Shares of the positive's score, in hundredths, between which a negative's score lies.
LOWEST, HIGHEST = 30, 90
#: Anchors that are answered together; they are broadcast, so this bounds what the driver and a task hold of them.
ANCHOR_BLOCK = 4096
#: Reference directions, drawn farthest first from SAMPLE rows, those with the smallest hashes of their ids.
REFERENCES, SAMPLE = 16, 2048
#: Rows of a cell, and doubles of vectors that a task sorts into cells at once (32 MB).
CELL, CHUNK = 256, 1 << 22
#: Room for rounding, in radians: an angle near 0 or pi is known to 1e-7 or so.
SLACK = 1e-6
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)


def directions(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors of a sample, each the one whose nearest of those before is farthest; the first is nearest the mean."""
    norms = np.linalg.norm(sample, axis=1)
    u = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(u):
        return np.zeros((0, sample.shape[1]))
    picked = [int(np.argmax(u @ u.mean(axis=0)))]
    near = u @ u[picked[0]]
    while len(picked) < most and near.min() < 1 - 1e-9:
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, u @ u[picked[-1]])
    return u[picked]


def polar(m: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows and their angles to the references; a zero row is at a right angle to all."""
    size = np.sqrt((m * m).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        cos = (m / size[:, None]) @ refs.T
    return size, np.arccos(np.clip(np.nan_to_num(cos), -1.0, 1.0))


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest cosine of an angle between anchors at `a` and rows at `lo` to `hi` from a reference."""
    least = np.maximum(np.maximum(a - hi, lo - a), 0.0) - SLACK
    over = np.where(a + hi <= np.pi, a + hi, np.where(a + lo >= np.pi, 2 * np.pi - a - lo, np.pi)) + SLACK
    return np.cos(np.minimum(over, np.pi)), np.cos(np.maximum(least, 0.0))


def cells(vectors: DataFrame, refs: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of rows near each other: dim, ref (nearest reference), ids, labels, m (whole doubles), theta (angles to all references)."""

    def cut(dim: int, ids: list[np.ndarray], labels: list[np.ndarray], parts: list[np.ndarray]):
        i, y, m = np.concatenate(ids), np.concatenate(labels), np.concatenate(parts)
        _, theta = polar(m, refs.get(dim, np.zeros((0, dim))))
        near = theta.argmin(axis=1) if theta.shape[1] else np.zeros(len(i), np.int64)
        own = theta[np.arange(len(i)), near] if theta.shape[1] else np.zeros(len(i))
        order = np.lexsort((own, near))
        ends = [*np.flatnonzero(np.diff(near[order])) + 1, len(order)]
        at = 0
        for end in ends:
            for k in range(at, end, CELL):
                o = order[k : min(end, k + CELL)]
                yield dim, int(near[o[0]]), i[o].astype("<i8").tobytes(), y[o].astype("<i8").tobytes(), m[o].astype("<f8").tobytes(), theta[o].astype("<f8").tobytes()
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, labels, parts, _ = held.pop(dim)
            cols = list(zip(*cut(dim, ids, labels, parts), strict=True))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dim", "ref", "ids", "labels", "m", "theta"])

        for batch in batches:
            ids, labels, lists = (batch.column(k) for k in range(3))
            ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                m = flat[(offsets[at][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(at), dim)
                own = held.setdefault(dim, [[], [], [], 0])
                own[0].append(ids[at])
                own[1].append(labels[at])
                own[2].append(m)
                own[3] += len(at) * (dim + REFERENCES)
                if own[3] >= CHUNK:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, "dim int, ref int, ids binary, labels binary, m binary, theta binary")


class Anchors:
    """A block of anchors of any widths. windows: for each anchor, its (positive id, score, least, greatest score of a negative)."""

    def __init__(self, rows: list[tuple[int, int, list[float]]], refs: dict[int, np.ndarray]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.of = {}
        for dim in {len(r[2]) for r in rows}:
            at = np.array([i for i, r in enumerate(rows) if len(r[2]) == dim])
            m = np.array([rows[i][2] for i in at], np.float64).reshape(len(at), dim)
            self.of[dim] = (at, m, *polar(m, refs.get(dim, np.zeros((0, dim)))))
        self.lo = np.full((len(rows), 1), LOW, np.int64)
        self.hi = np.full((len(rows), 1), HIGH, np.int64)
        self.same = True

    def look_for_negatives(self, positives: dict[int, list[int]]) -> None:
        """Windows from each anchor's positive scores; one that no score can fall in is empty (lo above hi)."""
        self.same, self.lo, self.hi = False, np.full((len(self.ids), POSITIVES), 1, np.int64), np.zeros((len(self.ids), POSITIVES), np.int64)
        for i, a in enumerate(self.ids.tolist()):
            for j, p in enumerate(positives.get(a, [])):
                lo, hi = max(LOW, -(-LOWEST * p // 100)), min(HIGH, HIGHEST * p // 100)
                if lo <= hi:
                    self.lo[i, j], self.hi[i, j] = lo, hi


def _scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond a long, its nearest end."""
    if np.abs(m).max(initial=0) * np.abs(q).max(initial=0) * max(1, m.shape[1]) < EXACT:
        return (m @ q.T).astype(np.int64)
    wide, other = [[int(x) for x in r] for r in m], [[int(x) for x in r] for r in q]
    return np.array([[min(HIGH, max(LOW, sum(x * y for x, y in zip(r, v, strict=True)))) for v in other] for r in wide], np.int64).reshape(len(m), len(q))


def _search(shared, k: int):
    """For each task, (anchor, window, row, score): the k best rows of each window, ties to smaller ids; k for each of the anchors' windows at most."""

    def run(batches):
        a = shared.value
        n_windows = a.lo.shape[1]
        floor = a.lo.copy()  # a window's lowest score that can still be among its k best
        best_key, best_score, best_id = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for dim, ref, ids, labels, m, theta in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if dim not in a.of:
                    continue
                at, q, size_q, theta_q = a.of[dim]
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                m = np.frombuffer(m, "<f8").reshape(len(ids), dim)
                theta = np.frombuffer(theta, "<f8").reshape(len(ids), -1)
                size = np.sqrt((m * m).sum(axis=1))
                open_lo, open_hi = np.where(floor[at] <= a.hi[at], floor[at], HIGH).min(axis=1), np.where(floor[at] <= a.hi[at], a.hi[at], LOW).max(axis=1)
                live = open_lo <= open_hi
                if theta.shape[1]:
                    least, most = bounds(theta_q, theta.min(axis=0)[None, :], theta.max(axis=0)[None, :])
                    live &= _overlap(least.max(axis=1), most.min(axis=1), size_q * size.max(initial=0.0), open_lo, open_hi)
                col = np.flatnonzero(live)
                if not len(col):
                    continue
                match = labels[:, None] == a.labels[at[col]][None, :]
                match = (match if a.same else ~match) & (ids[:, None] != a.ids[at[col]][None, :])
                if theta.shape[1]:
                    least, most = bounds(theta_q[col, ref][None, :], theta[:, ref][:, None], theta[:, ref][:, None])
                    match &= _overlap(least, most, size[:, None] * size_q[col][None, :], open_lo[col][None, :], open_hi[col][None, :])
                row = np.flatnonzero(match.any(axis=1))
                if not len(row):
                    continue
                s, match = _scores(m[row], q[col]), match[row]
                found = []
                for j in range(n_windows):
                    r, c = np.nonzero(match & (s >= floor[at[col], j][None, :]) & (s <= a.hi[at[col], j][None, :]))
                    found.append((at[col[c]] * n_windows + j, s[r, c], ids[row[r]]))
                if not any(len(x[0]) for x in found):
                    continue
                key, score, who = (np.concatenate([old, *new]) for old, new in zip((best_key, best_score, best_id), zip(*found, strict=True), strict=True))
                o = np.lexsort((who, ~score, key))  # ~score falls as score rises, over the whole range of a long
                key, score, who = key[o], score[o], who[o]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                keep = rank < k
                last = rank == k - 1
                floor[key[last] // n_windows, key[last] % n_windows] = score[last]
                best_key, best_score, best_id = key[keep], score[keep], who[keep]
        out = [a.ids[best_key // n_windows], best_key % n_windows, best_id, best_score]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "w", "row_id", "score"])

    return run


def _overlap(least: np.ndarray, most: np.ndarray, norms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether score bounds, norms times a cosine interval with room for rounding, meet the window lo to hi."""
    room = norms * 1e-9 + 1.0
    return (np.where(most > 0, most, 0.0) * norms + room >= lo.astype(np.float64)) & (np.where(least < 0, least, 0.0) * norms - room <= hi.astype(np.float64))


def mine(spark: SparkSession, vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by integer inner products of floor(256 x).

    An anchor's positives are its POSITIVES best other rows of the same label; each gets its NEGATIVES best rows of another label whose score is
    LOWEST to HIGHEST hundredths of the positive's. Ties go to the smaller id; fewer are all given. Rows with a null id, label or vector, or
    null or non-finite components, take no part; rows of another width than the anchor's aren't its candidates; a row with an anchor's id
    isn't its candidate. Of anchors with one id, that of the least label and vector counts; repeated candidates count each time. Scores
    beyond a long count as its ends. Labels are whole numbers. Other columns are not read; empty tables and anchors without positives give no rows.
    Anchors go in blocks of ANCHOR_BLOCK, which are broadcast with POSITIVES scores each; a task returns k rows for each window of a block at most.
    """
    prepare(spark)
    scratch = Scratch(spark)

    def use(df: DataFrame) -> DataFrame:
        good = finite(df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v")))
        return good.where("id IS NOT NULL AND label IS NOT NULL").select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))

    rows = use(vectors)
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r.v), []).append(r.v)
    refs = {dim: directions(np.array(v, np.float64).reshape(len(v), dim)) for dim, v in sample.items()}
    packed = scratch.keep(cells(rows, refs))
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out, found = f"{scratch.base}/out", "anchor_id long, w long, row_id long, score long"
    spark.createDataFrame([], kind).write.parquet(out)

    def best(block: Anchors, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "row_id"))
        return packed.mapInArrow(_search(spark.sparkContext.broadcast(block), k), found).withColumn("rank", rank).where(F.col("rank") <= k)

    def answer(members: list) -> None:
        block = Anchors(members, refs)
        positives = best(block, POSITIVES).select("anchor_id", (F.col("rank") - 1).cast("long").alias("w"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")).collect()
        scores: dict[int, list[int]] = {}
        for r in sorted(positives, key=lambda r: r.w):
            scores.setdefault(r.anchor_id, []).append(r.positive_score)
        block.look_for_negatives(scores)
        of = spark.createDataFrame(positives, "anchor_id long, w long, positive_id long, positive_score long")
        got = best(block, NEGATIVES).join(F.broadcast(of), ["anchor_id", "w"])
        got.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)

    block: list = []
    for r in use(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).orderBy("id").toLocalIterator():
        block.append((r.id, r.r.label, r.r.v))
        if len(block) == ANCHOR_BLOCK:
            answer(block)
            block = []
    if block:
        answer(block)
    return spark.read.schema(kind).parquet(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label)
    return mine(spark, v, v.where(F.col("vec_id") % 100 == 0))
