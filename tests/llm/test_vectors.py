"""Hard negatives and whitening against plain brute force, and odd rows of both."""

import numpy as np
import pytest

from vellumspark.llm import hardneg, whitening

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<float>, label int, score long, v string, k int"


def negatives(rows):
    """rows: (id, whole vector, label). Every anchor against every row, by plain integers."""
    out = []
    for a, q, y in rows:
        if a % 100:
            continue
        own = sorted((-int(sum(int(c) * int(d) for c, d in zip(q, x, strict=True))), i, z) for i, x, z in rows if i != a and len(x) == len(q))
        for s, i, _ in [r for r in own if r[2] == y][:5]:
            fit = [r for r in own if r[2] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def scaled(v, by):
    return [int(np.floor(by * float(c))) for c in v]


def test_hard_negatives_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = negatives([(r.vec_id, scaled(r.embedding, 256), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows])
    got = hardneg.op12_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


@pytest.mark.parametrize("cell, block", [(4, 3), (256, 4096)])
def test_hard_negatives_of_clusters(spark, monkeypatch, cell, block):
    """Tight clusters of all lengths, where cells are left out by their angles, with ties, zero vectors and negative scores."""
    monkeypatch.setattr(hardneg, "CELL", cell)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=5) * 0.02).tolist(), int(rng.integers(3))) for i in range(900)]
    rows += [(1000 + i, rows[i * 3][1], rows[i * 5][2]) for i in range(120)] + [(1200 + i, [0.0] * 5, i % 3) for i in range(6)] + [(1300 + i, [float(i), 1.0], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = hardneg.mine(spark, df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == negatives([(i, scaled(v, 256), y) for i, v, y in rows])


def test_bounds_hold_all_cosines():
    rng = np.random.default_rng(1)
    refs = hardneg.directions(rng.normal(size=(50, 4)), 6)
    a, b = rng.normal(size=(40, 4)), np.concatenate([rng.normal(size=(40, 4)), refs, -refs])
    (_, ta), (_, tb) = hardneg.polar(a, refs), hardneg.polar(b, refs)
    cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    for r in range(len(refs)):
        lo, hi = hardneg.bounds(ta[:, r][:, None], tb[:, r][None, :], tb[:, r][None, :])
        assert (lo <= cos).all() and (cos <= hi).all()


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.25, 0.0], 2), (2, [0.25, 0.0], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, [None, 1.0], 2), (6, None, 2), (7, [0.3, 0.0], None), (None, [0.3, 0.0], 2), (200, [], 1), (8, [], 2), (300, [0.3, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROW)
    got = hardneg.mine(spark, df, df.where("vec_id % 100 = 0")).collect()
    # the repeated anchor counts once, the repeated candidate twice
    assert sorted(map(tuple, got)) == [(100, 1, 1, 2, 256 * 128, 256 * 64), (100, 1, 2, 2, 256 * 128, 256 * 64)]
    assert hardneg.mine(spark, df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(100, [1e30], 1), (1, [1e30], 1), (2, [1e9], 2), (3, [1e16], 2)], "vec_id long, embedding array<double>, label int")
    assert [(r.negative_id, r.positive_score) for r in hardneg.mine(spark, big, big.where("vec_id = 100")).collect()] == []


def whitened(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (n * u - s) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    at = np.argsort(-e)[:16]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ w[:, at] / np.sqrt(e[at]), e[at] / e.sum()


def test_whitening_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    n, deviation, want, share = whitened(np.array([scaled(r.embedding, 64) for r in rows]) + 1_000_000)
    got = whitening.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.vec_id.tolist() == [r.vec_id for r in rows for _ in range(16)] and got.component.tolist() == list(range(1, 17)) * len(rows)
    z = got.whitened.to_numpy().reshape(-1, 16)
    assert np.allclose(z * np.sign((z * want).sum(axis=0)), want, atol=1e-9)
    assert (got.n == n).all() and got.deviation.tolist() == np.repeat(deviation, 16).tolist()
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), share, rtol=1e-9) and got.identity_error.max() < 1e-9


def test_whitening_over_several_blocks(spark, monkeypatch):
    """Copies weigh once in the fit, come out each time, and lie in blocks of their own."""
    monkeypatch.setattr(whitening, "BLOCK", 60)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5] + 9
    v[50:120] = v[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(7)
    n, deviation, want, share = whitened(np.floor(64 * v).astype(np.int64) + 1_000_000)
    got = sorted(whitening.whiten(spark, df, 4).collect(), key=lambda r: r.id)
    z = np.array([r.whitened for r in got])
    assert [r.id for r in got] == list(range(200)) and [r.deviation for r in got] == deviation.tolist() and {r.n for r in got} == {n}
    assert np.allclose(z * np.sign((z * want[:, :4]).sum(axis=0)), want[:, :4], atol=1e-9) and np.allclose(got[0].explained, share[:4])


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.0, 7.5]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [None, 1.0]), (6, None), (7, []), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], ROW)
    got = whitening.whiten(spark, df).collect()
    assert sorted(r.id for r in got if r.id) == [1, 1, 2] and len(got) == 4 and {(r.n, len(r.whitened)) for r in got} == {(3, 2)}
    assert whitening.whiten(spark, df.limit(0)).count() == 0
    assert whitening.whiten(spark, df.where("vec_id = 1")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {len(r.whitened) for r in whitening.whiten(spark, line).collect()} == {1}
    far = whitening.whiten(spark, spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r.identity_error < 1e-9 for r in far) and {r.deviation for r in far if r.id == 3} == {0} and {r.deviation for r in far if r.id == 1} == {None}
