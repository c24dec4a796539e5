"""Connected components: chains, hubs, cycles, repeated and odd edges; and the tables that a run leaves."""

import os
import random

from vellumspark.llm import common, neardup


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(1000, k) for k in range(1001, 1600)] + [(2000, 2001), (2001, 2002), (2002, 2000)] + [(3, 3), (5, 4), (4, 5), (None, 7), (7, None)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    scratch = common.Scratch(spark)
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in up}
    assert common.components(spark, spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    assert len(scratch.live) == 2  # the results, and nothing of the rounds


def test_copies_and_repeated_ids(spark):
    """One row of a group stays; an id on two unlinked texts is judged text by text."""
    base = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, base), (1, base), (2, base + " x"), (2, other), (3, other + " y"), (4, None), (4, None), (5, ""), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_first(spark, docs).collect()), key=repr)
    assert kept == sorted([(1, base), (2, other), (4, None), (5, ""), (None, base)], key=repr)


def test_many_near_copies(spark):
    """A large group of near copies and documents that share one passage: the groups are found, and nothing else is linked."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(1500):
        w = list(base)
        w[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, " ".join(base[:12] + [f"y{k}_{j}" for j in range(60)])) for k in range(1500)]
    got = {r.id: r.component for r in neardup.link(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(1500)} == {0} and all(got[5000 + k] == 5000 + k for k in range(1500))
