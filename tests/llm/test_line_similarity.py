"""Line dedup against edit similarity alone."""

import random

from pyspark.sql import functions as F

from vellumspark.llm import linedup


def test_all_lines_of_similarity_are_found(spark):
    rng = random.Random(5)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(n)]
    pairs = []
    for n, k in ((5, 1), (9, 1), (10, 2), (18, 3), (20, 1), (20, 4), (50, 1), (50, 5), (78, 4)):
        for _ in range(5):
            a = fresh(n)
            b = list(a)
            for at in rng.sample(range(n), k):
                b[at] = "zz" + b[at]
            pairs.append((a, b))
    a = fresh(5)
    pairs.append((a, a[:2] + a[3:]))
    pairs.append((a[:2] + ["zzz"] + a[3:], a))
    apart = [fresh(20) for _ in range(3)]
    apart.append(apart[0][:15] + fresh(5))
    rows = [(2 * i + side, " ".join(p[side])) for i, p in enumerate(pairs) for side in (0, 1)] + [(900 + i, " ".join(w)) for i, w in enumerate(apart)]
    got = {r.doc_id: r._n_removed for r in linedup.clean(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    last = 2 * len(pairs) - 2
    assert [i for i in range(0, last, 2) if got[i] or not got[i + 1]] == []
    assert got[last] == got[last + 1] == 1 and all(got[900 + i] == 0 for i in range(4))


def test_numbers_and_all_letters_count(spark):
    rows = [(1, "Total 12"), (2, "Total 4,500 of 9,000"), (3, "a 1 2 3"), (4, "a 7"), (5, "12 34"), (6, "12, 34"), (7, "\U00010400\U00010401 \U00010402"), (8, "\U00010400\U00010401 \U00010402!"), (9, "total: 12"), (10, "Total 13")]
    got = {r.doc_id: r._n_removed for r in linedup.clean(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in sorted(got) if got[i]] == [6, 8, 9]


def test_crowded_runs(spark, monkeypatch):
    """Lines with runs that hundreds share: similar ones are found through pairs of such runs, others stay."""
    monkeypatch.setattr(linedup, "CROWD", 8)
    rng = random.Random(9)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(n)]
    head, tail = "one of the many things that we say".split(), "and so on and on it goes".split()
    rows = [(i, " ".join(head + fresh(14) + tail)) for i in range(40)]
    body = fresh(14)
    rows += [(100, " ".join(head + body + tail)), (101, " ".join(head + body[:5] + ["zz"] + body[6:] + tail))]
    rows += [(200, " ".join(head[:5] + tail[:5])), (201, " ".join(head[:5] + ["zz"] + tail[1:5]))]
    got = {r.doc_id: r._n_removed for r in linedup.clean(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in sorted(got) if got[i]] == [101, 201]


def test_no_link_is_lost_in_crowds(spark):
    """However many lines differ in one word, all but one go; so does one that lacks the word, and lines of a few words said again and again."""
    rows = [(i, f"user n{i} logged in to system") for i in range(5000)] + [(6000, "user logged in to system"), (6001, "another user n7 logged in to system")]
    rows += [(10_000 + i, f"one x{i} of the many many things that we say and so on and on it goes here again today") for i in range(5000)]
    rows += [(20_000 + i, f"ha ha ha ha ha ha ha ha q{i} r{i}") for i in range(300)]
    rows += [(30_000 + i, f"{i} b{i}x c d{i}x e") for i in range(50)]
    got = {r.doc_id: r._n_removed for r in linedup.clean(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if not got[i]] == [0, 10_000, 20_000, *range(30_000, 30_050)]


def test_second_search_takes_roots_only(spark, monkeypatch):
    """Connected components are sought anew only between groups that meet, not over all links; a chain is one group."""
    calls, components = [], linedup.components
    monkeypatch.setattr(linedup, "components", lambda spark, edges, scratch: calls.append(edges.where("a <> b").count()) or components(spark, edges, scratch))
    words = [f"w{i}" for i in range(20)]
    # each line has one more word changed than the one before: a chain whose ends share no run
    rows = [(i, " ".join(f"x{j}" if j < i else w for j, w in enumerate(words))) for i in range(21)]
    got = {r.doc_id: r._n_removed for r in linedup.clean(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in sorted(got) if not got[i]] == [0] and len(calls) == 2 and calls[1] < calls[0]


def test_only_near_lengths_meet(spark):
    """In one bucket lines meet if their lengths are at most 1 : 1.25, on either side, and not within one label."""
    lengths = [8, 10, 12, 15, 16, 20, 40, 50, 63]
    named = spark.createDataFrame([(7, i, n, 0, i) for i, n in enumerate(lengths)] + [(7, 100, 50, 0, 7)], "key long, k1 long, n int, p long, label long")
    sketches = spark.createDataFrame([(i, 0, 0, 0, 0) for i in [*range(len(lengths)), 100]], "k1 long, q0 long, q1 long, q2 long, q3 long")
    got = {(r.a, r.b) for r in linedup._across(named, sketches).collect()}
    rows = [*enumerate(lengths, 0), (100, 50)]
    near = {(a, b) for a, m in rows for b, n in rows if a < b and (a, b) != (7, 100) and abs(m - n) <= int(max(m, n) * 0.2 + 1e-9)}
    assert got == near


def test_a_near_copy_is_found_beside_a_shared_passage(spark):
    """A passage in lines that are unlike otherwise: they stay, and a near copy among them goes."""
    rng = random.Random(3)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(n)]
    passage, own = fresh(40), [fresh(20) for _ in range(300)]
    rows = [(i, " ".join(w + passage)) for i, w in enumerate(own)] + [(900, " ".join(["zz"] + own[7][1:] + passage))]
    assert [r.id for r in linedup.removals(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [900]


def test_only_links_leave_a_bucket(spark):
    """Lines whose sketches allow that they are similar come out only if their texts are."""
    named = spark.createDataFrame([(7, i, 10, 0, i) for i in range(4)], "key long, k1 long, n int, p long, label long")
    texts = ["abcdefghij", "abcdefghxy", "abcdefgwxy", "abcdevwxyz"]
    sketches = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "k1 long, sym string, q0 long, t0 long")
    assert {(r.a, r.b) for r in linedup._across(named, sketches).collect()} == {(0, 1), (1, 2)}


def test_merged_buckets_keep_lines_together(spark):
    """Buckets of nearly the same lines become one, and lines that had a bucket in common have one still."""
    rng = random.Random(4)
    members = {key: rng.sample(range(60), 55) for key in range(40)} | {100: [0, 1, 200], 101: [200, 201, 202]}
    split = spark.createDataFrame([(k1, 30, 0, key) for key, m in members.items() for k1 in m], "k1 long, n int, p long, key long")
    got = linedup._merged(linedup.Scratch(spark), split).collect()
    met = lambda buckets: {(a, b) for m in buckets for a in m for b in m if a < b}
    after = {}
    for r in got:
        after.setdefault(r.key, set()).add(r.k1)
    assert met(members.values()) <= met(after.values()) and len(got) < sum(map(len, members.values())) / 4


def test_sketches_tell_lines_apart(spark):
    """Two lines of 60 other words are told apart by their sketches alone; one more word at the beginning is one edit, wherever the others lie."""
    rows = [(k, [f"{x}{i}" for i in range(60)]) for k, x in enumerate("ab")] + [(2, ["zz", *(f"a{i}" for i in range(60))])]
    w = spark.createDataFrame(rows, "k int, w array<string>").select("k", F.size("w").alias("n"), linedup.hashes(F.col("w")).alias("h"))
    q = w.select("k", "n", *[p.alias(f"q{i}") for i, p in enumerate(linedup.wide_parity(F.col("h"), linedup.WIDE))])
    x, y = q.alias("x"), q.alias("y")
    met = x.join(y, (F.col("x.k") < F.col("y.k")) & linedup.close("x", "y", [f"q{i}" for i in range(linedup.WIDE)]))
    assert [(a, b) for a, b in met.select("x.k", "y.k").collect()] == [(0, 2)]
    turned = sum((F.bit_count(F.col(f"x.q{i}").bitwiseXOR(F.col(f"y.q{i}"))) for i in range(linedup.WIDE)), F.lit(0))
    assert x.join(y, (F.col("x.k") == 0) & (F.col("y.k") == 2)).select(turned).first()[0] == 1
