"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from vellumspark.llm import bpe, chats, decontamination, html, linedup, neardup, quality, registry, sharding, tokencounts, topk

SF = "/root/testdata/sf0.001"


def test_sharding(spark, odd_docs, no_docs):
    rows = sharding.assign(spark, odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.id is not None:
            t = texts[r.id]
            assert r["size"] == 16 + len((t or "").encode()) and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    assert len({r.shard for r in rows if r.id in (1, 3)}) == 1
    assert sharding.assign(spark, no_docs, 4).count() == 0


def test_packing():
    assert sharding.best_fit([(5, 1), (4, 1), (3, 2), (2, 1)], 6) == [[(0, 1)], [(1, 1)], [(2, 2)], [(1, 1)]]
    assert sharding.best_fit([(9, 1), (4, 1)], 6) == [[(0, 1)], [(1, 1)]]
    items = sorted([(i * 7919) % 1000 // 3 + 1 for i in range(3000)], reverse=True)
    sizes = sorted(collections.Counter(items).items(), reverse=True)
    loads = [0] * 40
    for (s, c), runs in zip(sizes, sharding.pack_evenly(sizes, 40), strict=True):
        assert sum(n for _, n in runs) == c
        for b, n in runs:
            loads[b] += s * n
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 40
    big, small = sharding.pack_evenly([(100, 1), (1, 3)], 3)
    assert big[0][0] not in [b for b, _ in small]


def test_runs_equal_one_item_at_a_time():
    """Best fit decreasing item by item with a plain scan for the tightest bin."""
    items = sorted([(i * i * 31) % 97 + 1 for i in range(700)], reverse=True)
    bins, want = [], collections.Counter()
    for size in items:
        fit = [(room, b) for b, room in enumerate(bins) if room >= size]
        if fit:
            b = min(fit)[1]
        else:
            b = len(bins)
            bins.append(500)
        bins[b] -= size
        want[size, b] += 1
    sizes = sorted(collections.Counter(items).items(), reverse=True)
    got = collections.Counter()
    for (size, _), runs in zip(sizes, sharding.best_fit(sizes, 500), strict=True):
        for b, n in runs:
            got[size, b] += n
    assert got == want


def test_shards_are_even(spark):
    """Equal texts together, near equal bytes, the packing that the driver planned: over whole documents, with hot copies and a hot size."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.range(3000).selectExpr("id + 10000 AS doc_id", "CASE WHEN id < 1000 THEN 'one very common text' ELSE lpad(CAST(id AS string), 40, 'x') END AS text")
    rows = sharding.assign(spark, docs.union(more), 8).collect()
    load, homes = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8
    assert all(len(h) == 1 for h in homes.values())


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 7}", i) for i in range(50)], "doc_id long, text string, shard int")
    sharding.write_shards(spark, docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in back) == list(range(50)) and len({r.shard for r in back}) == 4


def test_bins_match_a_plain_scan():
    bins, plain = sharding.Bins(), []
    for k in range(500):
        need = k * 37 % 101
        want = min((b for b in plain if b[0] >= need), default=None)
        assert bins.take(need) == want
        if want:
            plain.remove(want)
        new = (k * 53 % 97, k)
        bins.insert(new)
        plain.append(new)


def test_near_dedup(spark, odd_docs, no_docs):
    rows = neardup.link(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.id: r for r in rows if r.id is not None}
    assert [got[i].component for i in (1, 2, 3, 7, 8)] == [1, 1, 1, 7, 7]
    assert got[9].component == got[10].component == 9 and got[9].n_shingles == 1
    assert all(got[i].component == i and got[i].kept and got[i].n_shingles == 0 for i in (4, 5, 6))
    assert all(r.component is None and r.kept for r in rows if r.id is None)
    assert neardup.link(spark, no_docs).count() == 0
    assert neardup.keep_first(spark, odd_docs).columns == odd_docs.columns


def test_top_k(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [1.0], 1), (8, [0.5, 0.0], 1), (8, [0.5, 0.0], 1), (9, [1e30, 0.0], 1)], "vec_id long, embedding array<double>, score int")
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(spark, v, v.where("vec_id = 0"), 4).orderBy("rank").collect()]
    assert got == [(1, 9, (1 << 63) - 1), (2, 1, 1 << 20), (3, 2, 1 << 20), (4, 8, 1 << 19)]
    assert topk.search(spark, v, v.where("vec_id = 0"), 50).count() == 6
    assert topk.search(spark, v.limit(0), v.limit(0)).count() == 0


def test_quality(spark, odd_docs, no_docs):
    good = spark.createDataFrame([(100 + i, "the " * 3 + f"tale of word{i} goes on and on") for i in range(40)] + [(200 + i, f"buy### now$$$ word{i} ***") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(spark, good, labels)
    got = {r.doc_id: r.score for r in quality.score(good, model).collect()}
    assert all((got[i] > 0.5) == (i < 200) for i in got)
    assert quality.score(odd_docs, model).count() == odd_docs.count()
    assert quality.score(no_docs, model).count() == 0
    nothing = quality.train(spark, no_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5}


def test_held_out_accuracy(spark):
    got = quality.op4_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "two")], "item_id long, text string")
    got = {r.id: r for r in decontamination.scan(spark, odd_docs, items).collect() if r.id is not None}
    assert got[1]["items"] == ["1"] and got[9]["items"] == ["4"] and got[4]["items"] == [] and got[4].n_words == 0
    assert decontamination.scan(spark, no_docs, items).count() == 0
    assert decontamination.scan(spark, odd_docs, items.limit(0)).where("size(items) > 0").count() == 0
    kept = decontamination.remove(spark, odd_docs, items)
    assert {9, 10, 1} & {r.doc_id for r in kept.collect()} == set() and kept.columns == odd_docs.columns
    assert decontamination.cut("A, b c; d", [(1, 3)]) == "A, ; d"
    spans = {r.doc_id: r.text for r in decontamination.remove(spark, odd_docs, items, mode="spans").collect() if r.doc_id is not None}
    assert spans[1].startswith(" delta") and spans[9] == " two" and spans[4] is None and spans[5] == ""


def test_decontamination_in_blocks(spark, monkeypatch):
    """Many blocks of a few items give what one block gives."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    one = sorted(decontamination.scan(spark, docs, items).collect(), key=lambda r: r.id)
    kept, cut = ([r.text for r in decontamination.remove(spark, docs, items, mode=m).orderBy("doc_id").collect()] for m in ("documents", "spans"))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert len(list(decontamination._blocks(items, "item_id", "text"))) > 3
    assert sorted(decontamination.scan(spark, docs, items).collect(), key=lambda r: r.id) == one
    assert [[r.text for r in decontamination.remove(spark, docs, items, mode=m).orderBy("doc_id").collect()] for m in ("documents", "spans")] == [kept, cut]


def test_line_dedup(spark, odd_docs, no_docs):
    got = linedup.clean(spark, odd_docs)
    assert got.columns[:-2] == odd_docs.columns and got.count() == odd_docs.count()
    text = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert text[1].text and text[3].text == "" and text[4].text is None and text[6].text == "  \n\t "
    assert linedup.clean(spark, no_docs).count() == 0


def test_bpe(spark, odd_docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    a = bpe.automaton(spark, bpe.default_path())
    got = bpe.decode(bpe.encode(odd_docs, a), a)
    for r in got.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, a).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    signs = [*"abcdeth in  \n\t'll're1290!?.é國İßΣς\x1c", "the", "ing", " of", "<|endoftext|>"]
    rng = random.Random(3)
    made = spark.createDataFrame([("".join(rng.choices(signs, k=rng.choice([1, 3, 10, 40]))),) for _ in range(2000)], "text string")
    rows = bpe.decode(bpe.encode(docs.union(made), a), a).collect()
    assert len(rows) > 2900
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_html(spark):
    p = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<nav><a>x</a></nav><article><p>One &amp; <b>two<p>three</article><footer>f</footer>", "t"), (3, "u", "<p>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    got = html.extract(spark, p).collect()
    assert [r.text for r in got[:3]] == ["", "", "One & two\nthree"] and len(got) == 4
    assert html.extract(spark, p.limit(0)).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 5, "user", "a"), (3, 7, "assistant", "b"), (3, 9, "user", "c"), (4, 0, "user", None), (4, 0, "user", None), (5, None, None, "x"), (None, 0, "user", "a"), (6, 0, "user", "")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chats.render(spark, c).collect()}
    assert sorted(got) == [3, 4, 5, 6] and got[3].n_turns == 3 and got[4].n_turns == 1
    assert got[3].text.startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb")
    assert chats.render(spark, c.limit(0)).count() == 0
    many = spark.range(2500).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    one = chats.render(spark, many.union(many.where("turn < 1500").selectExpr("8L", "turn", "role", "text"))).collect()
    assert [(r.conv, r.n_turns) for r in one] == [(7, 2500)]
    assert one[0].text == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(2500))
    clash = c.selectExpr("*", "1 AS conv", "2 AS pos", "'z' AS c1", "'y' AS cell", "3 AS n").union(spark.sql("SELECT 9L, 0L, 'user', repeat('long ', 200000), 1, 2, 'z', 'y', 3"))
    assert sorted(r.conv for r in chats.render(spark, clash).collect()) == [3, 4, 5, 6, 9]


def test_token_counts(spark, odd_docs, no_docs):
    import tiktoken

    ranks, pattern = tokencounts.default_vocabulary()
    e = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in tokencounts.count(spark, odd_docs).collect():
        assert r.n_tokens == r.n_tokens_edited == len(e.encode_ordinary(r.text or ""))
    assert tokencounts.count(spark, no_docs).count() == 0


def test_edits_equal_fresh_counts():
    import random

    import tiktoken

    ranks, pattern = tokencounts.default_vocabulary()
    e, c, r = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokencounts.Counter(ranks, pattern), random.Random(5)
    signs = [*"ab  \n\n\t'sll're1290!?.é國 ", "hello ", "the", " world"]
    for _ in range(400):
        s = "".join(r.choice(signs) for _ in range(r.choice([0, 1, 5, 60, 900])))
        t = tokencounts.Tree(s, c)
        for _ in range(4):
            a = r.randint(-1, len(s) + 2)
            b, w = a + r.choice([0, 0, 1, 3, 50]), "".join(r.choice(signs) for _ in range(r.choice([0, 1, 4, 40])))
            t.edit(a, b, w)
            a, b = min(max(a, 0), len(s)), max(min(max(a, 0), len(s)), min(b, len(s)))
            s = s[:a] + w + s[b:]
            assert t.text == s and t.total == len(e.encode_ordinary(s))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.encode(spark, docs, SF)
    assert 0 < out.count() <= 200 and hashlib.sha256(bytes(out.first().ids)).hexdigest()
