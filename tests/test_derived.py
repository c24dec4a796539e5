"""Texts written from rows keep every notation; scripts of odd documents against their SQL."""

import duckdb

from vellumspark.plans import q_derived

SF = "/root/testdata/sf0.001"


def test_easter_of_two_centuries(spark):
    assert {r.y for r in q_derived.easter(spark, SF).collect()} >= set(range(1900, 2100))


def test_days_are_said_in_all_ways(spark):
    got = q_derived.spoken(spark, SF).collect()
    assert len(got) > 5000 and 200 < sum(r.day is None for r in got) < len(got) // 8


def test_notes_without_block(spark):
    got = q_derived.front(spark, SF).collect()
    assert {(r.title is None, r.lang is None) for r in got} == {(False, False), (False, True), (True, True)}


def test_scripts_of_odd_documents(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "de"), (3, "Приве́т мир", "en"), (4, "漢字 かな", "fr"), (5, "漢字漢 abcd", "en"), (6, "ÄÖÜ ß", "de"), (7, "123 ~", "es"), (8, "abc абв", "en"), (9, "Հայ", "en"), (10, "µ", "en"), (11, "ñandú µ", "es"), (12, "x漢カ", None)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d/documents.parquet"))
    mine = {r.doc_id: r.script for r in q_derived.scripts(spark, str(tmp_path / "d")).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/documents.parquet/*.parquet'")
    assert mine == dict(con.sql(q_derived.SCRIPTS).fetchall())
    assert mine[1] is None and mine[3] == "cyrillic" and mine[4] == "ja"
