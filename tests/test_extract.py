"""Words that patterns need, and steps that deal their rows to all cores."""

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import rules
from vellumspark.operators import extract
from vellumspark.plans import q_derived

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("pattern, words", [
    (r"factura", ["factura"]), (r"\b(?:cif|nif)\b", ["cif", "nif"]), (r"(?:n\.?\s*[ºo°]?\s*(?:de\s+)?factura|factura\s+n)", ["factura"]), (r"ab?cde", ["cde"]), (r"x{0,3}abc", ["abc"]), (r"abc+d", ["abc"]),
    (r"(?<![\w])total(?![\w])|importe", ["importe", "total"]), (r"policy(?=[a-z0-9]*\d)", ["policy"]), (r"word|\d+", None), (r"(?:one)?", None), (r"[ab]cd|e\(f|ghi", None),
])
def test_words_that_a_pattern_needs(pattern, words):
    assert extract.needed(pattern) == words


def test_every_rule_needs_a_word():
    assert all(extract.needed(p) for *_, p in rules.KINDS)
    assert all(extract.needed(p) for p, *_ in rules.REFERENCES) and all(extract.needed(p) for _, p in rules.ROLES) and all(extract.needed(p) for _, p in rules.TOTALS)


def test_spots_of_texts_without_the_word(spark):
    d = spark.createDataFrame([("a poliza, poliza",), ("none",), (None,)], "f string").select("f", extract.spots(F.col("f"), r"poliza\b").alias("s"))
    assert {r.f: None if r.s is None else [(x.start, x.end) for x in r.s] for r in d.collect()} == {"a poliza, poliza": [(2, 8), (10, 16)], "none": [], None: None}


def test_papers_of_one_file_are_read_by_all_cores(spark):
    assert q_derived._papers(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_days_of_notations(spark):
    """Each notation of a day is worked out once, within the array of its line, and dates are looked for without a join of lines."""
    want = {"2024-02-29": "2024-02-29", "2023-2-29": None, "1/2/23": "2023-02-01", "31.12.1990": "1990-12-31", "31-12-1989": None, "01/02/0005": "2005-02-01", "5 de enero de 2024": "2024-01-05", "7 sept. 2020": "2020-09-07", "may 3rd, 2100": "2100-05-03", "0/1/2020": None, "2101-01-01": None}
    d = spark.createDataFrame([(i, f"on {raw} x") for i, raw in enumerate(want)], "id int, text string")
    ls = extract.lines(d, "id", "text")
    got = {r.raw: str(r.date) for r in extract.dates(ls).collect()}
    assert got == {raw: day for raw, day in want.items() if day}
    assert "Join" not in extract.date_roles(ls)._jdf.queryExecution().optimizedPlan().toString()
