"""Chunks against a plain chunker, folding by decomposition, and operators on empty and odd rows."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from vellumspark.functions import text
from vellumspark.operators import docs, extract, pieces, versions


def plain_chunks(s, size=docs.SIZE, overlap=docs.OVERLAP, tail=docs.MIN_TAIL):
    """One sign after another: every place where a chunk may end, with how good it is."""
    out, at = [], 0
    while len(s) - at > size + tail:
        window, places = s[at : at + size], []
        for m in re.finditer(r"\n\n|\n|\s+", window):
            runs = [(m.start(), m.end())]
            if m[0] == "\n\n":
                w = 5
            elif m[0] == "\n":
                w = 4
            else:
                before = window[m.start() - 1 : m.start()]
                w = 3 if before and before in ".!?…;:" else 2 if before == "," else 1
            places += [(w, end) for _, end in runs if end >= len(window) * docs.EARLY]
        end = at + (max(places)[1] if places else size)
        out.append((at, end))
        back = max(at + 1, end - overlap)
        k = s.find(" ", back, end)
        at = k + 1 if k >= 0 else end
    return out + ([(at, len(s))] if at < len(s) else [])


def test_chunks(spark):
    rng = random.Random(4)
    words = ["alpha", "be", "gamma,", "delta.", "eta;", "so?", "long" * 9]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n", "  "]) for _ in range(rng.choice([0, 5, 200, 900])))) for i in range(30)] + [(99, "x" * 3000), (100, None)]
    got = {}
    for r in docs.chunks(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.chunk))
    for i, t in texts:
        assert got.get(i, []) == [(a, b, t[a:b]) for a, b in plain_chunks(t or "")]


def test_fold(spark):
    signs = "ÀÉÎõüñçÿŠžøłĐάῆЙёẞß漢İ"
    row = spark.createDataFrame([(signs,)], "s string").select(text.fold("s").alias("f"), text.fold(F.lit("Crème Brûlée à Łódź")).alias("g")).first()
    assert row.g == "creme brulee a łodz"
    assert all(unicodedata.normalize("NFD", c)[0] == c for c in row.f if "\u00c0" <= c < "\u0530" and c not in "øłđ")


def test_odd_rows(spark):
    none = spark.createDataFrame([], "id long, text string, n int, f string, kind string")
    odd = spark.createDataFrame([(1, None, 1, "x", "y"), (2, "", 1, "x", "y"), (2, "", 1, "x", "y"), (None, "Total: 5 €", 1, "x", "y")], none.schema)
    for df in (none, odd):
        ls = extract.lines(df, "id", "text")
        for made in (extract.kinds(df, "id", "text"), extract.date_roles(ls), extract.periods(df, "id", "text"), extract.amounts(ls), extract.references(df, "id", "text"), pieces.personal(df, "id", "text"), pieces.sections(df, "id", "text"), versions.compare(df, df, "id", "text")):
            made.collect()
    assert [r.doc for r in extract.amounts(extract.lines(odd, "id", "text")).collect()] == [None]
    assert {r.kind for r in extract.kinds(odd, "id", "text").collect()} == {"other"}


def test_languages(spark):
    from vellumspark.functions import formats, text

    rows = [(1, "The end of the story is in the book"), (2, "el perro y el gato en la casa"), (3, "o gato e o rato na casa das meninas"), (4, "il gatto e il cane sono in casa"), (5, "els gats i els gossos amb el pa"), (6, "der Hund und die Katze"), (7, "漢字かな交じり文"), (8, "привет мир"), (9, "la la"), (10, None), (11, ""), (12, "xyzzy plugh foo"), (13, "le chat dans une maison est avec les chiens")]
    got = {r.id: r for r in text.languages(spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, text string, script string, w int").select("id", "text"), "id", "text", formats.script).collect()}
    assert {i: r.code for i, r in got.items()} == {1: "en", 2: "es", 3: "pt", 4: "it", 5: "ca", 6: "de", 7: "ja", 8: "", 9: "", 10: "", 11: "", 12: "", 13: "fr"}
    assert got[7].confidence == 0.9 and got[8].confidence == 0.0 and got[10].words == 0 and got[1].hits == 6 and got[1].confidence == 0.75
