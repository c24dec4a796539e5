"""Formats as Column expressions: subtitles, calendar events, CSV, sortable ids, versions, addresses, scripts, dates that are spoken of. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import fold


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds after the mark: a comma in SubRip, a point in WebVTT."""
    part = lambda d, m: F.floor(ms / d).cast("long") % m
    return F.format_string("%02d:%02d:%02d" + mark + "%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms.cast("long") % 1000)


def to_subtitles(cues: DataFrame, group: str, start_ms: str, end_ms: str, text: str, vtt: bool = False) -> DataFrame:
    """(group, content): a group's cues in order of time as SubRip or WebVTT. Cues without text are left out; white space in one is a single blank."""
    said = F.trim(F.regexp_replace(text, r"\s+", " "))
    c = cues.select(group, F.col(start_ms).alias("_s"), F.col(end_ms).alias("_e"), said.alias("_t")).where("_t <> ''")
    c = c.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("_s", "_e", "_t")))
    mark = "." if vtt else ","
    head = F.lit("") if vtt else F.concat(F.col("_n").cast("string"), F.lit("\n"))
    block = F.concat(head, clock(F.col("_s"), mark), F.lit(" --> "), clock(F.col("_e"), mark), F.lit("\n"), F.col("_t"), F.lit("\n"))
    g = c.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))).alias("bs"))
    body = F.array_join(F.col("bs.b"), "\n")
    return g.select(group, (F.concat(F.lit("WEBVTT\n\n"), body) if vtt else body).alias("content"))


def _ms(stamp: Column) -> Column:
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stamp, r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})", i), F.lit("")), F.lit("9999")).cast("long"), F.lit(0))
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def parse_subtitles(content: Column | str) -> Column:
    """array<struct<start_ms,end_ms,text>> of SubRip or WebVTT; blocks without a time line (headers, notes, styles) are left out, tags dropped."""
    blocks = F.split(F.regexp_replace(content, "\r\n?", "\n"), r"\n\s*\n")
    time = r"(?m)^\s*((?:\d+:)?\d{2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d+:)?\d{2}:\d{2}[.,]\d{3}).*$"
    timed = F.filter(blocks, lambda b: b.rlike(time) & ~b.rlike(r"^\s*(NOTE|STYLE|REGION)\b"))
    body = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]*>", ""), F.lit(" \n"))
    return F.transform(timed, lambda b: F.struct(_ms(F.regexp_extract(b, time, 1)).alias("start_ms"), _ms(F.regexp_extract(b, time, 2)).alias("end_ms"), body(b).alias("text")))


def cues_text(cues: Column, gap_ms: int = 2000) -> Column:
    """Running speech: cues joined with a blank, or a new line after a silence or the end of a sentence."""
    first = F.struct(F.lit("").alias("text"), F.lit(None).cast("long").alias("end"), F.lit("").alias("last"))
    join = lambda a, c: F.when(a["end"].isNull(), F.lit("")).when((c["start_ms"] - a["end"] > gap_ms) | a["last"].rlike(r"[.!?…]$"), F.lit("\n")).otherwise(F.lit(" "))
    return F.aggregate(cues, first, lambda a, c: F.struct(F.concat(a["text"], join(a, c), c["text"]).alias("text"), c["end_ms"].alias("end"), c["text"].alias("last")), lambda a: a["text"])


def ics_escape(c: Column | str) -> Column:
    out = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"([\\;,])", r"\\$1")
    return F.regexp_replace(out, "\r\n?|\n", r"\\n")


def ics_event(uid: Column, day: Column, title: Column) -> Column:
    """An all-day event, lines ended as calendars want them."""
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    rows = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp(day)), F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(F.date_add(day, 1))), F.concat(F.lit("SUMMARY:"), ics_escape(title)), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *rows)


def csv_line(cols: list[Column], sep: str = ";") -> Column:
    """One line: null is empty, and what holds the separator, a quote or a line end is quoted; formulas are defused with an apostrophe."""
    def cell(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        s = F.when(s.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
        return F.when(s.rlike(f'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(sep, *[cell(c) for c in cols])


#: Digits of sortable ids, base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ms: Column, seed: Column) -> Column:
    """26 signs that sort by time: ten for the milliseconds, sixteen from a hash of the seed, so that a row always gets the same."""
    digit = lambda v: F.substring(F.lit(CROCKFORD), (v + 1).cast("int"), F.lit(1))
    head = [digit(F.shiftright(ms, 5 * k).bitwiseAND(F.lit(31))) for k in range(9, -1, -1)]
    tail = [digit(F.shiftright(F.xxhash64(F.lit(part), seed), 5 * k).bitwiseAND(F.lit(31))) for part in (0, 1) for k in range(8)]
    return F.concat(*head, *tail)


def id_time(c: Column | str) -> Column:
    """The milliseconds in a sortable id, alone or after a prefix and a separator; null for anything else."""
    tail = F.regexp_extract(c, f"(?:^|[^0-9A-Za-z])([{CROCKFORD}]{{26}})$", 1)
    digits = F.split(F.substring(tail, 1, 10), "")
    return F.when(tail != "", F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 32 + F.instr(F.lit(CROCKFORD), d) - 1))


def version_key(c: Column | str) -> Column:
    """A struct by which versions sort: numbers, then a release after its previews, whose fields compare as numbers or else as text, fewer first."""
    core = F.transform(F.split(F.regexp_extract(c, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("long"))
    pre = F.regexp_extract(c, r"^\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    field = lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.when(x.rlike(r"^\d+$"), F.try_to_number(x, F.lit("999999999")).cast("long")).alias("n"), x.alias("s"))
    return F.struct(core.alias("core"), (pre == "").alias("release"), F.transform(F.filter(F.split(pre, r"\."), lambda x: x != ""), field).alias("fields"))


def address_class(c: Column | str) -> Column:
    """What an IPv4 address is: private, loopback, link_local, shared, multicast, reserved, unspecified or public; null if it is none."""
    s = F.trim(c)
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(s, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i), F.lit("")), F.lit("999")).cast("int")
    a, b = part(1), part(2)
    ok = (F.greatest(*[part(i) for i in (1, 2, 3, 4)]) <= 255) & part(4).isNotNull()
    kind = (
        F.when(a == 127, "loopback").when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private").when((a == 169) & (b == 254), "link_local").when((a == 100) & b.between(64, 127), "shared")
        .when(a.between(224, 239), "multicast").when(a >= 240, "reserved").when(a == 0, "unspecified").otherwise("public")
    )
    return F.when(ok, kind)


#: Writing systems and how their letters are matched.
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "cjk": r"\p{IsHan}", "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}"}


def script(c: Column | str) -> Column:
    """The writing system of most letters, '' without letters; Han among kana is Japanese."""
    c = F.col(c) if isinstance(c, str) else c
    n = {k: F.regexp_count(c, F.lit(p)) for k, p in SCRIPTS.items()}
    n["ja"], n["cjk"] = F.when(n["ja"] > 0, n["ja"] + n["cjk"]).otherwise(0), F.when(n["ja"] > 0, 0).otherwise(n["cjk"])
    best = F.array_max(F.array(*[F.struct(v.alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(n.items())]))
    counted = F.when(best["n"] == 0, "").otherwise(best["k"])
    # letters are counted only where a letter is not Latin
    return F.when(c.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), counted).when(c.rlike(r"\p{IsLatin}"), "latin").when(c.isNotNull(), "")


def decimal_mark(c: Column | str) -> Column:
    """An aggregate: the decimal mark that the amounts of a column use, null where none shows it."""
    s = F.regexp_replace(c, r"[^\d.,]", "")
    votes = lambda *ps: sum((F.sum(s.rlike(p).cast("int")) for p in ps[1:]), F.sum(s.rlike(ps[0]).cast("int")))
    comma, dot = votes(r",\d{1,2}$", r"\.\d{3},\d+$"), votes(r"\.\d{1,2}$", r",\d{3}\.\d+$")
    return F.when((comma > 0) | (dot > 0), F.when(comma >= dot, ",").otherwise("."))


def resolve_year(day: Column, month: Column, today: Column, prefer: str = "nearest") -> Column:
    """The date with this day and month, of last, this or next year: future (not over 10 days ago), past (not over 45 days ahead), next (today or later) or nearest."""
    def cost(d: Column) -> Column:
        diff = F.datediff(d, today)
        if prefer == "future":
            return F.when(diff >= -10, diff).otherwise(10000 - diff)
        if prefer == "past":
            return F.when(diff <= 45, -diff).otherwise(10000 + diff)
        if prefer == "next":
            return F.when(diff >= 0, diff).otherwise(10000 - diff)
        return F.abs(diff)

    dates = F.transform(F.sequence(F.year(today) - 1, F.year(today) + 1), lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day)))
    return F.array_min(F.transform(F.filter(dates, lambda d: d.isNotNull()), lambda d: F.struct(cost(d).alias("cost"), d.alias("d"))))["d"]


#: Days of the week in two languages, Monday first, and number words.
WEEKDAYS = ["lunes|monday", "martes|tuesday", "miercoles|wednesday", "jueves|thursday", "viernes|friday", "sabado|saturday", "domingo|sunday"]
FEW = {"un": 1, "una": 1, "a": 1, "one": 1, "dos": 2, "two": 2, "tres": 3, "three": 3, "cuatro": 4, "four": 4, "cinco": 5, "five": 5, "seis": 6, "six": 6, "diez": 10, "ten": 10}


def spoken_date(c: Column | str, today: Column) -> Column:
    """The day that words name, seen from today: a date, in n days, weeks or months, tomorrow, a weekday after today, a day of this month or the next, the month's end."""
    s = F.regexp_replace(fold(c), r"\bpor la manana\b|\bde la manana\b", " ")
    iso = F.try_to_date(F.regexp_extract(s, r"\b(\d{4}-\d{2}-\d{2})\b", 1))
    dmy = F.try_to_date(F.regexp_replace(F.regexp_extract(s, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1), r"\b(\d)/", "0$1/"), "dd/MM/yyyy")
    word, unit = (F.regexp_extract(s, rf"\b(?:en|dentro de|in)\s+(\d{{1,3}}|{'|'.join(sorted(FEW, key=len, reverse=True))})\s+(dia|day|semana|week|mes|month)", i) for i in (1, 2))
    n = F.coalesce(F.try_to_number(F.when(word.rlike(r"^\d+$"), word), F.lit("999")).cast("int"), F.element_at(F.create_map(*[F.lit(x) for kv in FEW.items() for x in kv]), word))
    ahead = F.when(unit.isin("dia", "day"), F.date_add(today, n)).when(unit.isin("semana", "week"), F.date_add(today, n * 7)).when(unit.isin("mes", "month"), F.add_months(today, n))
    weekday = F.lit(None).cast("date")
    for short, names in zip("Mon Tue Wed Thu Fri Sat Sun".split(), WEEKDAYS, strict=True):
        weekday = F.when(s.rlike(rf"\b({names})\b"), F.next_day(today, short)).otherwise(weekday)
    number = F.try_to_number(F.nullif(F.regexp_extract(s, r"\b(?:el dia|el|the|day)\s+(\d{1,2})\b", 1), F.lit("")), F.lit("99")).cast("int")
    this, after = (F.try_to_date(F.concat(F.date_format(F.add_months(today, k), "yyyy-MM-"), F.lpad(number.cast("string"), 2, "0"))) for k in (0, 1))
    return F.coalesce(
        iso, dmy, ahead, F.when(s.rlike(r"\b(pasado manana|day after tomorrow)\b"), F.date_add(today, 2)), F.when(s.rlike(r"\b(manana|tomorrow)\b"), F.date_add(today, 1)),
        F.when(s.rlike(r"\b(hoy|today|tonight)\b"), today), weekday, F.when(this >= today, this), after, F.when(s.rlike(r"\b(fin(al)? de mes|end of (the )?month)\b"), F.last_day(today)),
    )


def quantity(c: Column | str) -> Column:
    """A number with either decimal mark: the last one where both stand, the comma where it stands alone."""
    s = F.regexp_replace(c, " ", "")
    last = F.regexp_extract(s, "([.,])[^.,]*$", 1)
    plain = F.when(s.contains(",") & s.contains("."), F.when(last == ",", F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def fiscal_year(text: Column, *dates: Column) -> Column:
    """The one year that a text names as its own, or else the year of the first date there is."""
    named = F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"(?:ejercicio|ano fiscal|tax year|renta)\s*:?\s*((?:19|20)\d{2})"), F.lit(1)))
    return F.coalesce(F.when(F.size(named) == 1, F.get(named, F.lit(0)).cast("int")), F.year(F.coalesce(*dates)))
