"""Text as Column expressions: folding, tokens, cleaning, keys, addresses. All of them stay in the JVM; null in, null out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _plain(c: str) -> str:
    """A lower-case letter without its accents; a sign that is none, or would grow, as it is."""
    base = unicodedata.normalize("NFD", c)[0]
    return base if len(base.lower()) == 1 and unicodedata.category(base).startswith("L") else c


#: Accented lower-case letters of the Latin, Greek and Cyrillic blocks and their plain forms by decomposition, one sign for one sign.
ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]) if c == c.lower() and _plain(c) != c)
PLAIN = "".join(map(_plain, ACCENTED))

#: Function words of each language without accents, by which a text's language is voted; of equal votes the first language counts.
STOP_WORDS = {
    "es": "el la de que y en un los se del las por con para una su al lo como mas",
    "en": "the of and to in is that for it with as was on be by this are from at",
    "fr": "le la les des et en un une du dans pour que qui sur par est avec pas au",
    "pt": "o os as um uma de do da dos das e em no na que nao com por para se",
    "it": "il lo la gli le di del della e in un una che non per con si da al sono",
    "de": "der die das und ist in zu den von mit fur auf nicht ein eine im dem des sich",
    "ca": "el la els les de del i en un una que no per amb es al son als pels aquest",
}
#: Languages that a script alone tells.
SCRIPT_LANGUAGE = {"ja": "ja", "ko": "ko", "cjk": "zh", "greek": "el", "hebrew": "he", "thai": "th", "devanagari": "hi"}


def fold(c: Column | str) -> Column:
    """Lower case without accents; each sign stays one sign, so offsets into the text hold."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def stem(w: Column) -> Column:
    """A word without its plural ending: -es from six letters on, -s from five on."""
    n = F.char_length(w)
    return F.when((n > 5) & w.endswith("es"), F.substring(w, F.lit(1), n - 2)).when((n > 4) & w.endswith("s"), F.substring(w, F.lit(1), n - 1)).otherwise(w)


def clean(c: Column | str) -> Column:
    """One newline style, no invisible signs, single blanks, words joined over a line-end hyphen, one empty line at most."""
    steps = [("\r\n?", "\n"), ("[\u200b\u200c\u200d\u2060\ufeff\u00ad]", ""), ("[\u00a0\t\f\u000b ]+", " "), ("(?<=\\p{L})-\n(?=\\p{Ll})", ""), (" ?\n ?", "\n"), ("\n{3,}", "\n\n")]
    out = F.col(c) if isinstance(c, str) else c
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def useful_chars(c: Column | str) -> Column:
    """Number of letters and digits."""
    return F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def slug(c: Column | str, most: int = 80) -> Column:
    """Letters and digits of the folded text with single hyphens between; cut at a hyphen where it is too long."""
    s = F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(s, 1, most + 1)
    return F.when(F.char_length(s) <= most, s).otherwise(F.trim(F.regexp_replace(cut, "-[^-]*$", ""), F.lit("-")))


def clamp(c: Column | str, most: int, mark: str = "…") -> Column:
    """White space collapsed, and a long text cut at the last blank that fits, with a mark."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    head = F.substring(s, 1, most)
    at = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.rtrim(at), F.lit(mark)))


def company_key(c: Column | str) -> Column:
    """Folded letters and digits of a name without its legal form."""
    words = F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, r" (s ?a ?u?|s ?l ?u?|ltd|inc|llc|gmbh|sas|sarl)$", "")


def email(c: Column | str, strip_tag: bool = True) -> Column:
    """A mail address in lower case, out of angle brackets, without +tag, and without dots where the host ignores them; null if it is none."""
    raw = F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(c, "<([^<>]+)>", 1), F.lit("")), F.col(c) if isinstance(c, str) else c)))
    user, host = F.substring_index(raw, "@", 1), F.substring_index(raw, "@", -1)
    host = F.when(host == "googlemail.com", "gmail.com").otherwise(host)
    user = F.regexp_replace(user, r"\+.*$", "") if strip_tag else user
    user = F.when(host == "gmail.com", F.replace(user, F.lit("."), F.lit(""))).otherwise(user)
    return F.when(raw.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.concat(user, F.lit("@"), host))


def phone(c: Column | str, country: str = "34") -> Column:
    """Digits with a leading +: 00 is read as +, nine digits get the country's prefix."""
    s = F.regexp_replace(c, r"[^\d+]", "")
    digits = F.regexp_replace(s, r"\D", "")
    return F.when(F.char_length(digits) < 7, F.lit(None)).when(s.startswith("+"), F.concat(F.lit("+"), digits)).when(digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.char_length(digits)))).when(F.char_length(digits) == 9, F.concat(F.lit(f"+{country}"), digits)).otherwise(digits)


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


#: Query parameters that only track the reader, beginnings of such, and hosts on which ref is one.
TRACKERS = (
    "fbclid gclid gclsrc dclid msclkid mc_cid mc_eid igshid ref_src ref_url ref_ yclid twclid wbraid gbraid ttclid li_fat_id srsltid _gl _ga"
    " _hsenc _hsmi vero_id vero_conv s_cid spm snr ser eid c2id mkt_tok trackingid refid"
)
TRACKER_BEGINNINGS = "utm_ mc_ _hs vero_ trk"
REF_HOSTS = "producthunt.com etsy.com medium.com indiehackers.com"
TRACKING = "(?i)^(?:(?:" + "|".join(TRACKER_BEGINNINGS.split()) + ")[^=]*|" + "|".join(TRACKERS.split()) + ")(?:=|$)"
REF_HOST = r"(?:^|\.)(?:" + "|".join(REF_HOSTS.replace(".", r"\.").split()) + ")$"


def url_key(c: Column | str) -> Column:
    """An address as an identity: https, lower-case host without www, no fragment, no tracking, sorted parameters, no closing slash."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", ""), r"\?.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING) & ~(p.rlike("(?i)^ref(=|$)") & host(c).rlike(REF_HOST)))), "&")
    where = F.concat(F.lit("https://"), F.regexp_replace(host(c), r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(kept == "", where).otherwise(F.concat(where, F.lit("?"), kept))


def domain(c: Column | str) -> Column:
    """The last two labels of an address's host, three under a two-part public suffix."""
    h = host(c)
    deep = h.rlike(r"\.(co|com|org|net|gob|gov|ac|edu)\.[a-z]{2}$")
    return F.when(deep, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def languages(docs: DataFrame, key: str, text: str, script: Callable[[Column], Column]) -> DataFrame:
    """(key, code, confidence, script, hits, words): the language of each text by its function words, or by its script where that isn't Latin.

    Texts are cut into words once and joined with the table of function words, a hundred rows that are broadcast; what is summed for each text before
    any shuffle is a few counts. code is '' for less than three words or without a function word; confidence is the language's share of all votes
    times the share of a quarter of the words (three at least) that voted for it. Null texts have no words; rows of one key and script are one text.
    """
    order = list(STOP_WORDS)
    rows: dict[str, list[int]] = {}
    for i, k in enumerate(order):
        for w in STOP_WORDS[k].split():
            rows.setdefault(w, [0] * len(order))[i] = 1
    table = docs.sparkSession.createDataFrame([(w, *v) for w, v in rows.items()], "w string, " + ", ".join(f"`{k}` int" for k in order))
    # the script first, as what stands beside an explode is worked out for each of its rows
    t = docs.select(F.col(key), script(F.col(text)).alias("_script"), F.regexp_extract_all(fold(text), F.lit(r"[\p{L}]+"), F.lit(0)).alias("w")).select(key, "_script", F.explode_outer("w").alias("w"))
    votes = t.join(F.broadcast(table), "w", "left").groupBy(key, F.col("_script").alias("script")).agg(F.count("w").alias("words"), *[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in order])
    most, every = F.greatest(*order), sum((F.col(k) for k in order), F.lit(0))
    first = F.coalesce(*[F.when(F.col(k) == most, k) for k in order])
    latin = F.coalesce(F.col("script"), F.lit("")).isin("", "latin")
    told = F.element_at(F.create_map(*[F.lit(x) for kv in SCRIPT_LANGUAGE.items() for x in kv]), F.col("script"))
    enough = (F.col("words") >= 3) & (most > 0)
    sure = F.round(most / every * F.least(F.lit(1.0), most / F.greatest(F.lit(3.0), F.col("words") * 0.25)), 2)
    return votes.select(
        key, F.when(~latin, F.coalesce(told, F.lit(""))).when(enough, first).otherwise("").alias("code"), F.when(~latin, F.when(told.isNotNull(), 0.9).otherwise(0.0)).when(enough, sure).otherwise(0.0).alias("confidence"),
        F.coalesce("script", F.lit("")).alias("script"), most.cast("long").alias("hits"), F.col("words").cast("long").alias("words"),
    )


def snippet(c: Column | str, terms: list[str], window: int = 160) -> Column:
    """An excerpt around the first word that begins with a term, its matches in <mark>; the text's beginning where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    any_term = "(?i)\\b(" + "|".join(terms) + ")\\w*"
    before = F.regexp_extract(c, f"(?s)^(.*?)(?={any_term})", 1)
    at = F.when(c.rlike(any_term), F.greatest(F.char_length(before) - window // 2, F.lit(0))).otherwise(F.lit(0))
    return F.regexp_replace(F.substring(c, at + 1, F.lit(window)), f"({any_term})", "<mark>$1</mark>")


def front_matter(c: Column | str) -> Column:
    """map(key, value) of a leading block between two lines of three hyphens; null where there is none."""
    block = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    return F.when(block != "", F.map_from_entries(entries))


def unwrap(c: Column | str) -> Column:
    """The address that a redirect carries in its url, u, q, to or target parameter, or the address itself."""
    c = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_extract(c, r"[?&](?:url|u|q|to|target)=(https?(?:%3A|:)[^&#]*)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(c)


def markdown_plain(c: Column | str) -> Column:
    """Text without its markdown: fences, headings, quotes, bullets, images, links, emphasis and code marks."""
    out = F.col(c) if isinstance(c, str) else c
    for pattern, to in ((r"(?m)^```.*$", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""), (r"(?m)^[ \t]{0,3}>[ \t]?", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(\*\*|__)(.+?)\1", "$2"), (r"[*_`]", ""), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def page_list(c: Column | str, total: int) -> Column:
    """Pages that a text like "1-3,5,8-" names, in order, each once: an open end reaches to `total`; odd, even, last and all are words."""
    def part(x: Column) -> Column:
        x = F.lower(F.trim(x))
        a = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r"^(\d*)", 1), F.lit("")), F.lit("99999")).cast("int"), F.lit(1))
        b = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r"-\s*(\d*)$", 1), F.lit("")), F.lit("99999")).cast("int"), F.lit(total))
        every = F.sequence(F.lit(1), F.lit(total))
        span = F.when(x.contains("-"), F.sequence(a, b)).otherwise(F.array(a))
        named = F.when(x == "all", every).when(x == "odd", F.filter(every, lambda p: p % 2 == 1)).when(x == "even", F.filter(every, lambda p: p % 2 == 0)).when(x == "last", F.array(F.lit(total)))
        return F.coalesce(named, span)

    pages = F.flatten(F.transform(F.split(c, ","), part))
    return F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= total)))
