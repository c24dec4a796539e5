"""Least edit scripts of two sequences, and of the texts of a table and their nearest relatives.

The script is found along diagonals: after d edits, the farthest place on each diagonal follows from those of its neighbours after d - 1.
Running from both ends at once, the two frontiers meet halfway along a shortest path, so each half is solved alone and only frontiers are kept.
Work grows with (n + m) * d and memory with d. Texts that share little would make d as long as they are: beyond FAR edits, the sequences
are first cut at tokens that occur once on both sides, in the longest order that both keep.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits up to which a script is the least one for certain. A frontier holds that many places.
FAR = 1000
CHANGES = "kind string, before_at int, before array<string>, after_at int, after array<string>"


def _meeting(a: list[int], b: list[int], most: int) -> tuple[int, int] | None:
    """A place (i, j) halfway on a shortest path from (0, 0) to (len(a), len(b)); None beyond `most` edits. Both sides start and end differently."""
    n, m = len(a), len(b)
    apart = n - m
    front, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        if 2 * d > most:
            return None
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = front.get(k + 1, -1) if k == -d or (k != d and front.get(k - 1, -1) < front.get(k + 1, -1)) else front[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            front[k] = x
            if apart % 2 and abs(apart - k) < d and x + back.get(apart - k, -1) >= n:
                return x, y
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y = x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not apart % 2 and abs(apart - k) <= d and x + front.get(apart - k, -1) >= n:
                return n - x, m - y
    raise AssertionError("frontiers did not meet")


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of tokens that occur once on both sides, the longest run that rises on both."""
    once_a, once_b = Counter(a), Counter(b)
    at = {t: j for j, t in enumerate(b) if once_b[t] == 1}
    pairs = [(i, at[t]) for i, t in enumerate(a) if once_a[t] == 1 and t in at]
    tails, ends, before = [], [], [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before[p] = ends[k - 1] if k else -1
        tails[k:k + 1], ends[k:k + 1] = [j], [p]
    out, p = [], ends[-1] if ends else -1
    while p >= 0:
        out.append(pairs[p])
        p = before[p]
    return out[::-1]


def matches(left: list, right: list, most: int = FAR) -> list[tuple[int, int, int]]:
    """Equal runs (i, j, length) in order, in a script of the least number of deletions and insertions.

    Up to `most` edits the script is a least one. Beyond, the sequences are cut at tokens that both have once; a stretch without such
    tokens is replaced as a whole.
    """
    number: dict = {}
    a, b = ([number.setdefault(t, len(number)) for t in side] for side in (left, right))
    runs: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        k = 0
        while i + k < n and j + k < m and a[i + k] == b[j + k]:
            k += 1
        if k:
            runs.append((i, j, k))
            i, j = i + k, j + k
        k = 0
        while n - k > i and m - k > j and a[n - k - 1] == b[m - k - 1]:
            k += 1
        if k:
            n, m = n - k, m - k
            runs.append((n, m, k))
        if i == n or j == m:
            continue
        got = _meeting(a[i:n], b[j:m], most)
        cuts = [got] if got else [c for x, y in _anchors(a[i:n], b[j:m]) for c in ((x, y), (x + 1, y + 1))]
        for (x, y), (u, v) in zip([(0, 0), *cuts], [*cuts, (n - i, m - j)], strict=True) if cuts else ():
            todo.append((i + x, i + u, j + y, j + v))
    runs.sort()
    out: list[tuple[int, int, int]] = []
    for i, j, k in runs:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def changes(left: list, right: list, most: int = FAR) -> Iterator[tuple[str, int, list, int, list]]:
    """(kind, place, tokens, place, tokens) for each stretch that differs: replace, delete or insert."""
    i = j = 0
    for p, q, k in [*matches(left, right, most), (len(left), len(right), 0)]:
        if i < p or j < q:
            yield "insert" if i == p else "delete" if j == q else "replace", i, left[i:p], j, right[j:q]
        i, j = p + k, q + k


def longest_line(text: Column) -> Column:
    """The longest line of a text with blanks folded, of equals the first in the order of signs; '' if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.coalesce(F.array_max(F.transform(lines, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x")))).getField("x"), F.lit(""))


def relatives(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, of): for each text the smallest key of those that have the same longest line, itself left out. Only keys and hashes are shuffled."""
    h = docs.where(F.col(key).isNotNull()).select(key, longest_line(F.col(text)).alias("line")).where("line <> ''").select(key, F.xxhash64("line").alias("h"))
    first = h.groupBy("h").agg(F.min(key).alias("of"), F.count("*").alias("n")).where("n > 1").select("h", "of")
    return h.join(first, "h").where(F.col(key) != F.col("of")).select(key, "of").distinct()


def edit_script(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, of, kind, before_at, before_line, before, after_at, after_line, after) for each change from the text of `of` to that of `key`, by words.

    pairs: (key, of). Places count words from 0, lines from 1 (a place at the end has the last line); equal texts give no rows, a null text has
    no words, pairs of a key that `docs` lacks none. Of several rows of one key all are compared. Texts are joined for the given pairs only; a task
    holds one pair at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    t = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    joined = pairs.select(key, "of").join(t.select(F.col("_k").alias("of"), F.col("_t").alias("_a")), "of").join(t.select(F.col("_k").alias(key), F.col("_t").alias("_b")), key).select(key, "of", "_a", "_b")

    def words(s: str | None) -> tuple[list[str], list[int]]:
        found = [(w, n) for n, line in enumerate((s or "").split("\n"), 1) for w in line.split()]
        return [w for w, _ in found], [n for _, n in found]

    def run(batches):
        for pdf in batches:
            for k, of, a, b in zip(pdf[key], pdf["of"], pdf["_a"], pdf["_b"], strict=True):
                (left, lines_a), (right, lines_b) = words(a), words(b)
                at = lambda lines, i: lines[min(i, len(lines) - 1)] if lines else 0
                rows = [(k, of, what, i, at(lines_a, i), old, j, at(lines_b, j), new) for what, i, old, j, new in changes(left, right)]
                yield pd.DataFrame(rows, columns=[key, "of", "kind", "before_at", "before_line", "before", "after_at", "after_line", "after"])

    return joined.mapInPandas(run, f"`{key}` {kind}, of {kind}, kind string, before_at int, before_line int, before array<string>, after_at int, after_line int, after array<string>")
