"""Edit-aware token counts: a segment tree over each document's pre-tokens, of which an edit touches a few leaves.

A leaf holds a run of pre-tokens with their lengths and token counts, the tree above it sums of both. An edit finds its leaves by
descent, pre-tokens are cut anew from a little before it until a cut meets an old one after it, only those are encoded, and
the sums on the way to the root are put right. Counts of pre-tokens are remembered, as they recur.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read

#: Pre-tokens of a leaf when a tree is built, and how many it may grow to before the tree is built anew.
LEAF, GROWN = 64, 256
#: Signs after its end that the cut of a pre-token may depend on.
CONTEXT = 3
MEMO = 400_000
EDIT = "array<struct<start:int,end:int,text:string>>"


class Counter(dict):
    """Tokens of a pre-token, counted on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.cut = regex.compile(pattern)
        self.piece = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> int:
        n = len(self.piece(word.encode("utf-8", "surrogatepass")))
        if len(self) < MEMO:
            self[word] = n
        return n


class Tree:
    """Counts of one document. `text` is its present text, `encoded` the pre-tokens that edits have had encoded."""

    def __init__(self, text: str | None, counter: Counter):
        self.text, self.counter, self.encoded = text or "", counter, 0
        words = counter.cut.findall(self.text)
        self._build(list(map(len, words)), list(map(counter.__getitem__, words)))

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (s, c) in enumerate(self.leaves):
            self.chars[self.base + k], self.tokens[self.base + k] = sum(s), sum(c)
        for k in range(self.base - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the sign before position `at`, or the first one, and where it begins."""
        k, begin = 1, 0
        while k < self.base:
            k *= 2
            if at > begin + self.chars[k]:
                begin += self.chars[k]
                k += 1
        return min(k - self.base, len(self.leaves) - 1), begin

    def _put(self, k: int, sizes: list[int], counts: list[int]) -> None:
        self.leaves[k] = (sizes, counts)
        k += self.base
        self.chars[k], self.tokens[k] = sum(sizes), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by `new`. Positions beyond the text count as its end, an end before the start as the start."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(new) - (end - start)
        first, begin = self._leaf(max(0, start - CONTEXT))
        sizes, _ = self.leaves[first]
        ends = list(accumulate(sizes, initial=begin))
        keep = max(0, bisect_right(ends, start - CONTEXT) - 1)  # pre-tokens of the leaf that end CONTEXT before the edit
        at = ends[keep]
        self.text = self.text[:start] + new + self.text[end:]
        last, stop, old = first, ends[-1], ends  # the old cuts of leaves first to last
        words: list[str] = []
        for m in self.counter.cut.finditer(self.text, at):
            words.append(m[0])
            back = m.end() - shift
            if m.end() < start + len(new) + (not new):
                continue
            while back > stop and last + 1 < len(self.leaves):
                last += 1
                old = [*old, *list(accumulate(self.leaves[last][0], initial=stop))[1:]]
                stop = old[-1]
            if back >= end and (i := bisect_left(old, back)) < len(old) and old[i] == back:
                break
        else:
            back = None
        sizes = [s for k in range(first, last + 1) for s in self.leaves[k][0]]
        counts = [c for k in range(first, last + 1) for c in self.leaves[k][1]]
        rest = bisect_left(old, back) if back is not None else len(sizes)
        if back is None:
            last = len(self.leaves) - 1
        new_sizes = sizes[:keep] + list(map(len, words)) + sizes[rest:]
        new_counts = counts[:keep] + [self.counter[w] for w in words] + counts[rest:]
        self.encoded += len(words)
        for k in range(first + 1, last + 1):
            self._put(k, [], [])
        self._put(first, new_sizes, new_counts)
        if len(new_sizes) > GROWN:
            self._build([s for leaf in self.leaves for s in leaf[0]], [c for leaf in self.leaves for c in leaf[1]])


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, p.PATTERN


def count(spark: SparkSession, docs: DataFrame, vocabulary: tuple[dict[bytes, int], str] | None = None, text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """`docs` with n_tokens of each whole text and, where `edits_col` holds edits (start, end, text; in signs, each on the text that the
    one before left), n_tokens_edited and n_reencoded, the pre-tokens that the edits had encoded.

    Null and empty texts have no tokens and can be edited; null edits, or null parts of one, change nothing. Rows are kept one for
    one, repeated ones too; columns of these three names are replaced, all others kept; empty tables stay empty. No shuffle.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary or default_vocabulary())
    names = [c for c in docs.columns if c not in ("n_tokens", "n_tokens_edited", "n_reencoded")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at, edits = names.index(text_col), names.index(edits_col) if edits_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            before, after, encoded = [], [], []
            todo = batch.column(edits).to_pylist() if edits is not None else [None] * batch.num_rows
            for text, changes in zip(batch.column(at).to_pylist(), todo, strict=True):
                tree = Tree(text, counter)
                before.append(tree.total)
                for e in changes or ():
                    if e is not None and None not in (e["start"], e["end"], e["text"]):
                        tree.edit(e["start"], e["end"], e["text"])
                after.append(tree.total)
                encoded.append(tree.encoded)
            made = [pa.array(x, pa.int64()) for x in (before, after, encoded)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_tokens", "n_tokens_edited", "n_reencoded"])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, n_tokens long, n_tokens_edited long, n_reencoded long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after a fixed revision: a cut in its first third, a note after its middle, a new opening."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    part = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), F.lit(t).alias("text"))
    edits = F.array(part(third, third + 12, ""), part(half, half, " [see note 7] "), part(F.lit(0), F.lit(1), "Revised: "))
    return count(spark, docs.withColumn("edits", edits), edits_col="edits").select("doc_id", "n_tokens", "n_tokens_edited", "n_reencoded")
