"""Benchmark decontamination: a broadcast hash set of normalised windows against every document's token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, read

WINDOW = 10
SPANS = "array<struct<start:int,end:int>>"
#: Benchmark bytes that one broadcast may hold: with its words and windows some 120 MB in a worker at the most. A larger benchmark is
#: scanned in blocks of items, one pass over the documents each.
BLOCK_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that are part of a word keep their value (capitals lowered); all other ASCII becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out = (out ^ h[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """Every window of the items as a sorted array of hashes; a hit is verified on the words, which are kept as text."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.names = [i for i, _ in items]
        self.ids: dict[bytes, int] = {}  # the words that the items have, and by number their hashes
        self.hash: list[int] | np.ndarray = []
        self.words: list[tuple[bytes, np.ndarray]] = []  # per item: its words with one space between, and where each begins (and one past the end)
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, (_, text) in enumerate(items):
            w = words(text)
            self.words.append((b" ".join(w), np.cumsum([0, *(len(x) + 1 for x in w)], dtype=np.int64).astype(np.int32)))
            if w:
                k = min(size, len(w))
                h = rolled(np.array([self.hash_of(x) for x in w], np.uint64), k)
                found.setdefault(k, []).append((h, np.full(len(h), n, np.int32), np.arange(len(h), dtype=np.int32)))
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64, np.ndarray]] = {}
        for k, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            # a table of the hashes' first bits, at most a sixteenth full, tells of most windows that they are none
            bits = max(10, int(16 * len(h)).bit_length())
            first = np.zeros(1 << bits, bool)
            first[h >> np.uint64(64 - bits)] = True
            self.found[k] = (h[order], item[order], at[order], np.uint64(64 - bits), first)
        self.hash = np.array([*self.hash, 0], np.uint64)  # the last is that of unknown words

    def hash_of(self, word: bytes) -> int:
        n = self.ids.get(word)
        if n is None:
            n = self.ids[word] = len(self.ids)
            self.hash.append(xxhash.xxh64_intdigest(word))
        return self.hash[n]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit spans [from, to) in words (merged), items that occur."""
        w = words(text)
        spans, items = [], set()
        if w and self.found:
            get = self.ids.get
            at_words = np.array([get(x, -1) for x in w], np.int64)
            unknown = np.concatenate([[0], np.cumsum(at_words < 0)])
            h = None
            for k, (known, item, at, shift, first) in self.found.items():
                if len(w) < k:
                    continue
                maybe = np.flatnonzero(unknown[k:] == unknown[: len(w) - k + 1])  # windows of words that the benchmark has
                if not len(maybe):
                    continue
                h = self.hash[at_words] if h is None else h
                mine = rolled(h, k)
                maybe = maybe[first[mine[maybe] >> shift]]
                if not len(maybe):
                    continue
                mine = mine[maybe]
                low = np.searchsorted(known, mine)
                for x in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == mine):
                    i = int(maybe[x])
                    window, j, hit = b" ".join(w[i : i + k]), int(low[x]), False
                    while j < len(known) and known[j] == mine[x]:
                        body, begins = self.words[item[j]]
                        if body[begins[at[j]] : begins[at[j] + k] - 1] == window:
                            items.add(int(item[j]))
                            hit = True
                        j += 1
                    if hit:
                        spans.append((i, i + k))
        return len(w), union(spans), items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks that each fit one broadcast, one block at a time on the driver; the usual benchmark is one block."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null").distinct().orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        size += len((r.t or "").encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of `docs`: id, n_words, spans array<struct<start,end>> in words, items array<string>.

    Null and empty texts have no words and no hits; null ids and repeated rows are kept as rows. Items without an id or
    without words match nothing; an item given twice counts once. Other columns are not read. An empty benchmark hits nothing.
    No shuffle: the windows are broadcast in blocks of bounded size, one pass over the documents for each block.
    """
    prepare(spark)
    scratch, df, kind = Scratch(spark), docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString()
    df = df.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>")})
    for n, block in enumerate(_blocks(benchmark, item_col, item_text)):
        if n:
            df = scratch.keep(df)  # one block's windows in a worker at a time
        df = df.mapInArrow(_pass(spark.sparkContext.broadcast(Windows(block, size))), f"id {kind}, text string, n_words long, spans {SPANS}, items array<string>")
    return df.drop("text")


def _pass(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = [], [], []
            for text, s0, i0 in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                n, s, who = table.value.scan(text)
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in union(s + [(x["start"], x["end"]) for x in s0 or ()])])
                items.append(sorted({table.value.names[i] for i in who} | set(i0 or ())))
            cols = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text", "n_words", "spans", "items"])

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **cols) -> DataFrame:
    """`docs` without its contaminated rows, or (mode "spans") with the hit words cut out of their texts.

    Cutting keeps what stands between words, null texts stay null. Every other row and all columns are as before.
    """
    prepare(spark)
    text_col = cols.get("text_col", "text")
    if mode == "spans":
        return _cut_spans(spark, docs, benchmark, cols)
    scratch, last = Scratch(spark), None
    for n, block in enumerate(_blocks(benchmark, cols.get("item_col", "item_id"), cols.get("item_text", "text"))):
        if n:  # one block's windows in a worker at a time
            docs, gone = scratch.keep(docs), last
            last = docs
            if gone is not None:
                scratch.drop(gone)
        table, at = spark.sparkContext.broadcast(Windows(block)), docs.columns.index(text_col)

        def run(batches, table=table, at=at):
            for batch in batches:
                yield batch.filter(pa.array([not table.value.scan(t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _cut_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Spans of all blocks are found on the whole text before any is cut, as a cut would hide windows that overlap it."""
    text_col, scratch = cols.get("text_col", "text"), Scratch(spark)
    df = docs.withColumn("_dc_spans", F.lit(None).cast(SPANS))
    at, kind = docs.columns.index(text_col), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for n, block in enumerate(_blocks(benchmark, cols.get("item_col", "item_id"), cols.get("item_text", "text"))):
        if n:
            df = scratch.keep(df)
        table = spark.sparkContext.broadcast(Windows(block))

        def find(batches, table=table):
            for batch in batches:
                spans = []
                for text, before in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    s = table.value.scan(text)[1] + [(x["start"], x["end"]) for x in before or ()]
                    spans.append([{"start": a, "end": b} for a, b in union(s)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], names=batch.schema.names)

        df = df.mapInArrow(find, df.schema)

    def drop(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            made = [cut(t, [(x["start"], x["end"]) for x in s or ()]) for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return df.mapInArrow(drop, docs.schema)


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words in `spans` and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
