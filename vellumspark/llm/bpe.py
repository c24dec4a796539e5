"""BPE by a tokenization automaton: merges are compiled gadget by gadget into a deterministic automaton over bytes, words are encoded by
table-driven transitions, decoding emits arc labels."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read

#: Words that a worker remembers, signs of a word that it does, and states that it adds to those of the vocabulary's own words; at the bounds it starts afresh, within a word too.
MEMO, LONG, STATES = 350_000, 64, 50_000

#: What str.split() takes for space and the tokenizer doesn't.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Memo(dict):
    """Ids of words, found on first use; a piece of several words is looked up word by word and not kept, nor is a word of more than LONG signs."""

    def __init__(self, find, path):
        super().__init__()
        self.find, self.path = find, path

    def __missing__(self, piece: str) -> bytes:
        words = self.find(piece)
        if words == [piece]:
            if len(piece) > LONG:
                return np.array(self.path(piece), "<u4").tobytes()
            ids = self[piece] = np.array(self.path(piece), "<u4").tobytes()
            return ids
        return b"".join(map(self.__getitem__, words))


class Automaton:
    """A deterministic automaton over the bytes of a word, and one over tokens from which it is compiled.

    The automaton over tokens is built merge by merge. Before any merge every base symbol may follow every other. The gadget of
    merge number r, (u, v) -> w, takes the arc u -> v away and adds the state w, which is entered wherever u could be entered then
    and left wherever v could be left then; it adds nothing where the arc u -> v was gone already. `_arc` tells from the gadgets
    whether the final automaton leads from one token to another; every prefix of a word has exactly one path through it.

    So the last token of each prefix is a function of what was read, and of a prefix only two things matter later: the longest end of
    it that may still become part of a token, and the last tokens of the prefixes that end there. These are the states over bytes.
    `rows` is their table, (state, symbol) -> state, and `last` the arc label of each, its prefix's last token. The last byte of a
    word is a symbol of its own. Rows for all words of the vocabulary are compiled at once; one that is missing is compiled when a
    text first needs it. Encoding a word is one table look-up a byte, with no search, and reading labels back from its end.
    """

    #: Symbols: bytes, and bytes at the end of a word.
    SYMBOLS = 512

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.labels = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.labels[i] = text
        n = len(self.labels)
        self.rank, self.left, self.right, self.merge = [-1] * n, [-1] * n, [-1] * n, {}
        dead = set()
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[w] >= 0 or u in dead or v in dead or not self._arc(u, v, r):
                if self.rank[w] < 0:
                    dead.add(w)
                continue
            self.merge[u, v] = r
            self.rank[w], self.left[w], self.right[w] = r, u, v
        cut = len(self.suffix)
        self.inner, self.final = {}, {}
        self.open = {""}  # what a token may begin with before its end is known
        for text, i in self.vocab.items():
            if i in dead:
                continue
            ended = bool(cut) and text.endswith(self.suffix) and len(text) > cut
            body = text[:-cut] if ended else text
            (self.final if ended else self.inner)[body] = i
            self.open.update(body[:k] for k in range(1, len(body)))
        self.bytes = byte_symbols()
        self.states = [("", (-1,))]
        self.number, self.last, self.rows = {self.states[0]: 0}, [-1], {}
        self.compiled = 1 << 60
        of = {c: b for b, c in enumerate(self.bytes)}
        for text, i in self.vocab.items():
            if i not in dead:
                ended = bool(cut) and text.endswith(self.suffix) and len(text) > cut
                word = [of[c] for c in (text[:-cut] if ended else text) if c in of]
                self._run(word[:-1] + [word[-1] + 256 * (ended or not cut)] if word else [])

    def _arc(self, a: int, b: int, limit: int) -> bool:
        """Whether b may follow a when the merges below `limit` have been built in."""
        rank, left, right, merge = self.rank, self.left, self.right, self.merge
        while True:
            if merge.get((a, b), limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a was made last: it is left as its right part was just before
                limit, a = ra, right[a]
            else:  # b was made last: it is entered as its left part was just after
                limit, b = rb + 1, left[b]

    def _compile(self, state: int, symbol: int) -> int:
        """The row of (state, symbol): the one token that may end the longer prefix, and what of it matters from there on."""
        text, lasts = self.states[state]
        end = symbol >= 256 and self.suffix
        text += self.bytes[symbol % 256]
        tokens = self.final if end else self.inner
        for k in range(len(text)):  # the longest token first; lasts[j] is the last token of the prefix that ends j bytes before the new one
            t = tokens.get(text[k:])
            if t is not None:
                before = lasts[len(text) - k - 1]
                if before < 0 or self._arc(before, t, 1 << 60):
                    break
        else:
            raise ValueError(f"the vocabulary has no token for {text[-1]!r}")
        if symbol >= 256:
            new = ("$", (t,))
        else:
            while text not in self.open:
                text = text[1:]
            new = (text, (t, *lasts)[: len(text) + 1])
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
            self.last.append(t)
        self.rows[state * self.SYMBOLS + symbol] = to
        return to

    def _run(self, symbols: Iterable[int]) -> array:
        """The last token of each prefix."""
        rows, last, state, out = self.rows, self.last, 0, array("i")
        for c in symbols:
            to = rows.get(state * 512 + c)
            if to is None:
                if len(self.states) > self.compiled + STATES:
                    state = self._forget(state)
                    rows = self.rows
                to = self._compile(state, c)
            state = to
            out.append(last[state])
        return out

    def _forget(self, state: int) -> int:
        """Drop the states that texts have asked for, all but one; gives its new number."""
        kept = self.states[state]
        for s in self.states[self.compiled :]:
            del self.number[s]
        del self.states[self.compiled :], self.last[self.compiled :]
        self.rows = {k: to for k, to in self.rows.items() if to < self.compiled and k // self.SYMBOLS < self.compiled}
        if kept not in self.number:
            self.number[kept] = len(self.states)
            self.states.append(kept)
            self.last.append(kept[1][0])
        return self.number[kept]

    def start(self) -> None:
        """What a worker fills as it goes."""
        self.words = Memo(regex.compile(self.pattern).findall, self.path)
        cut = len(self.suffix)
        self.size = [len(t) - (cut if cut and t.endswith(self.suffix) and len(t) > cut else 0) for t in self.labels]
        self.compiled = len(self.states)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def path(self, word: str) -> array:
        """The tokens of one pre-split word."""
        data = word.encode("utf-8", "surrogatepass")
        lasts, i, tokens = self._run(chain(data[:-1], (data[-1] + 256,))), len(data), array("i")
        while i:
            tokens.append(lasts[i - 1])
            i -= self.size[tokens[-1]]
        tokens.reverse()
        return tokens

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (little-endian, 32 bits)."""
        if not text:
            return b""
        out = []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case is taken sign by sign: no final sigma
            if len(self.words) > MEMO:
                self.words.clear()
            part = part.lower()
            out += map(self.words.__getitem__, self.words.find(part) if ODD_SPACE.search(part) else part.split())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _local(shared) -> Automaton:
    """The worker's automaton; its tables last as long as the worker keeps the broadcast."""
    a = shared.value
    if not hasattr(a, "words"):
        a.start()
    return a


def _mapped(df: DataFrame, column: str, out: str, kind: str, shared, make) -> DataFrame:
    """`df` with `out` (of SQL type `kind`), made from `column` by make(automaton, value)."""
    names = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    at, arrow = names.index(column), pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _local(shared)
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 200):  # ids of a few texts at a time
                part = batch.slice(k, 200)
                made = pa.array([make(a, x) for x in part.column(at).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` {kind}")


def automaton(spark: SparkSession, path: str):
    """A vocabulary file's automaton, as a broadcast: its size is the vocabulary's, a few MB."""
    return spark.sparkContext.broadcast(Automaton(path))


def encode(df: DataFrame, shared, text_col: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the token ids of each whole text as binary `out`: little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Rows are kept one for one, repeated ones too; a column that is already named `out` is
    replaced, all others are kept; empty tables stay empty. No shuffle.
    """
    return _mapped(df, text_col, out, "binary", shared, Automaton.encode)


def decode(df: DataFrame, shared, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of each row's ids, as the vocabulary has no decoder: the arcs' labels with a space between them. Null ids give ''."""
    return _mapped(df, ids_col, out, "string", shared, lambda a, ids: a.decode(ids or b""))


def n_tokens(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    shared = automaton(spark, default_path())
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), shared)
    back = decode(coded.select("doc_id", "ids"), shared)
    return back.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
