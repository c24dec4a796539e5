"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that can matter is a variable with three states: what surrounds the main text (0), main text (1), or a frame that
holds both (2). Its own features (tag, class words, link share, length) give a unary potential, each parent-child pair a potential by the child's kind. Sum-product messages up and down the
tree give exact marginals; text is kept where state 1 of its element has a marginal above one half. The potentials are trained on the
labelled pages of `htmlpages` by gradient ascent on the likelihood.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmlpages
from .common import prepare, read

INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose text is never part of a page's running text.
SILENT = set("head noscript template object svg math canvas select button audio video datalist map".split())
#: Scopes of the HTML standard, "The stack of open elements": an element beyond one of these is out of reach of an implied end tag.
SCOPE = {"#", "caption", "html", "table", "td", "th", "marquee", "object", "template"}
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, {"#", "html", "table", "template"}
#: Block start tags, before which an open paragraph ends.
BLOCKS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary ul"
    " h1 h2 h3 h4 h5 h6 li dd dt table".split()
)
#: Start tags that end other open elements, with the scope they look in, by the standard's "in body" and "in table" insertion modes.
IMPLIED_ENDS = [
    ({"li"}, {"li"}, LIST_SCOPE), ({"dd", "dt"}, {"dd", "dt"}, LIST_SCOPE), (BLOCKS, {"p"}, BUTTON_SCOPE),
    ({"td", "th"}, {"td", "th"}, TABLE_SCOPE | {"tr"}), ({"tr"}, {"tr"}, TABLE_SCOPE), ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot"}, TABLE_SCOPE), ({"option"}, {"option"}, SCOPE),
]
ENDS = {tag: [(ended, scope) for tags, ended, scope in IMPLIED_ENDS if tag in tags] for tags, _, _ in IMPLIED_ENDS for tag in tags}
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption figure caption table tbody ul ol dl".split()) | INLINE

STATES = 3
#: Messages go one depth after another for pages nested up to this; in deeper ones from element to element.
DEEP = 200

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)?(?:\s*(=)\s*)?""")
VALUE = re.compile(r"""[^\s>]*""")
#: Attributes whose words tell what an element is for.
TELLING = {"class", "id", "role"}
#: The attribute with an element's state in labelled pages; read in training only.
LABEL = "data-k"
CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Page:
    """Elements in document order (a parent precedes its children) and the page's blocks as pieces (element, text)."""

    tags: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)

    def add(self, tag: str, attrs: dict[str, str], parent: int) -> int:
        words = tuple(w for k in sorted(TELLING & attrs.keys()) for w in re.split(r"[^a-z]+", CAMEL.sub(r"\1 \2", attrs[k]).lower()) if w)
        self.tags.append(tag)
        self.words.append(words)
        self.parents.append(parent)
        self.labels.append(int(attrs[LABEL]) if LABEL in attrs else -1)
        self.chars.append(0)
        self.linked.append(0)
        return len(self.tags) - 1

    def told(self) -> Page:
        """The page without elements that hold no text, which no result depends on."""
        below = self.chars[:]
        for i in range(len(below) - 1, 0, -1):
            below[self.parents[i]] += below[i]
        keep = [i for i in range(len(below)) if below[i] or not i]
        if len(keep) == len(below):
            return self
        new = dict(zip(keep, range(len(keep)), strict=True))
        of = lambda x: [x[i] for i in keep]
        return Page(of(self.tags), of(self.words), [new.get(p, -1) for p in of(self.parents)], of(self.labels), of(self.chars), of(self.linked), [[(new[at], s) for at, s in b if at in new] for b in self.blocks])


class Reader:
    """Start and end tags of a source, each sign looked at a bounded number of times: what is known not to come is not sought again."""

    def __init__(self, source: str, labelled: bool):
        self.source, self.end = source, len(source)
        self.last_gt, self.wanted = source.rfind(">"), TELLING | {LABEL} if labelled else TELLING
        self.gone: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Where `what` comes next, or -1."""
        if at >= self.gone.get(what, self.end + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def tag(self, lt: int) -> tuple[str, dict[str, str], int] | None:
        """The name ("/" before that of an end tag), telling attributes and end of the tag at `lt`; None where there is no tag.

        Comments, declarations and instructions have the name "". A quote that is never closed does not count as one.
        """
        s = self.source
        if s.startswith("<!--", lt):
            at = self.find("-->", lt + 4)
            return "", {}, at + 3 if at >= 0 else self.end
        if lt + 1 < self.end and s[lt + 1] in "!?":
            at = self.find(">", lt)
            return "", {}, at + 1 if at >= 0 else self.end
        m = NAME.match(s, lt + 1) if lt < self.last_gt else None
        if m is None:
            return None
        attrs, at, known = {}, m.end(), m[0].lower()
        while s[at] != ">":
            a = ATTR.match(s, at)
            at = a.end()
            if at >= self.end:
                return None
            value = ""
            if s[at] in "\"'" and (a[2] or not a[1]):
                close = self.find(s[at], at + 1)
                if 0 <= close < self.last_gt:
                    value, at = s[at + 1 : close], close + 1
                else:
                    at += 1
            elif a[2]:
                v = VALUE.match(s, at)
                value, at = v[0], v.end()
            if a[1] and (key := a[1].lower()) in self.wanted and key not in attrs:
                attrs[key] = value
        return known, attrs, at + 1


def parse(source: str | None, labelled: bool = False) -> Page:
    """A forgiving parser: implied and missing end tags, raw elements, comments and stray signs as browsers take them, more or less.

    labelled: read the states that pages for training carry. Time is in proportion to the source's length.
    """
    page = Page()
    root = page.add("#", {}, -1)
    stack: list[tuple[str, int]] = [("#", root)]
    count: Counter[str] = Counter({"#": 1})
    state = {"silent": 0, "links": 0}
    block: list[tuple[int, str]] = []
    source = source or ""
    reader = Reader(source, labelled)

    def flush() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def pop() -> None:
        tag, _ = stack.pop()
        count[tag] -= 1
        state["silent"] -= tag in SILENT
        state["links"] -= tag == "a"
        if tag not in INLINE:
            flush()

    def close(ended: set[str], scope: set[str]) -> None:
        """End the innermost open element of `ended` and all in it, unless an element of `scope` lies between."""
        if any(count[t] for t in ended):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in scope:
                    return

    def text(raw: str) -> None:
        if raw and not state["silent"]:
            at = stack[-1][1]
            s = entities.unescape(raw) if "&" in raw else raw
            block.append((at, s))
            n = len(s)
            page.chars[at] += n
            if state["links"]:
                page.linked[at] += n

    pos, end = 0, len(source)
    while pos < end:
        lt = source.find("<", pos)
        if lt < 0:
            text(source[pos:])
            break
        got = reader.tag(lt)
        if got is None:
            text(source[pos : lt + 1])
            pos = lt + 1
            continue
        text(source[pos:lt])
        tag, attrs, pos = got
        if not tag:
            continue
        if tag[0] == "/":
            if count[tag[1:]]:
                close({tag[1:]}, set())
            continue
        if tag in RAW:
            at = raw_end(reader, tag, pos)
            gt = reader.find(">", at) if at >= 0 else -1
            pos = gt + 1 if gt >= 0 else end
            continue
        if tag == "br":
            text("\n")
            continue
        if count["head"] and (tag == "body" or tag in BLOCKS):
            close({"head"}, set())
        for ended, scope in ENDS.get(tag, ()):
            close(ended, scope)
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        parent = stack[-1][1]
        plain = tag in INLINE and not attrs
        stack.append((tag, parent if plain or state["silent"] else page.add(tag, attrs, parent)))
        count[tag] += 1
        state["silent"] += tag in SILENT
        state["links"] += tag == "a"
    flush()
    return page.told()


def raw_end(reader: Reader, tag: str, at: int) -> int:
    """Where the end tag of a raw element begins, or -1."""
    while (at := reader.find("</", at)) >= 0:
        after = at + 2 + len(tag)
        if reader.source[at + 2 : after].lower() == tag and reader.source[after : after + 1] in (">", "/", " ", "\t", "\n", "\r", "\f"):
            return at
        at += 2
    return -1


def features(page: Page) -> list[list[str]]:
    """Per element: its tag, class words, and the link share of the text below it."""
    chars, linked = page.chars[:], page.linked[:]
    for i in range(len(chars) - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        linked[page.parents[i]] += linked[i]
    out = []
    for tag, words, c, k in zip(page.tags, page.words, chars, linked, strict=True):
        share = k / c if c else 0
        own = [f"t:{tag}", "k:-" if not c else "k:0" if share == 0 else "k:s" if share < 0.3 else "k:m" if share < 0.8 else "k:x"]
        out.append(own + [f"c:{w}" for w in set(words)])
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


class Forest:
    """Trees of several pages as arrays, with messages passed one depth at a time for all pages together."""

    def __init__(self, pages: list[Page]):
        parents, leaf, base = [], [], 0
        self.base = []
        for p in pages:
            self.base.append(base)
            parents += [q + base if q >= 0 else -1 for q in p.parents]
            leaf += [t in LEAVES for t in p.tags]
            base += len(p.tags)
        self.parents, self.kind = np.array(parents, np.int64), np.array(leaf, np.int64)
        depth = np.zeros(base, np.int64)
        for i, q in enumerate(parents):
            if q >= 0:
                depth[i] = depth[q] + 1
        ends = [*self.base[1:], base]
        self.deep = [(a, b) for a, b in zip(self.base, ends, strict=True) if depth[a:b].max(initial=0) > DEEP]
        for a, b in self.deep:
            depth[a:b] = 0
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = []  # without the roots: elements, their parents, and where each parent's children begin; both in document order
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                own, first = np.unique(self.parents[order[a:b]], return_index=True)
                self.levels.append((order[a:b], own, first))

    def run(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals (n, 3) and pair marginals (n, 3, 3) of (parent, child), from log potentials unary (n, 3) and pair (kinds, 3, 3)."""
        below, up = unary.copy(), np.zeros_like(unary)
        for at, own, first in reversed(self.levels):
            up[at] = _log_sum(pair[self.kind[at]] + below[at][:, None, :], 2)
            below[own] += np.add.reduceat(up[at], first, axis=0)
        full, both = below.copy(), np.zeros((len(unary), STATES, STATES))
        for at, _, _ in self.levels:
            rest = full[self.parents[at]] - up[at]  # the parent's belief without this child
            joint = rest[:, :, None] + pair[self.kind[at]] + below[at][:, None, :]
            full[at] = _log_sum(joint, 1)
            both[at] = np.exp(joint - _log_sum(joint.reshape(len(at), STATES * STATES), 1)[:, None, None])
        return np.exp(full - _log_sum(full, 1)[:, None]), both


    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Each element's probability of state 1."""
        out = self.run(unary, pair)[0][:, 1]
        for a, b in self.deep:
            out[a:b] = one_by_one((self.parents[a:b] - a).tolist(), self.kind[a:b].tolist(), unary[a:b], pair)
        return out


def one_by_one(parents: list[int], kind: list[int], unary: np.ndarray, pair: np.ndarray) -> list[float]:
    """The same messages for one page of any depth: up from the last element to the first, since a parent precedes its children, and down again.

    In probabilities, each message scaled to a sum of 1, so nothing runs out of range.
    """
    def scaled(x, y, z):
        s = x + y + z
        return x / s, y / s, z / s

    own = [scaled(*u) for u in np.exp(np.clip(unary - unary.max(axis=1, keepdims=True), -300, 0)).tolist()]
    table = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)).tolist()
    below, up = own[:], [(1.0, 1.0, 1.0)] * len(own)
    for i in range(len(own) - 1, 0, -1):
        (a, b, c), t, p = below[i], table[kind[i]], parents[i]
        m = up[i] = scaled(*[r[0] * a + r[1] * b + r[2] * c for r in t])
        x, y, z = below[p]
        below[p] = scaled(x * m[0] + 1e-300, y * m[1] + 1e-300, z * m[2] + 1e-300)
    full = below[:]
    for i in range(1, len(own)):
        t, m = table[kind[i]], up[i]
        rest = [f / max(u, 1e-300) for f, u in zip(full[parents[i]], m, strict=True)]
        x, y, z = below[i]
        full[i] = scaled(*[b * (rest[0] * t[0][k] + rest[1] * t[1][k] + rest[2] * t[2][k]) + 1e-300 for k, b in enumerate((x, y, z))])
    return [f[1] for f in full]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]
    pair: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Per page, each element's probability of being main text."""
        forest, w, none = Forest(pages), self.weights, (0.0, 0.0)
        unary = np.zeros((len(forest.parents), STATES))
        i = 0
        for p in pages:
            for own in features(p):
                got = [w.get(f, none) for f in own]
                unary[i, 1], unary[i, 2] = sum([g[0] for g in got]), sum([g[1] for g in got])
                i += 1
        m = forest.marginals(unary, self.pair)
        return [m[b : b + len(p.tags)] for b, p in zip(forest.base, pages, strict=True)]


def render(node) -> str:
    tag, words, kind, inner = node
    mark = (f' class="{words}"' if words else "") + f' data-k="{kind}"'
    return f"<{tag}{mark}>{inner if isinstance(inner, str) else ''.join(map(render, inner))}</{tag}>"


@cache
def fitted() -> Model:
    """The model of the labelled pages, fitted once in a process."""
    return train()


def train(labelled: list[str] | None = None, epochs: int = 80, rate: float = 0.6, decay: float = 1e-5) -> Model:
    """Potentials from labelled pages: HTML whose elements carry their state as data-k; those without it are unobserved."""
    pages = [parse(s, labelled=True) for s in (labelled or map(render, htmlpages.pages()))]
    forest, feats = Forest(pages), [own for p in pages for own in features(p)]
    names = {f: i for i, f in enumerate(sorted({f for own in feats for f in own}))}
    row = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
    col = np.array([names[f] for own in feats for f in own])
    label = np.array([x for p in pages for x in p.labels])
    w, pair = np.zeros((len(names), 2)), np.zeros((2, STATES, STATES))
    clamp = np.where((label[:, None] >= 0) & (label[:, None] != np.arange(STATES)[None, :]), -1e9, 0.0)
    child = forest.parents >= 0
    mw = vw = mp = vp = 0.0
    for t in range(1, epochs + 1):
        unary = np.zeros((len(label), STATES))
        for c in (0, 1):
            unary[:, c + 1] = np.bincount(row, w[col, c], len(label))
        free, free2 = forest.run(unary, pair)
        held, held2 = forest.run(unary + clamp, pair)
        more = held - free
        gw = np.stack([np.bincount(col, more[row, c + 1], len(names)) for c in (0, 1)], axis=1) / len(pages) - decay * w
        gp = np.stack([(held2 - free2)[child & (forest.kind == k)].sum(axis=0) for k in (0, 1)]) / len(pages) - decay * pair
        mw, vw, mp, vp = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mp + 0.1 * gp, 0.99 * vp + 0.01 * gp**2
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w = w + rate * (mw / a) / (np.sqrt(vw / b) + 1e-6)
        pair = pair + rate * (mp / a) / (np.sqrt(vp / b) + 1e-6)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, pair)


def texts(model: Model, sources: list[str | None]) -> list[str]:
    """The main text of each page: blocks in page order, joined by newlines; '' where there is none."""
    pages = [parse(s) for s in sources]
    out = []
    for page, m in zip(pages, model.marginals(pages) if pages else [], strict=True):
        blocks = (" ".join("".join([s for at, s in block if m[at] > 0.5]).split()) for block in page.blocks)
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(spark: SparkSession, pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text of each whole page. Null and empty pages give ''; rows are kept one for one, repeated ones
    too; a column that is already named `out` is replaced, all others are kept; empty tables stay empty. No shuffle."""
    prepare(spark)
    model = spark.sparkContext.broadcast(fitted())
    names = [c for c in pages.columns if c != out]
    pages = pages.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 100):
                part = batch.slice(k, 100)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts(model.value, part.column(at).to_pylist()), pa.string())], names=[*part.schema.names, out])

    return pages.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pages.schema)}, `{out}` string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
