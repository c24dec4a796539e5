"""Near-dedup, line dedup and page extraction against plain brute force on whole small tables."""

import collections
import html as entities
import re

import numpy as np

from vellumspark.llm import html, linedup, neardup

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_near_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.where("doc_id < 40").selectExpr("doc_id + 5000 AS doc_id", "regexp_replace(text, '(\\\\S+)$', 'zzz') AS text")
    docs = docs.select("doc_id", "text").union(extra)
    sets = {}
    for r in docs.collect():
        w = r.text.lower().encode().split()
        k = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    u, ids = Union(), sorted(sets)
    for i, a in enumerate(ids):
        u.find(a)
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    got = neardup.link(spark, docs).collect()
    assert {r.id: (r.component, r.n_shingles) for r in got} == {i: (u.find(i), len(sets[i])) for i in ids}


def test_blocks_hold_all_pairs(spark, monkeypatch):
    """With small nodes and blocks the large-node path runs; a chain of near copies must stay one component."""
    for name, value in (("NODE", 4), ("BLOCK", 3), ("DEPTH", 2)):
        monkeypatch.setattr(neardup, name, value)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(base[k:] + [f"x{k}_{j}" for j in range(k)]) if k < 20 else " ".join(base[:40] + [f"y{k}_{j}" for j in range(20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(neardup.Sets()(t).tolist()) for i, t in rows}
    u = Union()
    for a in sets:
        u.find(a)
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    u.join(a, b)
    assert {r.id: r.component for r in neardup.link(spark, docs).collect()} == {i: u.find(i) for i in sets}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    """Edit similarity alone, over all pairs of lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    spots = collections.defaultdict(list)
    for i in sorted(texts):
        for p, line in enumerate(texts[i].split("\n")):
            if w := tuple(x for x in re.split("[^a-z0-9\u0080-\U0010ffff]+", line.lower()) if x):
                spots[w].append((i, p))
    lines, u = list(spots), Union()
    sizes, bags = [len(w) for w in lines], [collections.Counter(w) for w in lines]
    by_word = collections.defaultdict(list)
    for i, w in enumerate(lines):
        u.find(i)
        for x in set(w):
            by_word[x].append(i)
    # a pair within `most` edits has all but `most` of the longer line's words in common, so it shares one of its most + 1 rarest
    for i, w in enumerate(lines):
        most_i = int(sizes[i] * 0.2 / 0.8 + 1)
        near = {j for x in sorted(set(w), key=lambda x: len(by_word[x]))[: most_i + 1] for j in by_word[x] if j != i}
        for j in near:
            most = int(max(sizes[i], sizes[j]) * (1 - linedup.SIMILARITY) + 1e-9)
            if abs(sizes[i] - sizes[j]) <= most and sum((bags[i] & bags[j]).values()) >= max(sizes[i], sizes[j]) - most and u.find(i) != u.find(j) and _distance(w, lines[j]) <= most:
                u.join(i, j)
    groups = collections.defaultdict(list)
    for i, w in enumerate(lines):
        groups[u.find(i)] += spots[w]
    gone = {s for g in groups.values() for s in sorted(g)[1:]}
    got = {r.doc_id: r.text for r in linedup.clean(spark, docs).collect()}
    assert got == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}


def test_pages(spark):
    model = html.train()
    sources = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for source, text in zip(sources, html.texts(model, sources), strict=True):
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]+>", "", x.replace("<br>", "\n"))).split()) for x in re.split("<p>|</p>|</?h1>", article)]
        assert text == "\n".join(x for x in parts if x)


def test_marginals_equal_enumeration():
    page = html.parse("<div class=content><p>a</p><div class=ad>b<span class=x>c</span></div></div>")
    model = html.train()
    unary = np.zeros((len(page.tags), 3))
    for i, own in enumerate(html.features(page)):
        for f in own:
            unary[i, 1:] += model.weights.get(f, (0.0, 0.0))
    total = np.zeros((len(page.tags), 3))
    for states in np.ndindex(*[3] * len(page.tags)):
        s = sum(unary[i, y] for i, y in enumerate(states))
        s += sum(model.pair[int(page.tags[i] in html.LEAVES), states[page.parents[i]], states[i]] for i in range(1, len(states)))
        for i, y in enumerate(states):
            total[i, y] += np.exp(s)
    assert np.allclose(model.marginals([page])[0], (total / total.sum(axis=1, keepdims=True))[:, 1])
