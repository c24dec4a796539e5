"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document's set is reduced to minwise tokens. Each tree branches its documents by a few selected tokens; documents that share
the token fall into one node. Small nodes are compared exhaustively, large ones branch again by tokens not used above, and
enough trees are grown that a pair at the similarity bound misses all of them with probability below 1 - RECALL.

Links only have to connect groups, so a node first compares its members with one or a few of them, and only nodes that still hold
several groups are compared further; a large group of near copies costs as many comparisons as it has members. Links are
always confirmed on full sets. Exact copies of a set are one node of the graph from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, prepare, read

WORDS = 5
PERCENT = 75
RECALL = 1 - 1e-7
#: Minwise tokens of a set, and how many must agree before two sets are compared in full: 5.5 standard deviations below 0.75.
TOKENS, AGREE = 64, 29
#: Members of a node that one task compares.
NODE = 1024
#: Members of a large dense node are compared in blocks of this size, two in a task.
BLOCK = 1024
#: Tokens by which a large node branches at each level, of those that its tree has not used, and how often it may branch. As a pair at
#: the bound shares a token with probability 0.75, two tokens make it outlive any number of levels in most of the trees it shares.
FANOUT, DEPTH = 2, 5
#: Members of a large node that are compared with all its others at first, besides the most popular one.
LEADERS = 4
#: Mean agreement with the most popular member from which branching would not take a large node apart.
DENSE = 0.6
MEMBER = "node long, rep long, tree int"
MEMO = 300_000

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * TOKENS + WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POWERS, FACTORS, SHIFTS = _SEEDS[:WORDS] | np.uint64(1), _SEEDS[WORDS : WORDS + TOKENS] | np.uint64(1), _SEEDS[WORDS + TOKENS :]


def roots() -> list[int]:
    """The tokens by which the trees branch at first.

    Each tree selects a token with probability 1 / (similarity * TOKENS), as a chosen path does; trees are added until together
    they have as many tokens as the recall asks for.
    """
    need, out, tree = math.ceil(math.log(1 - RECALL) / math.log(1 - PERCENT / 100)), [], 0
    while len(out) < min(need, TOKENS):
        tree += 1
        for i, x in enumerate(mix(np.arange(tree * 1000, tree * 1000 + TOKENS, dtype=np.uint64))):
            if i not in out and float(x) / 2**64 < 100 / (PERCENT * TOKENS):
                out.append(i)
    return out[:need]


ROOTS = roots()


def deeper(tree: int, level: int) -> list[int]:
    """The tokens by which a tree branches at a level from 1: in an order of its own, of those that are no root."""
    rest = np.array([i for i in range(TOKENS) if i not in ROOTS])
    order = rest[np.argsort(mix(rest.astype(np.uint64) + np.uint64(1000 * (tree + 1))))]
    return order[FANOUT * (level - 1) : FANOUT * level].tolist()


class Numbers(dict):
    """Words' numbers, and by number their hashes; filled on first use."""

    def __init__(self):
        super().__init__()
        self.hash = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
        self.hash[n] = xxhash.xxh64_intdigest(word)
        return n


class Sets:
    """Distinct 5-word shingles of texts, as sorted 64-bit hashes."""

    def __init__(self):
        self.memo = Numbers()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        at = np.array(list(map(memo.__getitem__, words)), np.int64)
        h = memo.hash[at]
        k = min(WORDS, len(h))
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s += h[j : len(h) - k + 1 + j] * POWERS[j]
        return np.unique(mix(s + np.uint64(k)))


def minwise(s: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 2048):
        np.minimum(out, (s[None, k : k + 2048] * FACTORS[:, None] + SHIFTS[:TOKENS, None]).min(axis=1), out=out)
    return mix(out + np.arange(TOKENS, dtype=np.uint64))


def jaccard_linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Sets()
    for batch in batches:
        n, f1, f2, keys, sigs = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = sets(text)
            d = xxhash.xxh3_128_digest(s.tobytes())
            n.append(len(s))
            f1.append(int.from_bytes(d[:8], "little", signed=True))
            f2.append(int.from_bytes(d[8:], "little", signed=True))
            t = minwise(s)
            keys.append(t[ROOTS].astype("<u8").tobytes())
            sigs.append((t & np.uint64(0xFFFF)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "th", "n", "f1", "f2", "keys", "sig"])


ROOT = mix(np.array(ROOTS, np.uint64) + np.uint64(77))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, tree) for each selected token of a document, at the first level."""
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            node = mix(keys ^ ROOT[None, :]).astype(np.int64)
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            tree = np.tile(np.arange(keys.shape[1], dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel(), pa.int64()), pa.array(rep, pa.int64()), pa.array(tree, pa.int32())], names=["node", "rep", "tree"])


def _deeper(level: int):
    """(node, rep, tree) of the children of each (node, rep, tree, sig)."""

    def run(batches):
        at = np.array([deeper(t, level) for t in range(len(ROOTS))])
        salt = mix(at.astype(np.uint64) + np.uint64(1000 * level))
        for batch in batches:
            if batch.num_rows:
                node, rep, tree = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                shared = np.take_along_axis(sig, at[tree], axis=1).astype(np.uint64)
                child = mix(mix(shared ^ salt[tree]) ^ node.view(np.uint64)[:, None]).astype(np.int64)
                rep, tree = np.repeat(rep, FANOUT), np.repeat(tree, FANOUT)
                yield pa.RecordBatch.from_arrays([pa.array(child.ravel(), pa.int64()), pa.array(rep, pa.int64()), pa.array(tree, pa.int32())], names=["node", "rep", "tree"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each run of equal first columns, across batches."""
    held: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_pylist() for c in batch.columns]
        keys = cols[0]
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                part = [c[start:i] for c in cols]
                if held is not None and held[0][0] == part[0][0]:
                    held = [a + b for a, b in zip(held, part, strict=True)]
                else:
                    if held is not None:
                        yield held
                    held = part
                start = i
    if held is not None:
        yield held


def _agreeing(tree: int, labels: list[int], keys: list[bytes], masks: list[int], sigs: list[bytes]) -> np.ndarray:
    """Which pairs have different labels, agree in enough tokens, and share no tree before this one whose node was compared whole.

    masks: bit t tells that the member's node in tree t was; both members of a shared node have the same bit.
    """
    s, lab = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1), np.array(labels)
    k = np.frombuffer(b"".join(keys), "<u8").reshape(len(keys), -1)[:, :tree].copy()
    whole = (np.array(masks, np.int64)[:, None] >> np.arange(tree)[None, :]) & 1
    lone = np.arange(1, len(s) + 1, dtype=np.uint64)[:, None]
    k = np.where(whole == 1, k, lone)  # a node that branched does not count as shared
    out = np.zeros((len(s), len(s)), bool)
    for i in range(len(s)):
        near = np.flatnonzero(lab != lab[i])
        near = near[(s[near] == s[i]).sum(axis=1) >= AGREE]
        out[i, near[~(k[near] == k[i]).any(axis=1)]] = True
    return out


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, tree) of the members that are to be compared with some other member. Rows: node, rep, tree, label, keys, mask, sig by node."""
    out: list[list] = [[], [], []]
    for node, reps, trees, labels, keys, masks, sigs in _groups(batches):
        if len(reps) > 1:
            hit = np.flatnonzero(_agreeing(trees[0], labels, keys, masks, sigs).any(axis=1))
            out[0] += node[: len(hit)]
            out[1] += [reps[i] for i in hit]
            out[2] += trees[: len(hit)]
        if len(out[0]) > 5000:
            yield _members(out)
            out = [[], [], []]
    yield _members(out)


def _members(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["node", "rep", "tree"])


def _exhaust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links between groups of different labels, one for each two groups that they join. Rows as in _live, and words."""
    for _, reps, trees, labels, keys, masks, sigs, sets in _groups(batches):
        root = {x: x for x in labels}

        def find(x, root=root):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        full, a, b = [np.frombuffer(s, "<u8") for s in sets], [], []
        for i, j in np.argwhere(np.triu(_agreeing(trees[0], labels, keys, masks, sigs))):
            p, q = find(labels[i]), find(labels[j])
            if p != q and jaccard_linked(full[i], full[j]):
                root[max(p, q)] = min(p, q)
                a.append(reps[i])
                b.append(reps[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are similar enough. Rows: a, b, words of a, words of b."""
    for batch in batches:
        ok = [jaccard_linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _agree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("node").sortWithinPartitions("node")


def link(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component (the smallest id reachable over links), kept (whether it is that id).

    Texts are lower-cased (A-Z) and cut at ASCII white space; with fewer than five words the whole sequence is the one shingle,
    without words the set is empty and linked with nothing. Null texts have no words. A row without id is linked with nothing,
    its component is null and it is kept. Where an id stands on several texts, each row is linked by its own; repeated rows are all
    returned. set_group numbers the groups, th is xxhash64(text). Other columns are not read, an empty table gives no rows. Nothing is sampled or capped: nodes of any size are worked through.
    """
    prepare(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = scratch.keep(slim.withColumn("th", F.xxhash64("text")).mapInArrow(_sketch, "id long, th long, n long, f1 long, f2 long, keys binary, sig binary"))
    sets = rows.where("n > 0 AND id IS NOT NULL")
    reps = sets.groupBy("f1", "f2").agg(F.min("id").alias("low"), F.max("keys").alias("keys"), F.max("sig").alias("sig"))
    reps = scratch.keep(reps.withColumn("rep", F.monotonically_increasing_id()))  # fixed by the table
    nodes, tokens = _trees(scratch, reps)
    need = nodes.select("rep").distinct().join(reps.select("rep", "low", "f1"), "rep").select(F.col("low").alias("id"), "rep", "f1")
    full = scratch.keep(slim.join(need, "id").select("id", "text", "rep", "f1").mapInArrow(_words, "rep long, words binary"))
    edges = scratch.keep(_stars(_leaders(nodes), tokens, full))
    mixed = _mixed(scratch, nodes, components(spark, edges, scratch))
    groups = mixed.where(F.col("members") <= NODE).select("node", "rep", "tree", "label")
    big = mixed.where(F.col("members") > NODE)
    if not big.isEmpty():
        groups = groups.union(_blocks(scratch, big))
    both = scratch.keep(edges.union(_compare(scratch.keep(groups), tokens, full)))
    roots = components(spark, both, scratch)
    found = reps.select("f1", "f2", "rep", "low").join(roots, F.col("rep") == F.col("node"), "left").select("f1", "f2", "low", F.coalesce("root", "rep").alias("root"))
    found = scratch.keep(found)
    lows = found.groupBy("root").agg(F.min("low").alias("low"))
    found = scratch.keep(found.drop("low").join(lows, "root"))
    scratch.drop_all(but=(rows, found))
    own = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("low")), F.col("id")))
    named = rows.select("id", "n", "th", "f1", "f2").join(found, ["f1", "f2"], "left")
    return named.select("id", F.col("n").alias("n_shingles"), own.alias("component"), F.when(F.col("n") > 0, F.col("root")).alias("set_group"), "th").withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def _trees(scratch: Scratch, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes to compare, (node, rep, tree, members, pop), and the tokens of their members, (rep, keys, mask, sig).

    Nodes of up to NODE members are leaves, larger ones branch. Those that stay large, as they are dense or at DEPTH, come as they are;
    dense ones that share members as one node, since trees cut a large group of near copies in about the same way each. pop is the
    number of members of a document's root nodes: what most others resemble has most.
    """
    nodes = _crowded(scratch, reps.select("rep", "keys").mapInArrow(_roots, MEMBER))
    leaf = F.col("members") <= NODE
    info = nodes.groupBy("rep").agg(F.sum("members").alias("pop"), F.bit_or(F.when(leaf, F.call_function("shiftleft", F.lit(1), F.col("tree"))).otherwise(0)).alias("mask"))
    tokens = scratch.keep(reps.join(info, "rep").select("rep", "keys", "mask", "sig", "pop"))
    pop = tokens.select("rep", "pop")
    out, dense_members = nodes.where(leaf), None
    for level in range(1, DEPTH + 2):
        large = nodes.where(~leaf)
        if large.isEmpty():
            break
        large = scratch.keep(large)
        if level > DEPTH:
            out = out.union(large)
            break
        dense = _dense(scratch, large.join(pop, "rep"), tokens)
        thick = large.join(dense, "node").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
        dense_members = thick if dense_members is None else dense_members.union(thick)
        sparse = large.join(dense, "node", "left_anti").join(tokens.select("rep", "sig"), "rep")
        nodes = _crowded(scratch, sparse.select("node", "rep", "tree", "sig").mapInArrow(_deeper(level), MEMBER))
        out = out.union(nodes.where(leaf))
    if dense_members is not None:
        united = _clusters(components(scratch.spark, dense_members, scratch))
        out = out.union(united.join(united.groupBy("node").agg(F.count("*").alias("members")), "node").select(*out.columns))
    return scratch.keep(out.join(pop, "rep")), tokens.drop("pop")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, words) of the rows (id, text, rep, f1) whose set is the wanted one, as an id may stand on several texts; repeated rows count once."""
    sets, last, done = Sets(), None, set()
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            out: list[list] = [[], []]
            for i, text, rep, f1 in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True):
                if i != last:
                    last, done = i, set()
                if rep not in done:
                    words = sets(text).astype("<u8").tobytes()
                    if int.from_bytes(xxhash.xxh3_128_digest(words)[:8], "little", signed=True) == f1:
                        done.add(rep)
                        out[0].append(rep)
                        out[1].append(words)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["rep", "words"])


def _crowded(scratch: Scratch, members: DataFrame) -> DataFrame:
    """(node, rep, tree, members) of the nodes with several members."""
    members = scratch.keep(members)
    counts = members.groupBy("node").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("members")).where("first < last")
    return scratch.keep(members.join(counts.select("node", "members"), "node").select("node", "rep", "tree", "members"))


def _clusters(roots: DataFrame) -> DataFrame:
    """(node, rep, tree) with one node for all dense nodes that share members."""
    return roots.select(F.xxhash64(F.lit("cluster"), "root").alias("node"), F.col("node").alias("rep"), F.lit(0).cast("int").alias("tree"))


def _leaders(nodes: DataFrame) -> DataFrame:
    """(rep, lead): each member with the most popular one of its node, in a large node with LEADERS others too, drawn by a hash."""
    draw = F.when(F.col("members") > NODE, F.pmod(F.xxhash64("rep", "node"), F.lit(LEADERS))).otherwise(0)
    best = nodes.groupBy("node").agg(F.max(F.struct("pop", "rep")).alias("m")).select("node", F.col("m.rep").alias("lead"))
    more = nodes.where(F.col("members") > NODE).groupBy("node", draw.alias("g")).agg(F.min(F.struct(F.xxhash64("node", "rep").alias("h"), "rep")).alias("m")).select("node", F.col("m.rep").alias("lead"))
    return nodes.select("node", "rep").join(best.union(more).distinct(), "node").where("rep <> lead").select("rep", "lead")


def _dense(scratch: Scratch, large: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node, lead) of the large nodes that branching would not take apart: their members agree with the most popular one in DENSE of the tokens on average."""
    best = large.groupBy("node").agg(F.max(F.struct("pop", "rep")).alias("m")).select("node", F.col("m.rep").alias("lead"))
    best = best.join(tokens.select(F.col("rep").alias("lead"), F.col("sig").alias("y")), "lead")
    pairs = large.select("node", "rep").join(best, "node").join(tokens.select("rep", F.col("sig").alias("x")), "rep")
    agree = pairs.select("node", "lead", "x", "y").mapInArrow(_shares, "node long, lead long, share double")
    return scratch.keep(agree.groupBy("node", "lead").agg(F.avg("share").alias("share")).where(F.col("share") >= DENSE).select("node", "lead"))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], names=["node", "lead", "share"])


def _mixed(scratch: Scratch, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, rep, tree, label, members) of the nodes that still hold several groups; two lone members were compared by the star already."""
    named = nodes.where("members > 2").select("node", "rep", "tree").join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = scratch.keep(named.select("node", "rep", "tree", F.coalesce("root", "rep").alias("label")))
    counts = named.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members")).where("x < y").drop("x", "y")
    return scratch.keep(named.join(counts, "node"))


def _stars(leaders: DataFrame, tokens: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) of members with their leaders."""
    pairs = leaders.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    pairs = pairs.join(tokens.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b").join(tokens.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a")
    pairs = pairs.select("a", "b", "x", "y").mapInArrow(_agree_pairs, "a long, b long")
    pairs = pairs.join(full.select(F.col("rep").alias("b"), F.col("words").alias("y")), "b").join(full.select(F.col("rep").alias("a"), F.col("words").alias("x")), "a")
    return pairs.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")


def _compare(groups: DataFrame, tokens: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of each group of (node, rep, tree, label), all members compared. First by tokens, then in full."""
    named = groups.join(tokens, "rep").select("node", "rep", "tree", "label", "keys", "mask", "sig")
    live = _in_order(named).mapInArrow(_live, MEMBER).select("node", "rep")
    rest = groups.join(live, ["node", "rep"], "left_semi").join(tokens, "rep").join(full, "rep")
    return _in_order(rest.select("node", "rep", "tree", "label", "keys", "mask", "sig", "words")).mapInArrow(_exhaust, "a long, b long")


def _blocks(scratch: Scratch, big: DataFrame) -> DataFrame:
    """Groups of bounded size that together hold every pair of a large node's members but those within its largest label.

    The members outside that label are cut into blocks, and so are all members; each two blocks are a group.
    """
    sizes = big.groupBy("node", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("node").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select("node", F.col("m.label").alias("main"), F.ceil(F.col("all") / (BLOCK)).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("m.n")) / (BLOCK)).cast("int").alias("rest"))
    big = big.join(main, "node").select("node", "rep", "tree", "label", "main", "blocks", "rest")
    of = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    left = big.where("label <> main").withColumn("l", of(F.col("rest"))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = big.withColumn("r", of(F.col("blocks"))).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)))
    both = left.select("node", "rep", "tree", "label", "l", "r").union(right.select("node", "rep", "tree", "label", "l", "r"))
    return both.select(F.xxhash64("node", "l", "r").alias("node"), "rep", "tree", "label").distinct()


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group: the one with the smallest id. Rows without id stay.

    Where an id stands on several rows, those that repeat a set are one document of which one row stays, and rows of other sets are
    judged on their own, as the set decides and not the id alone.
    """
    linked = link(spark, docs, id_col, text_col)
    empty = F.when(F.col("set_group").isNull(), F.col("id"))  # without words each id is a group of its own
    wins = linked.where("kept AND id IS NOT NULL").groupBy("id", "set_group", empty).agg(F.min("th").alias("_nd_th"), F.count("*").alias("n"))
    wins = Scratch(spark).keep(wins.select(F.col("id").alias("_nd_id"), "_nd_th", "n"))
    keyed = docs.withColumn("_nd_th", F.xxhash64(text_col))
    stay = keyed.join(wins, (F.col(id_col).cast("long") == F.col("_nd_id")) & (keyed["_nd_th"] == wins["_nd_th"]), "left_semi")
    if not wins.where("n > 1").isEmpty():  # an id on several rows
        stay = stay.dropDuplicates([id_col, "_nd_th"])
    return stay.select(docs.columns).union(docs.where(F.col(id_col).cast("long").isNull()))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = link(spark, read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
