"""Balances settled by the fewest transfers, and requirements clustered in order of appearance."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parties with a balance up to which a group is settled by the fewest transfers; beyond, the largest debt meets the largest claim.
EXACT = 16


def zero_groups(net: list[int]) -> list[list[int]]:
    """The parties parted into as many groups as possible that each add up to zero; net adds up to zero.

    best[mask] is the largest number of prefixes that add up to zero over all orders of the mask's parties, found from the masks with one
    party less: 2^n steps of n.
    """
    n = len(net)
    total, best = [0] * (1 << n), [0] * (1 << n)
    for mask in range(1, 1 << n):
        low = mask & -mask
        total[mask] = total[mask ^ low] + net[low.bit_length() - 1]
        most, rest = 0, mask
        while rest:
            bit = rest & -rest
            most, rest = max(most, best[mask ^ bit]), rest ^ bit
        best[mask] = most + (total[mask] == 0)
    groups, current, mask = [], [], (1 << n) - 1
    while mask:
        if total[mask] == 0 and current:
            groups.append(sorted(current))
            current = []
        want = best[mask] - (total[mask] == 0)
        party = next(i for i in range(n) if mask >> i & 1 and best[mask ^ (1 << i)] == want)
        current.append(party)
        mask ^= 1 << party
    return [*groups, sorted(current)] if current else groups


def transfers(parties: list[str], net: list[int]) -> Iterator[tuple[str, str, int]]:
    """(from, to, amount): in each group the largest debt meets the largest claim, ties by name, until all are even."""
    some = sorted((p, v) for p, v in zip(parties, net, strict=True) if v)
    groups = zero_groups([v for _, v in some]) if len(some) <= EXACT else [list(range(len(some)))]
    for g in groups:
        owe = [(some[i][1], some[i][0]) for i in g if some[i][1] < 0]
        due = [(-some[i][1], some[i][0]) for i in g if some[i][1] > 0]
        heapq.heapify(owe)
        heapq.heapify(due)
        while owe and due:
            (a, x), (b, y) = heapq.heappop(owe), heapq.heappop(due)
            paid = min(-a, -b)
            yield x, y, paid
            if a + paid:
                heapq.heappush(owe, (a + paid, x))
            if b + paid:
                heapq.heappush(due, (b + paid, y))


def settle(balances: DataFrame, group: str, party: str, cents: str) -> DataFrame:
    """(group, payer, payee, cents): the fewest transfers that bring each group's balances to zero; positive balances are owed to the party.

    Several rows of a party add up; null balances are 0. A group whose balances don't add up to zero leaves the rest with its smallest claims
    or debts. A group is one task's work: its parties are summed before they meet.
    """
    b = balances.groupBy(group, party).agg(F.sum(F.coalesce(cents, F.lit(0))).cast("long").alias("_v")).where("_v <> 0")
    per = b.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(party).cast("string").alias("p"), "_v"))).alias("all"))
    kind = balances.schema[group].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(g, *t) for g, every in zip(pdf[group], pdf["all"], strict=True) for t in transfers([e["p"] for e in every], [int(e["_v"]) for e in every])]
            yield pd.DataFrame(rows, columns=[group, "payer", "payee", "cents"])

    return per.mapInPandas(run, f"`{group}` {kind}, payer string, payee string, cents long")


def clusters(units: list[set[str]], least: float = 0.5) -> list[int]:
    """For each unit in order the number of its cluster: the first whose words, those of all its members so far, it shares `least` of by Jaccard, and two of them (or all, where a side has fewer).

    Clusters are looked up by word, so only those that share one are compared, in the order in which they began.
    """
    held: list[set[str]] = []
    by_word: dict[str, set[int]] = {}
    out = []
    for words in units:
        near = sorted(set().union(*(by_word.get(w, ()) for w in words))) if words else []
        for c in near:
            both = len(words & held[c])
            if both >= min(2, len(words), len(held[c])) and both >= least * len(words | held[c]):
                break
        else:
            c = len(held)
            held.append(set())
        for w in words - held[c]:
            by_word.setdefault(w, set()).add(c)
        held[c] |= words
        out.append(c)
    return out


def cluster_requirements(texts: DataFrame, key: str, units: str, least: float = 0.5) -> DataFrame:
    """(key, at, cluster): the lines or claims of each text, given as an array of word arrays in order, clustered within the text; both count from 0.

    A unit without words is a cluster of its own. Null and empty arrays give no rows. A text's units are one row, so no group is ever gathered.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, every in zip(pdf[key], pdf[units], strict=True):
                every = [] if every is None else every
                rows += [(k, i, c) for i, c in enumerate(clusters([set(w for w in (u if u is not None else ()) if w is not None) for u in every], least))]
            yield pd.DataFrame(rows, columns=[key, "at", "cluster"])

    return texts.select(key, units).mapInPandas(run, f"`{key}` {kind}, at int, cluster int")
