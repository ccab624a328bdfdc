"""Chains of matches along a chromosome (C1, C8, C10, O9); those with quotas are in :mod:`locusframe.operators.quota`.

Each group is a chromosome, whose matches are anchors of genes: thousands to a hundred
thousand rows, whatever the length of the sequences.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from locusframe.plans.runtime import ship

MATCH = "ref_chr string, query_chr string, ref_start long, ref_end long, query_start long, query_end long, strand string, score double, gene string, line_no long"
COLUMNS = [c.split()[0] for c in MATCH.split(", ")]


def reorder_inversions(rows: list[dict], least: float, penalty: float = 1.0) -> list[dict]:
    """Turn around each stretch that reads as an inversion: from a minus match on, minus matches in
    falling query order earn their score, all others cost ``penalty`` times theirs; the best prefix, if it earns more than ``least``."""
    out, i = list(rows), 0
    while i < len(out):
        if out[i]["strand"] != "-":
            i += 1
            continue
        total, best, end, last = 0.0, 0.0, i, None
        for j in range(i, len(out)):
            m = out[j]
            if m["strand"] == "-" and (last is None or m["query_end"] < last):
                total += m["score"]
                last = m["query_start"]
            else:
                total -= penalty * m["score"]
            if total <= 0:
                break
            if total > best:
                best, end = total, j
        if best > least:
            out[i : end + 1] = out[i : end + 1][::-1]
            i = end + 1
        else:
            i += 1
    return out


class _Tops:
    """Greatest (score, place) among the entries before a position, by a tree of prefixes."""

    def __init__(self, n: int):
        self.tree: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def add(self, k: int, entry: tuple[float, int]) -> None:
        tree, k = self.tree, k + 1
        while k < len(tree):
            if tree[k] < entry:
                tree[k] = entry
            k += k & -k

    def before(self, k: int) -> tuple[float, int]:
        tree, top = self.tree, (0.0, -1)
        while k > 0:
            if tree[k] > top:
                top = tree[k]
            k &= k - 1
        return top


def best_chain(rows: list[dict], least: float) -> list[dict]:
    """The collinear chain of greatest score, inversions of ``least`` or less taken out afterwards.

    What ends before all matches to come on the reference is found by its query end in a tree, by score and then
    nearness; only the others, those of an inversion or an overlap, are compared one by one.
    """
    n = len(rows)
    if not n:
        return []
    score, rs, re, qs, qe = ([float(m[c]) for m in rows] for c in ("score", "ref_start", "ref_end", "query_start", "query_end"))
    minus = [m["strand"] == "-" for m in rows]
    to_come = np.minimum.accumulate(np.array(rs)[::-1])[::-1].tolist()
    ends = np.sort(np.array(qe))
    under, own = np.searchsorted(ends, np.array(qs), side="left").tolist(), np.searchsorted(ends, np.array(qe), side="left").tolist()
    every, plus = _Tops(n), _Tops(n)
    f, prev = score.copy(), [-1] * n
    waiting: list[tuple[float, int]] = []  # by the reference's end: what some match to come doesn't lie behind
    for i in range(n):
        while waiting and waiting[0][0] < to_come[i]:
            j = heappop(waiting)[1]
            every.add(own[j], (f[j], j))
            if not minus[j]:
                plus.add(own[j], (f[j], j))
        top = every.before(under[i])
        if minus[i] and not top[0] > least:  # then minus matches before it don't count
            top = plus.before(under[i])
        for end, j in waiting:
            if qe[j] < qs[i] and (f[j], j) > top:
                ahead = end < rs[i]
                if (rs[j] > re[i] or ahead and f[j] > least) if minus[i] and minus[j] else ahead:
                    top = f[j], j
        if top[0] > 0:
            f[i], prev[i] = top[0] + score[i], top[1]
        heappush(waiting, (re[i], i))
    k, chain = int(np.argmax(f)), []
    while k >= 0:
        chain.append(rows[k])
        k = prev[k]
    chain.reverse()
    return [m for m, keep in zip(chain, _kept(chain, least)) if keep]


def _kept(chain: list[dict], least: float) -> list[bool]:
    """Runs of an inversion that earn ``least`` or less go. A minus match that doesn't go on with the one before it closes a run
    and belongs to none, so it stays; what follows it may begin a run by going on with it."""
    keep = [True] * len(chain)
    run: list[int] = []

    def close() -> None:
        if sum(chain[k]["score"] for k in run) <= least:
            for k in run:
                keep[k] = False
        run.clear()

    for k, m in enumerate(chain):
        before = chain[k - 1] if k else None
        begins = before is None or before["strand"] == "+"
        goes_on = not begins and before["ref_start"] > m["ref_end"] and before["query_end"] < m["query_start"]
        if m["strand"] == "-" and (begins or goes_on):
            run.append(k)
        else:
            close()
    close()
    return keep


def chain_global(match: DataFrame, least: float = 2.0, penalty: float = 1.0) -> DataFrame:
    """C1 with O9 before it, per reference chromosome: the kept matches with their place ``pos`` in the chain."""
    ship(match.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["ref_start", "ref_end", "query_start", "query_end", "line_no"]).to_dict("records")
        got = best_chain(reorder_inversions(rows, least, penalty), least)
        return pd.DataFrame(got, columns=COLUMNS).assign(pos=np.arange(len(got), dtype=np.int64))

    return match.select(*COLUMNS).groupBy("ref_chr").applyInPandas(run, MATCH + ", pos long")


def monotone(rows: list[dict]) -> list[dict]:
    """Keep a match only if it is strictly after the last kept one on both axes."""
    out: list[dict] = []
    for m in rows:
        if not out:
            out.append(m)
            continue
        last = out[-1]
        after = m["query_start"] > last["query_end"] if m["strand"] == "+" else m["query_end"] < last["query_start"]
        if m["ref_start"] > last["ref_end"] and after:
            out.append(m)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs that rises strictly on both axes."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0], -pairs[i][1]))
    for i in order:
        k = bisect_left(tails, pairs[i][1])
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [pairs[i][1]], [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def longest_increasing(pairs: DataFrame) -> DataFrame:
    """C10 for each id: (id, a, b, pos) of the longest chain of pairs (id, a, b) that rises strictly on both axes."""
    ship(pairs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = increasing(sorted(zip(pdf.a.tolist(), pdf.b.tolist())))
        return pd.DataFrame({"id": pdf.id.iloc[0], "a": [x for x, _ in got], "b": [y for _, y in got], "pos": range(len(got))})

    return pairs.select("id", "a", "b").groupBy("id").applyInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, a long, b long, pos long")
