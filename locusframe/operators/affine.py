"""Base-level alignment (L1-L3, L10-L12, L16): two-piece affine gaps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.plans.runtime import ship


@dataclass(frozen=True)
class Scores:
    match: float = 0
    mismatch: float = -6
    open1: float = -8
    extend1: float = -2
    open2: float = -75
    extend2: float = -1

    def gap(self, n: int) -> float:
        return max(self.open1 + self.extend1 * n, self.open2 + self.extend2 * n) if n else 0.0


def align(a: str, b: str, s: Scores = Scores(), free_end: bool = False) -> tuple[str, str, float]:
    """L1: a best global alignment, row by row; the gaps along a row come from a running maximum.

    Of equal ways the traceback takes a pair first, then a gap in ``b``, then one in ``a``. Memory is a
    few tables of len(a) x len(b); callers bound the product (see :func:`align_pairs`). ``free_end``: the
    alignment ends where one of the two is used up, at the best such place (of equal ones the farthest).
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    j = np.arange(m + 1, dtype=float)
    low = -1e18
    h = np.full((n + 1, m + 1), low)
    f = [np.full((n + 1, m + 1), low) for _ in range(2)]
    e = [np.full((n + 1, m + 1), low) for _ in range(2)]
    pieces = ((s.open1, s.extend1), (s.open2, s.extend2))
    for i in range(n + 1):
        if i == 0:
            base = np.full(m + 1, low)
            base[0] = 0
        else:
            base = np.full(m + 1, low)
            base[1:] = h[i - 1, :-1] + np.where(y == x[i - 1], s.match, s.mismatch)
            for k, (o, ext) in enumerate(pieces):
                f[k][i] = np.maximum(h[i - 1] + o + ext, f[k][i - 1] + ext)
                base = np.maximum(base, f[k][i])
        row = base
        for k, (o, ext) in enumerate(pieces):
            reach = np.maximum.accumulate(base - ext * j)
            e[k][i, 1:] = reach[:-1] + o + ext * j[1:]
            row = np.maximum(row, e[k][i])
        h[i] = row
    ends = [(n, k) for k in range(m + 1)] + [(k, m) for k in range(n)] if free_end else [(n, m)]
    end = max(ends, key=lambda p: (h[p], p[0] + p[1]))
    (i, k2), out_a, out_b = end, [], []
    near = lambda p, q: abs(p - q) <= 1e-9 * max(1, abs(p))
    while i or k2:
        if i and k2 and near(h[i, k2], h[i - 1, k2 - 1] + (s.match if a[i - 1] == b[k2 - 1] else s.mismatch)):
            i, k2 = i - 1, k2 - 1
            out_a.append(a[i])
            out_b.append(b[k2])
            continue
        for k, (o, ext) in enumerate(pieces):
            if i and near(h[i, k2], f[k][i, k2]):
                while True:
                    opened = near(f[k][i, k2], h[i - 1, k2] + o + ext)
                    i -= 1
                    out_a.append(a[i])
                    out_b.append("-")
                    if opened:
                        break
                break
            if k2 and near(h[i, k2], e[k][i, k2]):
                want = h[i, k2]
                length = next(t for t in range(1, k2 + 1) if near(want, h[i, k2 - t] + o + ext * t))
                for _ in range(length):
                    k2 -= 1
                    out_a.append("-")
                    out_b.append(b[k2])
                break
    return "".join(reversed(out_a)), "".join(reversed(out_b)), float(h[end])


def banded(a: str, b: str, band: int, s: Scores = Scores()) -> tuple[str, str, float] | None:
    """The best global alignment that keeps within ``band`` columns of the straight line between the corners; None if no way does.

    Memory is len(a) x (2 band + 1). Rows without gaps are their sources by construction of the way back.
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    centre = np.rint(np.arange(n + 1) * (m / n if n else 0)).astype(int)
    lo, hi = np.maximum(centre - band, 0), np.minimum(centre + band, m)
    if n == 0 or hi[0] < 0 or (lo[1:] > hi[:-1] + 1).any() or hi[-1] < m:
        return None
    low, pieces = -1e18, ((s.open1, s.extend1), (s.open2, s.extend2))
    h: list[np.ndarray] = []
    f: list[list[np.ndarray]] = [[], []]

    def above(row: np.ndarray, i: int, shift: int) -> np.ndarray:
        """``row``, of i - 1, at the columns of i moved by ``shift``."""
        out = np.full(hi[i] - lo[i] + 1, low)
        p, q = max(lo[i] - shift, lo[i - 1]), min(hi[i] - shift, hi[i - 1])
        if p <= q:
            out[p + shift - lo[i] : q + shift - lo[i] + 1] = row[p - lo[i - 1] : q - lo[i - 1] + 1]
        return out

    for i in range(n + 1):
        j = np.arange(lo[i], hi[i] + 1)
        if i == 0:
            base = np.where(j == 0, 0.0, low)
            for k in (0, 1):
                f[k].append(np.full(len(j), low))
        else:
            pair = np.where(y[np.maximum(j - 1, 0)] == x[i - 1], s.match, s.mismatch) if m else np.full(len(j), low)
            base = np.where(j > 0, above(h[-1], i, 1) + pair, low)
            for k, (o, ext) in enumerate(pieces):
                f[k].append(np.maximum(above(h[-1], i, 0) + o + ext, above(f[k][-1], i, 0) + ext))
                base = np.maximum(base, f[k][-1])
        row = base
        for o, ext in pieces:
            reach = np.maximum.accumulate(base - ext * j)
            gap = np.full(len(j), low)
            gap[1:] = reach[:-1] + o + ext * j[1:]
            row = np.maximum(row, gap)
        h.append(row)
    if h[n][m - lo[n]] < low / 2:
        return None
    get = lambda t, i, j: t[i][j - lo[i]] if lo[i] <= j <= hi[i] else low
    near = lambda p, q: q > low / 2 and abs(p - q) <= 1e-9 * max(1, abs(p))
    i, j, out_a, out_b = n, m, [], []
    while i or j:
        now = get(h, i, j)
        if i and j and near(now, get(h, i - 1, j - 1) + (s.match if a[i - 1] == b[j - 1] else s.mismatch)):
            i, j = i - 1, j - 1
            out_a.append(a[i])
            out_b.append(b[j])
            continue
        for k, (o, ext) in enumerate(pieces):
            if i and near(now, get(f[k], i, j)):
                opened = False
                while not opened:
                    opened = near(get(f[k], i, j), get(h, i - 1, j) + o + ext)
                    i -= 1
                    out_a.append(a[i])
                    out_b.append("-")
                break
            t = next((t for t in range(1, j - lo[i] + 1) if near(now, get(h, i, j - t) + o + ext * t)), 0)
            if t:
                for _ in range(t):
                    j -= 1
                    out_a.append("-")
                    out_b.append(b[j])
                break
    return "".join(reversed(out_a)), "".join(reversed(out_b)), float(h[n][m - lo[n]])


def chunked(a: str, b: str, s: Scores, cells: int) -> tuple[str, str, float]:
    """Beyond ``cells``, windows of equal size are aligned with a free end, each from where the last one ended; what fits is aligned to the end."""
    w = max(1, int(cells**0.5) - 1)
    i, j, x, y = 0, 0, [], []
    while i < len(a) and j < len(b) and (len(a) - i + 1) * (len(b) - j + 1) > cells:
        p, q, _ = align(a[i : i + w], b[j : j + w], s, free_end=True)
        i, j = i + len(p) - p.count("-"), j + len(q) - q.count("-")
        x.append(p)
        y.append(q)
    if not x:
        return align(a, b, s)
    if i < len(a) and j < len(b):
        p, q, _ = align(a[i:], b[j:], s)
    else:
        p, q = a[i:] + "-" * (len(b) - j), "-" * (len(a) - i) + b[j:]
    rows = "".join([*x, p]), "".join([*y, q])
    return *rows, score_rows(*rows, s)


def score_rows(a: str, b: str, s: Scores = Scores(), strict: bool = False) -> float:
    """L2: the score of two rows; columns of two gaps are passed over, or with ``strict`` (L3) an error."""
    if len(a) != len(b):
        raise ValueError("rows of unequal length")
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    side = np.where(x == 45, 1, np.where(y == 45, 2, 0))
    both = (x == 45) & (y == 45)
    if both.any():
        if strict:
            raise ValueError("a column of two gaps")
        x, y, side = x[~both], y[~both], side[~both]
    pairs = side == 0
    total = s.match * int((pairs & (x == y)).sum()) + s.mismatch * int((pairs & (x != y)).sum())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], side, [0]])))
    return float(total + sum(s.gap(int(n)) for at, n in zip(edges, np.diff(edges)) if side[at]))


def score_pairs(pairs: DataFrame, scores: Scores = Scores(), strict: bool = False) -> DataFrame:
    """L2/L3 over rows (id, a, b) of alignments: (id, score)."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "score": [score_rows(a, b, scores, strict) for a, b in zip(pdf.a, pdf.b, strict=True)]})

    return pairs.select("id", "a", "b").mapInPandas(run, "id long, score double")


def align_pairs(pairs: DataFrame, scores: Scores = Scores(), cells: int = 4_000_000) -> DataFrame:
    """L11-L13 over rows (id, a, b): ``(id, row_a, row_b, score, method)``.

    All N or empty: filled with gaps, no alignment; at most ``cells`` cells: exact. Beyond that the widest band of so many
    cells and sliding windows are both tried and the better is taken, of equals the band.
    """
    ship(pairs.sparkSession)

    def one(a: str, b: str) -> tuple[str, str, float, str]:
        if not a.strip("N") or not b.strip("N"):
            n = max(len(a), len(b))
            score = 0.0 if a and b else scores.gap(n)
            return a.ljust(n, "-"), b.ljust(n, "-"), score, "FILLING"
        if (len(a) + 1) * (len(b) + 1) <= cells:
            return *align(a, b, scores), "EXACT"
        slid = chunked(a, b, scores, cells)
        near = banded(a, b, max(1, (cells // (len(a) + 1) - 1) // 2), scores)
        return (*near, "BANDED_MINIMAP2") if near and near[2] >= slid[2] else (*slid, "SLIDING_WINDOW")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(a, b) for a, b in zip(pdf.a.fillna(""), pdf.b.fillna(""), strict=True)]
            yield pd.DataFrame({"id": pdf.id, **{c: [g[k] for g in got] for k, c in enumerate(("row_a", "row_b", "score", "method"))}})

    return pairs.select("id", "a", "b").mapInPandas(run, "id long, row_a string, row_b string, score double, method string")


def intact(row: Column, source: Column) -> Column:
    """Without its gaps the row is its source."""
    return F.replace(row, F.lit("-"), F.lit("")) == source
