"""Local mapping of gap sequences (J7, C11, S19): minimizers, joined on their hash, chained per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.plans.runtime import ship

_CODE = np.full(256, 4, np.uint64)
for _k, _c in enumerate(b"ACGT"):
    _CODE[_c] = _k


def minimizers(seq: str, k: int, w: int) -> list[tuple[int, int]]:
    """(hash, start) of the smallest k-mer of each window of ``w``; k-mers with another letter than ACGT have none."""
    c = _CODE[np.frombuffer(seq.encode("latin-1"), np.uint8)]
    n = len(c) - k + 1
    if n < 1:
        return []
    h, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(k):
        h = (h << np.uint64(2)) | (c[i : i + n] & np.uint64(3))
        bad |= c[i : i + n] > 3
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)  # a bijection, so that no two k-mers share a hash
    h ^= h >> np.uint64(31)
    h[bad] = np.iinfo(np.uint64).max
    view = np.lib.stride_tricks.sliding_window_view(h, min(w, n))
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return [(int(h[i].view(np.int64)), int(i)) for i in at if not bad[i]]


def sketch(seqs: DataFrame, k: int = 15, w: int = 9) -> DataFrame:
    """(id, hash, pos) of each sequence (id, seq)."""
    ship(seqs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, h, p) for i, s in zip(pdf.id, pdf.seq, strict=True) for h, p in minimizers(s or "", k, w)]
            yield pd.DataFrame(got, columns=["id", "hash", "pos"])

    return seqs.select("id", "seq").mapInPandas(run, "id long, hash long, pos long")


def chain_seeds(pairs: list[tuple[int, int]], k: int, band: int = 500, reach: int = 5000, look: int = 5000, misses: int = 25) -> tuple[float, list[tuple[int, int]]]:
    """C11: the best chain of forward seeds (ref, query): bases that match, less a cost of leaving the diagonal by ``off`` bases: a hundredth of
    ``k`` for each and half a bit for their logarithm.

    A seed looks back at ``look`` others at most and gives up after ``misses`` that already lead, through others, to one it has seen, so the
    work is linear in the seeds but for repeats.
    """
    pairs = sorted(pairs)
    f, prev, seen = [float(k)] * len(pairs), [-1] * len(pairs), [-1] * len(pairs)
    first = 0
    for i, (r, q) in enumerate(pairs):
        while pairs[first][0] < r - reach:
            first += 1
        missed = 0
        for j in range(i - 1, max(first, i - look) - 1, -1):
            dr, dq = r - pairs[j][0], q - pairs[j][1]
            off = abs(dr - dq)
            if dr <= 0 or dq <= 0 or dq > reach or off > band:
                continue
            cand = f[j] + min(dr, dq, k) - (0.01 * k * off + 0.5 * math.log2(off) if off else 0.0)
            if cand > f[i]:
                f[i], prev[i] = cand, j
                missed = max(missed - 1, 0)
            elif seen[j] == i:
                missed += 1
                if missed > misses:
                    break
            if prev[j] >= 0:
                seen[prev[j]] = i
    if not pairs:
        return 0.0, []
    at = int(np.argmax(f))
    best, out = f[at], []
    while at >= 0:
        out.append(pairs[at])
        at = prev[at]
    return best, out[::-1]


def local_map(gaps: DataFrame, k: int = 15, w: int = 9, max_occurrence: int = 2, least_seeds: int = 2) -> DataFrame:
    """(id, ref_start, ref_end, query_start, query_end, seeds, score) of the best forward region of each gap (id, ref, query).

    Minimizers that occur more often than ``max_occurrence`` in a side of a gap seed nothing (the mapper's rule for
    repeats), so a gap's join is bounded by its length.
    """
    r, q = sketch(gaps.select("id", F.col("ref").alias("seq")), k, w), sketch(gaps.select("id", F.col("query").alias("seq")), k, w)

    def rare(d: DataFrame, pos: str) -> DataFrame:
        g = d.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"), F.collect_list("pos").alias("ps")).where(F.col("n") <= max_occurrence)
        return g.select("id", "hash", F.explode("ps").alias(pos))

    seeds = rare(r, "r").join(rare(q, "q"), ["id", "hash"]).select("id", "r", "q")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score, chain = chain_seeds(list(zip(pdf.r.tolist(), pdf.q.tolist())), k)
        if len(chain) < least_seeds:
            return pd.DataFrame([], columns=["id", "ref_start", "ref_end", "query_start", "query_end", "seeds", "score"])
        return pd.DataFrame([(pdf.id.iloc[0], chain[0][0] + 1, chain[-1][0] + k, chain[0][1] + 1, chain[-1][1] + k, len(chain), score)], columns=["id", "ref_start", "ref_end", "query_start", "query_end", "seeds", "score"])

    return seeds.groupBy("id").applyInPandas(run, "id long, ref_start long, ref_end long, query_start long, query_end long, seeds long, score double")
