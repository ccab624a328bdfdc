"""Profiles of sequences and pairs (A8-A11, J8, L15): entropy, tails, k-mer sketches, diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.exprs import mash_mismatch
from locusframe.operators.anchors import merged_length
from locusframe.operators.orders import ranked
from locusframe.plans.runtime import ship

#: Bases of an entropy block; a homopolymer's bases count from this one on; occurrences of a k-mer that a sketch keeps.
BLOCK, TAIL, MOST = 64, 4, 4
_CODE = np.full(256, 255, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _k


def base_profile(seqs: DataFrame) -> DataFrame:
    """(id, length, ambiguous_fraction, low_complexity_fraction, normalized_entropy) of sequences (id, seq); in expressions only.

    Entropy is that of each block of 64 bases, halved so that it is 1 at most, weighted by the bases that are not ambiguous.
    A run of four or more of one base counts from its fourth base on. An empty sequence has zeros.
    """
    s = seqs.select("id", F.upper(F.coalesce("seq", F.lit(""))).alias("s"))
    n = F.char_length("s").cast("long")
    # one character after another, so that a run is not cut by an ambiguous base being taken out
    tails = F.aggregate(F.regexp_extract_all("s", F.lit("A{4,}|C{4,}|G{4,}|T{4,}"), F.lit(0)), F.lit(0).cast("long"), lambda a, r: a + F.char_length(r) - (TAIL - 1))
    whole = s.select("id", n.alias("length"), (n - F.char_length(F.regexp_replace("s", "[^ACGT]", ""))).alias("ambiguous"), tails.alias("tails"))
    blocks = s.where("s <> ''").select("id", F.explode(F.regexp_extract_all("s", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("b"))
    counts = [F.char_length(F.regexp_replace("b", f"[^{c}]", "")).cast("double") for c in "ACGT"]
    known = counts[0] + counts[1] + counts[2] + counts[3]
    bits = sum((F.when(c > 0, -(c / known) * F.log2(c / known)).otherwise(0.0) for c in counts), F.lit(0.0))
    weighted = blocks.groupBy("id").agg(F.sum(bits / 2 * known).alias("w"))
    got = whole.join(weighted, "id", "left")
    part = lambda c: F.when(F.col("length") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("length")).otherwise(F.lit(0.0))
    return got.select("id", "length", part("ambiguous").alias("ambiguous_fraction"), part("tails").alias("low_complexity_fraction"), part("w").alias("normalized_entropy"))


def kmer_hashes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the k-mers without ambiguous bases: two bits a base, mixed by a bijection."""
    c = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(c) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(k):
        code = (code << np.uint64(2)) | (c[i : i + n] & 3).astype(np.uint64)
        bad |= c[i : i + n] > 3
    h = (code ^ (code >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    at = np.flatnonzero(~bad)
    return h[at], at


def sketch(seqs: DataFrame, k: int, modulo: int = 1, most: int = MOST) -> DataFrame:
    """(id, hash, pos) of the k-mers of each sequence (id, seq) whose hash is a multiple of ``modulo``, the first ``most`` of each."""
    ship(seqs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = kmer_hashes((s or "").encode("latin-1", "replace"), k)
                kept = h % np.uint64(modulo) == 0
                h, at = h[kept], at[kept]
                order = np.lexsort((at, h))
                h, at = h[order], at[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                nth = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
                h, at = h[nth < most], at[nth < most]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i), pa.int64()), pa.array(h.view(np.int64)), pa.array(at, pa.int64())], schema=schema)

    return seqs.select(F.col("id").cast("long"), "seq").where("id is not null").mapInArrow(run, "id long, hash long, pos long")


def sketch_similarity(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(id, shared, jaccard, mismatch) of two sketches of the same ids; distinct hashes count."""
    da, db = a.select("id", "hash").distinct(), b.select("id", "hash").distinct()
    size = lambda d, n: d.groupBy("id").agg(F.count(F.lit(1)).alias(n))
    both = size(da, "na").join(size(db, "nb"), "id", "full").join(size(da.join(db, ["id", "hash"]), "shared"), "id", "left").fillna(0, ["na", "nb", "shared"])
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.select("id", "shared", j.alias("jaccard"), mash_mismatch(j, k).alias("mismatch"))


def floor_quantiles(rows: DataFrame, keys: list[str], value: str, **which: float) -> DataFrame:
    """A10: per group, for each name the element floor(p (n - 1)) of the sorted values. Sorted in ranges, so no group is gathered; nulls are left out."""
    known = rows.select(*keys, value).where(F.col(value).isNotNull())
    place = ranked(known, [value], "_k", keys)
    size = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = place.join(size, keys)
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == F.floor(p * (F.col("_n") - 1)), F.col(value))).alias(name) for name, p in which.items()])


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A10: (keys, median): the middle value, or the mean of the two in the middle."""
    known = rows.select(*keys, value).where(F.col(value).isNotNull())
    place = ranked(known, [value], "_k", keys)
    size = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    middle = place.join(size, keys).where((F.col("_k") == F.floor(F.col("_n") / 2)) | ((F.col("_n") % 2 == 0) & (F.col("_k") == F.floor(F.col("_n") / 2) - 1)))
    return middle.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("median"))


def deviations(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A10: (keys, median, mad): the median, and the median distance from it."""
    mid = medians(rows, keys, value)
    away = rows.join(mid, keys).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    return mid.join(medians(away, keys, "_away").withColumnRenamed("median", "mad"), keys)


def pair_profile(pairs: DataFrame, k: int = 15, modulo: int = 1) -> DataFrame:
    """L15, in what A8 to A11 give: a row for each pair (id, a, b) with both sides' base profiles, their sketches' likeness, and of the k-mers
    that both have once the spread of their diagonals and how much of ``a`` they cover."""
    side = lambda c: pairs.select("id", F.col(c).alias("seq"))
    named = lambda c: base_profile(side(c)).select("id", *[F.col(x).alias(f"{c}_{x}") for x in ("length", "ambiguous_fraction", "low_complexity_fraction", "normalized_entropy")])
    sa, sb = sketch(side("a"), k, modulo), sketch(side("b"), k, modulo)
    once = lambda d, n: d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id", "hash"))).where("_n = 1").select("id", "hash", F.col("pos").alias(n))
    seeds = once(sa, "pa").join(once(sb, "pb"), ["id", "hash"]).select("id", "pa", "pb", (F.col("pb") - F.col("pa")).alias("diagonal"))
    covered = merged_length(seeds.select("id", F.col("pa").alias("s"), (F.col("pa") + k - 1).alias("e")), ["id"], "s", "e").select("id", "covered", F.col("n").alias("seeds"))
    spread = deviations(seeds, ["id"], "diagonal").select("id", F.col("median").alias("diagonal_median"), F.col("mad").alias("diagonal_mad"))
    out = named("a").join(named("b"), "id").join(sketch_similarity(sa, sb, k), "id", "left")
    return out.join(covered, "id", "left").join(spread, "id", "left").fillna(0, ["shared", "jaccard", "covered", "seeds", "diagonal_median", "diagonal_mad"]).fillna(1.0, ["mismatch"])
