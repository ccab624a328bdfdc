"""Sequences in chunks (T1, S3): a chromosome is many rows of bounded size, and an interval meets only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.exprs import normalise_bases, reverse_complement

#: Bases in a chunk; the last one of a sequence may have fewer.
CHUNK = 1 << 16


def chunked(sequence: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, chunk, bases) of whole sequences (name, seq)."""
    at = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("seq"), F.lit(1)) - 1) / size))
    return sequence.select("name", "seq", F.explode(at).alias("chunk")).select("name", F.col("chunk").cast("long").alias("chunk"), F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("bases"))


def lengths(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, length)"""
    return chunks.groupBy("name").agg(F.max(F.col("chunk") * size + F.char_length("bases")).cast("long").alias("length"))


def fetch(intervals: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, bases) of closed 1-based intervals (id, name, start1, end1): S3's rules, normalised.

    Reversed ends change places and both are held within the sequence; an interval before or behind it is its
    first or last base. Each interval goes to the chunks it touches, so what is joined and gathered is
    as long as the interval itself. Intervals of unknown names have no row. Ids must be unique.
    """
    known = intervals.join(lengths(chunks, size), "name").where("length > 0")
    within = lambda c: F.least(F.greatest(c, F.lit(1)), F.col("length"))
    known = known.select("id", "name", within(F.least("start1", "end1")).cast("long").alias("a"), within(F.greatest("start1", "end1")).cast("long").alias("b"))
    touched = known.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("a") - 1) / size), F.floor((F.col("b") - 1) / size))))
    first = F.col("chunk") * size
    lo, hi = F.greatest(F.col("a"), first + 1), F.least(F.col("b"), first + size)
    parts = touched.join(chunks, ["name", "chunk"]).select("id", "chunk", F.substring("bases", (lo - first).cast("int"), (hi - lo + 1).cast("int")).alias("part"))
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("ps"))
    return whole.select("id", normalise_bases(F.array_join(F.transform("ps", lambda p: p["part"]), "")).alias("bases"))


def base_at(positions: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``positions`` (name, pos0, ...) with a column ``there``: the base, null beyond the end; of unknown names none is kept."""
    near = positions.withColumn("chunk", F.floor(F.col("pos0") / size).cast("long"))
    return near.join(chunks, ["name", "chunk"], "left").withColumn("there", _base(size)).drop("chunk", "bases")


def _base(size: int) -> Column:
    found = F.substring("bases", (F.col("pos0") - F.col("chunk") * size + 1).cast("int"), F.lit(1))
    return F.when(found != "", found)


def oriented(bases: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(bases)).otherwise(bases)
