"""From anchors to alignments (L17, L18): the fragments of blocks, aligned and put together.

A fragment is an anchor, what lies between two anchors that go on one strand, or what lies
between the ends of a chromosome and its first or last anchor. Every fragment is a row with
its own bases, so the work is dealt by area whatever block it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.exprs import gap_cost
from locusframe.operators import affine
from locusframe.operators.orders import dealt
from locusframe.operators.sequences import fetch, oriented
from locusframe.plans.runtime import cut

_ENDS = ["ref_start", "ref_end", "query_start", "query_end"]


def fragments(chain: DataFrame, ref_length: DataFrame | None = None, query_length: DataFrame | None = None) -> DataFrame:
    """(block, sub, ord, kind, ref_chr, query_chr, strand, ref_start, ref_end, query_start, query_end): closed, 1-based.

    chain: matches with ``block`` and ``pos``. Without lengths (L17) all matches of a block follow each other on one
    strand. With them (L18: name, length) a block is a chromosome: a new ``sub`` begins where the strand changes or a
    minus match doesn't go on with the one before; a plus match first has what lies before it; and if no
    match is minus, what lies behind the last one follows. Empty sides have an end before their start.
    """
    w = Window.partitionBy("block").orderBy("pos")
    rows = chain.select("block", "pos", "ref_chr", "query_chr", "strand", *_ENDS, *[F.lag(c).over(w).alias(f"p_{c}") for c in ("strand", *_ENDS)])
    plus, first = F.col("strand") == "+", F.col("p_strand").isNull()
    if ref_length is None:
        joined = ~first
        rows = rows.withColumn("new", F.lit(0))
    else:
        joined = (F.col("p_strand") == F.col("strand")) & (plus | ((F.col("p_ref_end") < F.col("ref_start")) & (F.col("p_query_start") > F.col("query_end"))))
        joined = F.coalesce(joined, plus)  # the first match of a chromosome: its head belongs to it
        rows = rows.withColumn("new", (~joined).cast("int"))
    rows = rows.withColumn("joined", joined).withColumn("sub", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    anchors = rows.select("block", "sub", (F.col("pos") * 2 + 1).alias("ord"), F.lit("ANCHOR").alias("kind"), "ref_chr", "query_chr", "strand", *_ENDS)
    before = {
        "ref_start": F.coalesce(F.col("p_ref_end"), F.lit(0)) + 1,
        "ref_end": F.col("ref_start") - 1,
        "query_start": F.when(plus, F.coalesce(F.col("p_query_end"), F.lit(0)) + 1).otherwise(F.col("query_end") + 1),
        "query_end": F.when(plus, F.col("query_start") - 1).otherwise(F.col("p_query_start") - 1),
    }
    gaps = rows.where("joined").select("block", "sub", (F.col("pos") * 2).alias("ord"), F.lit("GAP").alias("kind"), "ref_chr", "query_chr", "strand", *[c.alias(n) for n, c in before.items()])
    out = anchors.unionByName(gaps)
    if ref_length is not None:
        last = rows.groupBy("block").agg(F.max_by(F.struct("pos", "sub", "ref_chr", "query_chr", "ref_end", "query_end"), "pos").alias("l"), F.max((F.col("strand") == "-").cast("int")).alias("minus")).where("minus = 0").select("block", "l.*")
        tails = last.join(ref_length.select(F.col("name").alias("ref_chr"), F.col("length").alias("rl")), "ref_chr").join(query_length.select(F.col("name").alias("query_chr"), F.col("length").alias("ql")), "query_chr")
        out = out.unionByName(tails.select("block", "sub", (F.col("pos") * 2 + 2).alias("ord"), F.lit("TAIL").alias("kind"), "ref_chr", "query_chr", F.lit("+").alias("strand"), (F.col("ref_end") + 1).alias("ref_start"), F.col("rl").alias("ref_end"), (F.col("query_end") + 1).alias("query_start"), F.col("ql").alias("query_end")))
    return out.where("ref_end >= ref_start or query_end >= query_start")


def aligned(frags: DataFrame, ref: DataFrame, query: DataFrame, scores: affine.Scores = affine.Scores(), cells: int = 4_000_000) -> DataFrame:
    """``frags`` with ref_row, query_row, score and method. ref, query: chunks (name, chunk, bases).

    A side without bases is filled with gaps at the cost of one gap. The rest is dealt by area, the largest first.
    """
    numbered = cut(frags.withColumn("id", F.xxhash64("block", "sub", "ord")), "fragments")
    side = lambda s: numbered.where(f"{s}_end >= {s}_start").select("id", F.col(f"{s}_chr").alias("name"), F.col(f"{s}_start").alias("start1"), F.col(f"{s}_end").alias("end1"))
    a, b = fetch(side("ref"), ref).withColumnRenamed("bases", "a"), fetch(side("query"), query).withColumnRenamed("bases", "b")
    rows = numbered.select("id", "strand").join(a, "id", "left").join(b, "id", "left")
    rows = cut(rows.select("id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce(oriented(F.col("b"), F.col("strand")), F.lit("")).alias("b")), "fragment-bases")
    n = F.char_length(F.concat("a", "b"))
    filled = rows.where("a = '' or b = ''").select(
        "id", F.rpad("a", n, F.lit("-")).alias("row_a"), F.rpad("b", n, F.lit("-")).alias("row_b"), gap_cost(n, scores.open1, scores.extend1, scores.open2, scores.extend2).cast("double").alias("score"), F.lit("FILLING").alias("method")
    )
    both = rows.where("a <> '' and b <> ''").withColumn("area", F.char_length("a").cast("long") * F.char_length("b"))
    got = affine.align_pairs(dealt(both, "area"), scores, cells).union(filled)
    return numbered.join(got, "id").drop("id").withColumnsRenamed({"row_a": "ref_row", "row_b": "query_row"})


def blocks(frags: DataFrame) -> DataFrame:
    """(block, sub, ref_chr, query_chr, strand, ends, ref_row, query_row, score): aligned fragments strung together in order.

    A whole-block record is one line, so its rows meet by definition; fragments are the form for sequences of any length.
    """
    parts = F.array_sort(F.collect_list(F.struct("ord", "ref_row", "query_row")))
    got = frags.groupBy("block", "sub").agg(
        F.first("ref_chr").alias("ref_chr"), F.first("query_chr").alias("query_chr"), F.first("strand").alias("strand"), *[(F.min if c.endswith("start") else F.max)(c).alias(c) for c in _ENDS],
        parts.alias("ps"), F.sum("score").alias("score"),
    )
    row = lambda c: F.array_join(F.transform("ps", lambda p: p[c]), "").alias(c)
    return got.select("block", "sub", "ref_chr", "query_chr", "strand", *_ENDS, row("ref_row"), row("query_row"), "score")


def check_rows(frags: DataFrame, ref: DataFrame, query: DataFrame) -> DataFrame:
    """The fragments whose rows without gaps are not their sources; none, if all is well."""
    numbered = frags.withColumn("id", F.xxhash64("block", "sub", "ord"))
    side = lambda s: numbered.where(f"{s}_end >= {s}_start").select("id", F.col(f"{s}_chr").alias("name"), F.col(f"{s}_start").alias("start1"), F.col(f"{s}_end").alias("end1"))
    a, b = fetch(side("ref"), ref).withColumnRenamed("bases", "a"), fetch(side("query"), query).withColumnRenamed("bases", "b")
    rows = numbered.join(a, "id", "left").join(b, "id", "left")
    fine = affine.intact(F.col("ref_row"), F.coalesce("a", F.lit(""))) & affine.intact(F.col("query_row"), F.coalesce(oriented(F.col("b"), F.col("strand")), F.lit("")))
    return rows.where(~fine).drop("id", "a", "b")
