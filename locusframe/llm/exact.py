"""Exact dedup (operator 8): deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of code points. Distinct blocks are sorted
into integer names; adjacent names are then paired and the pairs named in the same way,
until one integer stands for each text. Two texts get the same (level, name) if and only
if they are identical: names come from comparing contents, a hash only deals them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import BLANKS, by_key, drop_rows, keyed, surplus
from locusframe.plans.runtime import cut

#: Code points in a block.
BLOCK = 4096
#: Names are made in this many sorted buckets, each within one task.
BUCKET_BITS = 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def blocks_of(text: Column, size: int) -> Column:
    """Linear in the text; an empty text is one empty block."""
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _named(distinct: DataFrame, deal: Column, order: list[str]) -> DataFrame:
    """``distinct`` with a column name: bucket number, then the rank in its sorted bucket."""
    bucket = F.shiftrightunsigned(deal, 64 - BUCKET_BITS)
    dealt = distinct.withColumn("bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return dealt.withColumn("name", F.shiftleft(F.col("bucket").cast("long"), 40) + rank).drop("bucket")


def identities(docs: DataFrame, block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """``(doc_id, sha, n_rows, level, name)``: one row per distinct (doc_id, normalised text).

    ``hashed`` deals blocks to tasks; blocks that share its value are told apart by
    their contents (tests pass a hash of few values).

    The text is shuffled once, after equal blocks were combined within each task; all
    that follows carries integers. A block that occurs in a third of all rows costs one
    row per task in the first shuffle, and its thin join is one that Spark can split.
    """
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    flat = norm.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.posexplode(blocks_of(F.col("norm"), block)).alias("pos", "block"))
    flat = flat.withColumn("h", hashed("block"))
    sets = flat.groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("bs"))
    kept_text = F.when(F.size("bs") > 1, F.col("block"))
    variants = cut(sets.select("h", "bs", F.posexplode("bs").alias("v", "block")).select("h", "v", F.size("bs").alias("nv"), kept_text.alias("same")), "blocks")
    names = _named(variants, F.xxhash64("h"), ["h", "v"])
    on = F.col("h") == F.col("nh")
    if variants.where("nv > 1").limit(1).count():
        on = on & (F.col("same").isNull() | (F.col("same") == F.col("block")))
    else:
        flat = flat.drop("block")
    at = flat.join(names.select(F.col("h").alias("nh"), "same", "name"), on)
    level0 = cut(at.groupBy("doc_id", "sha", "pos").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("n_rows")), "names0")

    now = level0
    done, level = [], 0
    while True:
        last = F.max("pos").over(Window.partitionBy("doc_id", "sha"))
        now = now.withColumn("last", last) if level == 0 else now
        if level == 0:
            now = cut(now, "names")
        done.append(now.where("last = 0").select("doc_id", "sha", "n_rows", F.lit(level).alias("level"), "name"))
        rest = now.where("last > 0")
        if not rest.limit(1).count():
            break
        even = F.col("pos") % 2 == 0
        pairs = rest.groupBy("doc_id", "sha", "n_rows", "last", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = cut(pairs, "pairs")
        heads = _named(pairs.select("a", "b").distinct(), F.xxhash64("a", "b"), ["a", "b"]).select(F.col("a").alias("na"), F.col("b").alias("nb"), "name")
        now = cut(
            pairs.join(heads, (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb"))).select(
                "doc_id", "sha", F.col("half").alias("pos"), "name", "n_rows", F.shiftright("last", 1).alias("last")
            ),
            "names",
        )
        level += 1
    all_done = done[0]
    for d in done[1:]:
        all_done = all_done.union(d)
    return all_done


def exact_classes(docs: DataFrame, block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, sha, n_rows, kept)`` per distinct (doc_id, text).

    Of equal texts the smallest doc_id stays; a null id only if the group has no other.
    Null text counts as empty. Rows that repeat id and text are one row here, n_rows
    tells how many; group_size counts them all, and just one of them stays.
    """
    ids = identities(docs, block, hashed)
    groups = ids.groupBy(F.col("level").alias("gl"), F.col("name").alias("gn")).agg(F.min("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    joined = ids.join(groups, (F.col("level") == F.col("gl")) & (F.col("name") == F.col("gn")))
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "sha", "n_rows", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one of smallest doc_id, null last, of equals the first.

    Every row is judged by its own text, whatever its id. All columns stay, and none of
    theirs is touched. An empty table gives an empty result.
    """
    rows, key = keyed(docs)
    classes = exact_classes(by_key(rows, key), block).select("doc_id", F.col("keep_id").alias("grp"))
    return drop_rows(rows, key, surplus(classes, rows, key), "dropped")
