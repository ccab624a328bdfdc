"""Total orders at any size (O1-O8, O11, V1): ranks from one range-partitioned sort, and tasks dealt by cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.plans.runtime import cut_shuffled as cut

#: Places where keys begin in ranges, at most, to be broadcast.
FEW = 20_000


def ranked(rows: DataFrame, order: list[str | Column], name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """``rows`` with their 0-based place in ``order``, which should be total; with ``within`` the place among rows of those keys.

    Rows are sorted in ranges, not per key, so no group meets in one task; each row is numbered in
    its range and the ranges' sizes, a number per task, are added up. The sorted rows are
    written once, so that every read sees the same numbers.
    """
    taken = {c.lower() for c in rows.columns}
    at = "_at"
    while at in taken:
        at += "_"
    keys = within or []
    sorted_ = cut(rows.orderBy(*keys, *order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per task
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = sorted_.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, (F.col("_start") + F.col(at) - F.shiftleft(F.col("_part"), 33)).cast("long")).drop("_part", "_start")
    if not keys:
        return place.drop(at)
    # a range has few keys or a key few ranges: with the range beside it, no key is one task's
    part = F.shiftright(at, 33)
    own = sorted_.groupBy(part.alias("_part"), *[F.col(k).alias(f"_{k}") for k in keys]).agg((F.min(at) - F.shiftleft(F.min(part), 33)).alias("_low"))
    own = own.join(F.broadcast(starts), "_part").withColumn("_low", F.col("_low") + F.col("_start")).drop("_start")
    first = F.min("_low").over(Window.partitionBy(*[f"_{k}" for k in keys]))
    own = cut(own.withColumn("_first", first).drop("_low"), "ranked-keys")
    own = F.broadcast(own) if own.limit(FEW + 1).count() <= FEW else own
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = place.join(own, [part == F.col("_part"), *same])
    return joined.withColumn(name, F.col(name) - F.col("_first")).drop("_part", "_first", at, *[f"_{k}" for k in keys])


def dense_ids(rows: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with 1-based ids: sides: id -> (key, start); of each key the starts, repeated ones once, are numbered in order."""
    for name, (key, start) in sides.items():
        ids = ranked(rows.select(F.col(key).alias("_key"), F.col(start).alias("_start1")).distinct(), ["_start1"], name, ["_key"])
        ids = ids.withColumn(name, (F.col(name) + 1).cast("int"))
        rows = rows.join(ids, [F.col(key).eqNullSafe(F.col("_key")), F.col(start).eqNullSafe(F.col("_start1"))]).drop("_key", "_start1")
    return rows


def dealt(rows: DataFrame, cost: str, parts: int | None = None) -> DataFrame:
    """Rows dealt to ``parts`` tasks in falling cost, there and back, each task's most costly first; so tasks end at about one time."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ranked(rows, [F.desc(cost), F.xxhash64(*[c for c in rows.columns if c != cost])], "_rank")
    turn = F.col("_rank") % (2 * parts)
    hand = F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn)
    return order.withColumn("_hand", hand).repartitionByRange(parts, "_hand").sortWithinPartitions("_hand", F.desc(cost)).drop("_rank", "_hand")
