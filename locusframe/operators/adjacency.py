"""Adjacencies of placed blocks (V8, V9, A17, A18, J15, G17): what leaves show, parsimony, conflicts, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators import graph
from locusframe.operators.anchors import overlap_join
from locusframe.plans.runtime import cut
from locusframe.sources.newick import Tree

_PLACE = ["start0", "end0", "block_id", "projection_id"]


def duplicate_copies(projections: DataFrame) -> DataFrame:
    """(taxon, block_id, n) of blocks that are placed more than once in a taxon."""
    return projections.groupBy("taxon", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlapping(projections: DataFrame) -> DataFrame:
    """V9: (taxon, path, left_id, right_id) of projections of one path that share a place."""
    side = lambda n: projections.where("end0 > start0").select("taxon", "path", F.col("start0").alias(f"s{n}"), (F.col("end0") - 1).alias(f"e{n}"), F.col("projection_id").alias(f"p{n}"))
    hit = overlap_join(side(1), side(2), ["taxon", "path"], "s1", "e1", "s2", "e2").where(F.struct("s1", "p1") < F.struct("s2", "p2"))
    return hit.select("taxon", "path", F.col("p1").alias("left_id"), F.col("p2").alias("right_id"))


def usable(projections: DataFrame) -> DataFrame:
    """``projections`` with a column ``fit``: the only one of its block in its taxon, of known orientation, and overlapping no other."""
    twice = duplicate_copies(projections).select("taxon", "block_id", F.lit(True).alias("twice"))
    over = overlapping(projections)
    met = over.select(F.explode(F.array("left_id", "right_id")).alias("projection_id")).distinct().withColumn("met", F.lit(True))
    rows = projections.join(twice, ["taxon", "block_id"], "left").join(met, "projection_id", "left")
    return rows.withColumn("fit", F.col("twice").isNull() & F.col("met").isNull() & F.col("orientation").isin("+", "-")).drop("twice", "met")


def issues(projections: DataFrame) -> DataFrame:
    """(kind, taxon, path, blocks, projections), each once: what keeps projections from defining adjacencies."""
    p = projections
    of = lambda c: F.array_sort(F.collect_set(c))
    twice = p.join(duplicate_copies(p).drop("n"), ["taxon", "block_id"]).groupBy("taxon", "block_id").agg(of("projection_id").alias("ids"))
    name = lambda n: p.select(F.col("projection_id").alias(f"{n}_id"), F.col("block_id").alias(f"{n}_block"))
    over = overlapping(p).join(name("left"), "left_id").join(name("right"), "right_id")
    near = _neighbours(usable(p)).where("fit and n_fit and block_id = n_block_id")
    # The kinds of issues.
    rows = [
        twice.select(F.lit("DUPLICATE_BLOCK_COPY").alias("kind"), "taxon", F.lit("").alias("path"), F.array("block_id").alias("blocks"), F.col("ids").alias("projections")),
        p.where("orientation = '?'").select(F.lit("UNKNOWN_ORIENTATION"), "taxon", "path", F.array("block_id"), F.array("projection_id")),
        over.select(F.lit("OVERLAPPING_PROJECTIONS"), "taxon", "path", F.array("left_block", "right_block"), F.array("left_id", "right_id")),
        near.select(F.lit("SELF_ADJACENCY"), "taxon", "path", F.array("block_id"), F.array("projection_id", "n_projection_id")),
    ]
    return reduce(DataFrame.union, rows).distinct()


def _neighbours(projections: DataFrame) -> DataFrame:
    w = Window.partitionBy("taxon", "path").orderBy(*_PLACE)
    return projections.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("block_id", "projection_id", "orientation", "fit")]).where("n_block_id is not null")


def observed(projections: DataFrame) -> DataFrame:
    """V8: (taxon, block1, end1, block2, end2), ends in order: which ends of blocks face each other on a path. projections: with ``fit``.

    A block read forward has its tail (T) behind and its head (H) before it. Neighbours of which one is unfit face nobody.
    """
    near = _neighbours(projections).where("fit and n_fit and block_id <> n_block_id")
    a = F.struct(F.col("block_id").alias("b"), F.when(F.col("orientation") == "+", "T").otherwise("H").alias("e"))
    b = F.struct(F.col("n_block_id").alias("b"), F.when(F.col("n_orientation") == "+", "H").otherwise("T").alias("e"))
    both = near.select("taxon", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    return both.select("taxon", F.col("x.b").alias("block1"), F.col("x.e").alias("end1"), F.col("y.b").alias("block2"), F.col("y.e").alias("end2")).distinct()


_ENDS = ["block1", "end1", "block2", "end2"]


def adjacency_id(block1: Column, end1: Column, block2: Column, end2: Column) -> Column:
    return F.concat(block1, F.lit(":"), end1, F.lit("--"), block2, F.lit(":"), end2)


def leaf_states(projections: DataFrame, leaves: list[str]) -> DataFrame:
    """(block1, end1, block2, end2, taxon, state) for each adjacency seen anywhere and each leaf: PRESENT, ABSENT (both blocks fit in it, apart) or MISSING."""
    fit = cut(usable(projections), "projections")
    seen = cut(observed(fit), "adjacencies")
    every = seen.select(*_ENDS).distinct().withColumn("taxon", F.explode(F.array(*map(F.lit, leaves))))
    placed = fit.where("fit").select("taxon", "block_id").distinct()
    has = lambda k: placed.select("taxon", F.col("block_id").alias(f"block{k}"), F.lit(True).alias(f"has{k}"))
    rows = every.join(has(1), ["taxon", "block1"], "left").join(has(2), ["taxon", "block2"], "left").join(seen.withColumn("seen", F.lit(True)), ["taxon", *_ENDS], "left")
    state = F.when(F.col("has1").isNull() | F.col("has2").isNull(), "MISSING").when(F.col("seen"), "PRESENT").otherwise("ABSENT")
    return rows.select(*_ENDS, "taxon", state.alias("state"))


def infer(projections: DataFrame, tree: Tree, target: str, ambiguous_conflict: bool = True) -> DataFrame:
    """A call for each adjacency: (adjacency, block1, end1, block2, end2, presence, orientation_conflict, endpoint_conflict, decision).

    presence: PRESENT, ABSENT or AMBIGUOUS at ``target`` by parsimony of two states. A17: more than one call of a pair of blocks is an
    orientation conflict, more than one active call (present, or ambiguous if those may conflict) at an end an endpoint conflict.
    """
    leaves = sorted(tree.leaves)
    states = leaf_states(projections, leaves)
    mask = F.when(F.col("state") == "PRESENT", 2).when(F.col("state") == "ABSENT", 1)
    wide = states.groupBy(*_ENDS).agg(*[F.max(F.when(F.col("taxon") == leaf, mask)).alias(f"leaf{k}") for k, leaf in enumerate(leaves)])
    costs = graph.sankoff(tree, target, {leaf: F.col(f"leaf{k}") for k, leaf in enumerate(leaves)}, states=2)
    absent, present = F.get(costs, F.lit(0)), F.get(costs, F.lit(1))
    presence = F.when(F.abs(absent - present) <= 1e-9, "AMBIGUOUS").when(present < absent, "PRESENT").otherwise("ABSENT")
    calls = cut(wide.select(*_ENDS, presence.alias("presence")), "adjacency-calls")
    active = F.col("presence").isin("PRESENT", *(["AMBIGUOUS"] if ambiguous_conflict else []))
    pairs = calls.groupBy("block1", "block2").agg((F.count(F.lit(1)) > 1).alias("orientation_conflict"))
    ends = calls.where(active).select(F.explode(F.array(F.struct(F.col("block1").alias("b"), F.col("end1").alias("e")), F.struct(F.col("block2").alias("b"), F.col("end2").alias("e")))).alias("x")).groupBy("x.b", "x.e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = lambda k: ends.select(F.col("b").alias(f"block{k}"), F.col("e").alias(f"end{k}"), F.lit(True).alias(f"hot{k}"))
    rows = calls.join(pairs, ["block1", "block2"]).join(hot(1), ["block1", "end1"], "left").join(hot(2), ["block2", "end2"], "left")
    rows = rows.withColumn("endpoint_conflict", active & (F.coalesce("hot1", F.lit(False)) | F.coalesce("hot2", F.lit(False))))
    clash, turned = F.col("endpoint_conflict"), F.col("orientation_conflict")
    # The decisions.
    decision = (
        F.when((F.col("presence") == "AMBIGUOUS") & clash, "PRESENCE_AMBIGUOUS_ENDPOINT_CONFLICT").when(F.col("presence") == "AMBIGUOUS", "PRESENCE_AMBIGUOUS")
        .when(F.col("presence") == "ABSENT", "ANCESTRAL_ADJACENCY_ABSENT").when(clash, "SUPPORTED_ENDPOINT_CONFLICT").when(turned, "SUPPORTED_ORIENTATION_CONFLICT").otherwise("SUPPORTED_CANDIDATE_ADJACENCY")
    )
    return rows.select(adjacency_id(*map(F.col, _ENDS)).alias("adjacency"), *_ENDS, "presence", "orientation_conflict", "endpoint_conflict", decision.alias("decision"))
