"""Ancestral sequences along a site graph.

residues: site_id, taxon, path, sequence, pos0, source_size, base. absent: site_id, path, taxon (aligned absences).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.exprs import letter_of, pair_id
from locusframe.operators import graph
from locusframe.operators.anchors import next_on_path
from locusframe.operators.components import components
from locusframe.operators.orders import ranked
from locusframe.plans.runtime import cut_shuffled as cut, ship
from locusframe.sources.newick import Tree


def check_tree(tree: Tree, taxa: list[str], target: str) -> None:
    """The tree's leaves are the taxa, and the target is one of its inner nodes."""
    if sorted(tree.leaves) != sorted(taxa):
        raise ValueError(f"the tree has {sorted(tree.leaves)}, the taxa are {sorted(taxa)}")
    if target in tree.leaves or target not in tree.parent:
        raise ValueError(f"{target} is no inner node of the tree")


def path_segments(residues: DataFrame) -> DataFrame:
    """(path, first, last, n): maximal runs of consecutive positions; ranked in ranges, so no path is one task's."""
    at = ranked(residues.select("path", "pos0").distinct(), ["pos0"], "_k", ["path"])
    return at.groupBy("path", (F.col("pos0") - F.col("_k")).alias("run")).agg(F.min("pos0").alias("first"), F.max("pos0").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def violations(residues: DataFrame) -> DataFrame:
    """(what, id, n) of broken invariants; none in a sound graph."""
    key = F.concat_ws(":", "path", F.col("pos0").cast("string"))
    shared = residues.groupBy(key.alias("id")).agg(F.countDistinct("site_id").alias("n")).where("n > 1").select(F.lit("residue in several sites").alias("what"), "id", "n")
    twice = residues.groupBy(F.concat_ws(":", F.col("site_id").cast("string"), "path").alias("id")).agg(F.countDistinct("pos0").alias("n")).where("n > 1").select(F.lit("two residues of a path in a site"), "id", "n")
    outside = residues.where("pos0 < 0 or pos0 >= source_size").select(F.lit("residue outside its source"), key.alias("id"), F.lit(1).cast("long").alias("n"))
    return shared.union(twice).union(outside)


def core_hash(residues: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row (core_hash, residues): a hash of all residues with their sites and copy groups that does not depend on their order.

    Rows are hashed twice and combined by exclusive or and sum, so no list of them is ever made.
    """
    rows = residues.select("site_id", "taxon", "path", "sequence", "pos0", "source_size", "base")
    rows = rows.join(groups.select("site_id", "copy_group"), "site_id", "left") if groups is not None else rows.withColumn("copy_group", F.lit(None).cast("string"))
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns])
    one, two = F.xxhash64(text, F.lit(1)), F.xxhash64(text, F.lit(2))
    both = F.concat_ws("_", F.lit("core"), F.lower(F.lpad(F.hex(F.coalesce(F.bit_xor(one), F.lit(0))), 16, "0")), F.lower(F.lpad(F.hex(F.coalesce(F.bit_xor(two), F.lit(0))), 16, "0")))
    return rows.agg(both.alias("core_hash"), F.count(F.lit(1)).alias("residues"))


def consistency(sites: DataFrame, support: DataFrame, ingroup1: str, ingroup2: str, outgroup: str) -> DataFrame:
    """(site_id, consistency): all three taxa there, and how many of their pairs have direct evidence. sites: site_id, taxon; support: site_id, a, b (taxa)."""
    three = [ingroup1, ingroup2, outgroup]
    taxa = sites.where(F.col("taxon").isin(*three)).groupBy("site_id").agg(F.countDistinct("taxon").alias("taxa"))
    needed = sorted("--".join(sorted((a, b))) for k, a in enumerate(three) for b in three[k + 1 :])
    pairs = support.select("site_id", pair_id(F.col("a"), F.col("b")).alias("pair")).where(F.col("pair").isin(*needed)).groupBy("site_id").agg(F.countDistinct("pair").alias("pairs"))
    every = sites.select("site_id").distinct().join(taxa, "site_id", "left").join(pairs, "site_id", "left")
    # The classes.
    cls = F.when(F.coalesce("taxa", F.lit(0)) < 3, "MISSING_EVIDENCE").when(F.col("pairs") == 3, "CONSISTENT").when(F.col("pairs") == 2, "SUPPORTED_BY_TWO_EDGES").otherwise("MISSING_EVIDENCE")
    return every.select("site_id", cls.alias("consistency"))


def boundary(sites: DataFrame) -> Column:
    """A site between which repairs may happen: consistent, and its copies are resolved."""
    return (sites["consistency"] == "CONSISTENT") & sites["copy_resolved"]


def qc(residues: DataFrame, absent: DataFrame, sites: DataFrame) -> DataFrame:
    """(metric, value): counters of a graph. sites: site_id, consistency, copy_resolved."""
    a = residues.agg(F.count(F.lit(1)).alias("residues"), F.countDistinct("site_id").alias("sites"), F.countDistinct("path").alias("paths"), F.countDistinct("taxon").alias("taxa"))
    b = absent.agg(F.count(F.lit(1)).alias("aligned_absences"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    c = sites.agg(*[F.coalesce(count(F.col("consistency") == k), F.lit(0)).alias(k.lower()) for k in ("CONSISTENT", "SUPPORTED_BY_TWO_EDGES", "MISSING_EVIDENCE")], F.coalesce(count(F.col("copy_resolved")), F.lit(0)).alias("copy_resolved"))
    tall = lambda d: d.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in d.columns]), F.array(*[F.col(x).cast("long") for x in d.columns]))).alias("metric", "value"))
    return tall(a).union(tall(b)).union(tall(c))


def orders(residues: DataFrame) -> DataFrame:
    """(site_id, comp, place): each site's component of neighbourhood on paths and its place in the component's order; null where
    the order is not the only one or runs in a circle. The order is found in one kernel call for a component."""
    ship(residues.sparkSession)
    edges = cut(next_on_path(residues, ["path"], ["pos0"], "site_id").select(F.col("site_id").alias("a"), F.col("next").alias("b")).distinct(), "site-edges")
    labels = components(edges, "a", "b")
    nodes = cut(residues.select("site_id").distinct(), "sites").join(labels.hint("merge"), F.col("site_id") == F.col("node"), "left").select("site_id", F.coalesce("label", "site_id").alias("comp"))
    of = edges.join(labels.hint("merge"), F.col("a") == F.col("node")).select("a", "b", F.col("label").alias("comp"))

    def run(ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        order = graph.unique_order(ns.site_id, es[["a", "b"]].itertuples(index=False, name=None))
        place = dict(zip(order, range(len(order)))) if order is not None else {}
        return pd.DataFrame({"site_id": ns.site_id, "comp": ns.comp, "place": pd.array([place.get(n) for n in ns.site_id], dtype="Int64")})

    return nodes.groupBy("comp").cogroup(of.groupBy("comp")).applyInPandas(run, "site_id long, comp long, place long")


def leaf_presence(residues: DataFrame, absent: DataFrame) -> DataFrame:
    """(site_id, taxon, presence): 2 for a base, 1 for an aligned absence and no base; what is missing has no row."""
    both = residues.select("site_id", "taxon", F.lit(2).alias("p")).union(absent.select("site_id", "taxon", F.lit(1)))
    return both.groupBy("site_id", "taxon").agg(F.max("p").alias("presence"))


def calls(residues: DataFrame, absent: DataFrame, sites: DataFrame, tree: Tree, target: str, emit_ambiguous: bool = False, need_resolved: bool = True) -> DataFrame:
    """(site_id, decision, emitted, base): base and presence at ``target`` by parsimony. sites: site_id, copy_resolved."""
    leaves = sorted(tree.leaves)
    masks = graph.leaf_masks(residues)
    seen = leaf_presence(residues, absent).join(masks, ["site_id", "taxon"], "left")
    wide = seen.groupBy("site_id").agg(
        *[F.max(F.when(F.col("taxon") == x, F.col("mask"))).alias(f"m{k}") for k, x in enumerate(leaves)],
        *[F.max(F.when(F.col("taxon") == x, F.col("presence"))).alias(f"p{k}") for k, x in enumerate(leaves)],
    )
    base = graph.best_states(graph.sankoff(tree, target, {x: F.when(F.col(f"m{k}") > 0, F.col(f"m{k}")) for k, x in enumerate(leaves)}))
    costs = graph.sankoff(tree, target, {x: F.col(f"p{k}") for k, x in enumerate(leaves)}, states=2)
    absent_, present = F.get(costs, F.lit(0)), F.get(costs, F.lit(1))
    state = F.when(F.abs(absent_ - present) <= 1e-9, "AMBIGUOUS").when(present < absent_, "PRESENT").otherwise("ABSENT")
    rows = sites.select("site_id", "copy_resolved").join(wide, "site_id", "left").select("site_id", state.alias("state"), base.cast("int").alias("mask"), (F.col("copy_resolved") if need_resolved else F.lit(True)).alias("resolved"))
    decision = graph.decide(F.col("state"), F.col("resolved"), F.col("mask"), emit_ambiguous)
    rows = rows.withColumn("decision", decision).withColumn("emitted", F.col("decision").isin("EMITTED", "BASE_AMBIGUOUS", "PRESENCE_AMBIGUOUS_EMITTED"))
    return rows.select("site_id", "decision", "emitted", F.when(F.col("emitted"), letter_of(F.col("mask"))).alias("base"))


def blocks(called: DataFrame, order: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(block, idx, site_id, base, copy_group): runs of emitted sites along a unique order; elsewhere each emitted site is a block.

    block: ``comp:place`` of its first site, or ``site:`` and the site. copy_group: of the block, null if its sites have several.
    """
    rows = called.where("emitted").join(order.hint("merge"), "site_id")
    rows = cut(rows.join(groups.select("site_id", "copy_group"), "site_id", "left") if groups is not None else rows.withColumn("copy_group", F.lit(None).cast("string")), "emitted-sites")
    runs = ranked(rows.where("place is not null"), ["place"], "_k", ["comp"]).withColumn("_run", F.col("place") - F.col("_k"))
    first = runs.groupBy(F.col("comp").alias("_c"), F.col("_run").alias("_r")).agg(F.min("place").alias("_first"), F.when(F.countDistinct("copy_group") == 1, F.max("copy_group")).alias("_g"))
    long = runs.join(first.hint("merge"), (F.col("comp") == F.col("_c")) & (F.col("_run") == F.col("_r"))).select(
        F.concat_ws(":", F.col("comp").cast("string"), F.col("_first").cast("string")).alias("block"), (F.col("place") - F.col("_first")).alias("idx"), "site_id", "base", F.col("_g").alias("copy_group")
    )
    single = rows.where("place is null").select(F.concat(F.lit("site:"), F.col("site_id").cast("string")), F.lit(0).cast("long"), "site_id", "base", "copy_group")
    return long.union(single)


def block_sequences(block_sites: DataFrame) -> DataFrame:
    """(block, length, sequence)"""
    parts = F.array_sort(F.collect_list(F.struct("idx", "base")))
    return block_sites.groupBy("block").agg(F.count(F.lit(1)).alias("length"), F.array_join(F.transform(parts, lambda x: x["base"]), "").alias("sequence"))


def coverage_runs(block_sites: DataFrame, known: DataFrame) -> DataFrame:
    """V6: ``block_sites`` with ``run``: the idx at which the set of known paths last changed. known: site_id, path.

    Sets are compared by two sums of hashes and their size, one row a site; a site differs from the one before it if its idx - 1 has another.
    """
    shape = known.select("site_id", "path").distinct().groupBy("site_id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path")).alias("x"), F.bit_xor(F.xxhash64("path", F.lit(1))).alias("y")).alias("shape"))
    rows = cut(block_sites.join(shape, "site_id", "left"), "block-shapes")
    before = rows.select("block", (F.col("idx") + 1).alias("idx"), F.col("shape").alias("before"), F.lit(True).alias("has"))
    marked = rows.join(before, ["block", "idx"], "left").withColumn("new", (F.col("has").isNull() | ~F.col("shape").eqNullSafe(F.col("before"))))
    same = ranked(marked.where("not new").select("block", "idx"), ["idx"], "_k", ["block"]).select("block", "idx", (F.col("idx") - F.col("_k")).alias("_r"))
    # an unchanged site goes on from the head just before its stretch of unchanged ones
    heads = same.groupBy("block", "_r").agg((F.min("idx") - 1).alias("run"))
    run = same.join(heads.hint("merge"), ["block", "_r"]).select("block", "idx", "run")
    return marked.join(run.hint("merge"), ["block", "idx"], "left").select(*block_sites.columns, F.coalesce("run", "idx").alias("run"))


def children(block_sites: DataFrame, residues: DataFrame, absent: DataFrame, taxa: list[str]) -> DataFrame:
    """(block, start0, size, text, path, taxon, sequence, source_size, child_start0, child_size, child_text): the ancestor against each child, by
    stretches with the same known paths of ``taxa``. A child without a base in a stretch is an empty row; one whose positions don't follow each other is left out."""
    obs = residues.where(F.col("taxon").isin(*taxa)).select("site_id", "path", "taxon", "sequence", "source_size", "pos0", F.col("base").alias("char"))
    meta = obs.groupBy("path").agg(F.min(F.struct("taxon", "sequence", "source_size")).alias("meta"))
    gaps = absent.where(F.col("taxon").isin(*taxa)).select("site_id", "path").distinct().join(obs.select("site_id", "path"), ["site_id", "path"], "left_anti")
    known = cut(obs.select("site_id", "path", "pos0", "char").union(gaps.select("site_id", "path", F.lit(None).cast("long"), F.lit("-"))), "child-columns")
    runs = cut(coverage_runs(block_sites, known), "child-runs")
    ancestor = runs.groupBy("block", "run").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "base"))), lambda x: x["base"]), "").alias("text"))
    cells = F.array_sort(F.collect_list(F.struct("idx", "pos0", "char")))
    rows = runs.select("block", "run", "idx", "site_id").join(known.hint("merge"), "site_id").groupBy("block", "run", "path").agg(cells.alias("cells"))
    at = F.transform(F.filter("cells", lambda x: x["pos0"].isNotNull()), lambda x: x["pos0"])
    rows = rows.withColumn("at", at).withColumn("row", F.array_join(F.transform("cells", lambda x: x["char"]), ""))
    follows = (F.size("at") == 0) | F.forall(F.transform("at", lambda x, k: x - k), lambda d: d == F.get("at", F.lit(0)))
    fine = rows.where(follows).join(meta.hint("merge"), "path").join(ancestor.hint("merge"), ["block", "run"]).where(F.char_length("row") == F.col("size"))
    return fine.select("block", F.col("run").alias("start0"), "size", "text", "path", "meta.taxon", "meta.sequence", "meta.source_size", F.coalesce(F.get("at", F.lit(0)), F.lit(0)).alias("child_start0"), F.size("at").cast("long").alias("child_size"), F.col("row").alias("child_text"))


def projections(residues: DataFrame, absent: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (comp, run, path, taxon, sequence, source_size, start0, size, text) of alignments of all paths along unique orders, and what was
    left out and why: (comp, run, reason, sites). Missing coverage splits an alignment and is never a gap."""
    obs = residues.select("site_id", "path", "taxon", "sequence", "source_size", "pos0", F.col("base").alias("char"))
    meta = obs.groupBy("path").agg(F.min(F.struct("taxon", "sequence", "source_size")).alias("meta"))
    gaps = absent.select("site_id", "path").distinct().join(obs.select("site_id", "path"), ["site_id", "path"], "left_anti")
    known = cut(obs.select("site_id", "path", "pos0", "char").union(gaps.select("site_id", "path", F.lit(None).cast("long"), F.lit("-"))), "projected-columns")
    placed = cut(order, "site-orders")
    ordered = placed.where("place is not null").select(F.col("comp").alias("block"), F.col("place").alias("idx"), "site_id")
    runs = cut(coverage_runs(ordered, known), "projected-runs").withColumnRenamed("block", "comp")
    cells = F.array_sort(F.collect_list(F.struct("idx", "pos0", "char")))
    rows = runs.join(known, "site_id").groupBy("comp", "run", "path").agg(cells.alias("cells")).join(meta, "path", "left")
    at = F.transform(F.filter("cells", lambda x: x["pos0"].isNotNull()), lambda x: x["pos0"])
    rows = rows.withColumn("at", at).withColumn("row", F.array_join(F.transform("cells", lambda x: x["char"]), ""))
    # The reasons.
    bad = (
        F.when(F.col("meta").isNull(), "gap_only_path_has_no_source_metadata").when(F.size("at") == 0, "all_gap_row_requires_MAF_empty_component")
        .when(~F.forall(F.transform("at", lambda x, k: x - k), lambda d: d == F.get("at", F.lit(0))), "path_coordinates_are_not_contiguous")
    )
    rows = cut(rows.withColumn("bad", bad), "projected-rows")
    whole = rows.groupBy("comp", "run").agg(F.count(F.lit(1)).alias("paths"), F.countDistinct("meta.taxon").alias("taxa"), F.min(F.struct(F.col("path"), F.col("bad"))).alias("m"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("path"))).alias("first_bad"))
    reason = F.when((F.col("paths") < 2) | (F.col("taxa") < 2), "fewer_than_two_explicit_paths").otherwise(F.col("first_bad"))
    judged = cut(whole.select("comp", "run", reason.alias("reason")), "projected-blocks")
    sizes = runs.groupBy("comp", "run").agg(F.count(F.lit(1)).alias("sites"))
    out = judged.where("reason is not null").join(sizes, ["comp", "run"]).select("comp", "run", "reason", "sites")
    unordered = placed.where("place is null").groupBy("comp").agg(F.count(F.lit(1)).alias("sites")).select("comp", F.lit(None).cast("long"), F.lit("non_unique_or_cyclic_site_order"), "sites")
    good = rows.join(judged.where("reason is null").select("comp", "run").hint("merge"), ["comp", "run"], "left_semi")
    return good.select("comp", "run", "path", "meta.taxon", "meta.sequence", "meta.source_size", F.get("at", F.lit(0)).alias("start0"), F.size("at").cast("long").alias("size"), F.col("row").alias("text")), out.union(unordered)
