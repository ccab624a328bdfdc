"""Copies (A12, A13, G2, O10, U4): which copy group a residue belongs to, and which evidence may join residues."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.components import components
from locusframe.plans.runtime import cut_shuffled as cut, ship

#: Residues that a kernel call gets, about; more if a component has more.
BATCH = 20_000


def over_capacity(members: DataFrame, capacities: DataFrame, default: int = 1) -> DataFrame:
    """(taxon, family, n, capacity) of families with more distinct hard members in a taxon than it may have.

    members: taxon, family, member, constraint; capacities: taxon, family (null: all of a taxon), expected. A family's own
    capacity comes before its taxon's, and that before ``default``.
    """
    n = members.where("constraint = 'hard'").groupBy("taxon", "family").agg(F.countDistinct("member").alias("n"))
    own = capacities.where("family is not null").groupBy("taxon", "family").agg(F.max("expected").alias("own"))
    general = capacities.where("family is null").groupBy("taxon").agg(F.max("expected").alias("general"))
    rows = n.join(own, ["taxon", "family"], "left").join(general, "taxon", "left").withColumn("capacity", F.coalesce("own", "general", F.lit(default)).cast("long"))
    return rows.where("n > capacity").select("taxon", "family", "n", "capacity")


def choose(candidates: DataFrame, margin: float = 0.0) -> DataFrame:
    """(item, grp, hard, confidence, status) for each item with candidates (item, grp, constraint, confidence).

    Confidences of a group add up. Hard candidates come before soft ones: one hard group is taken (HARD), several are a
    contradiction (INCOMPATIBLE, grp null). Of soft groups the best is taken (SOFT), of equals the first by name, unless
    another is within ``margin`` of it (ALTERNATIVES, grp null).
    """
    total = candidates.groupBy("item", "grp", (F.col("constraint") == "hard").alias("hard")).agg(F.sum("confidence").alias("s"))
    w = Window.partitionBy("item", "hard").orderBy(F.desc("s"), "grp")
    ranked = total.select("*", F.row_number().over(w).alias("k"), F.lead("s").over(w).alias("next"), F.max("hard").over(Window.partitionBy("item")).alias("any_hard"))
    top = ranked.where("k = 1 and hard = any_hard")
    tie = F.col("next").isNotNull() & (F.col("hard") | (F.col("s") - F.col("next") <= margin + 1e-12))
    status = F.when(tie & F.col("hard"), "INCOMPATIBLE").when(tie, "ALTERNATIVES").when(F.col("hard"), "HARD").otherwise("SOFT")
    return top.select("item", F.when(~tie, F.col("grp")).alias("grp"), "hard", F.when(~tie, F.col("s")).alias("confidence"), status.alias("status"))


def join_in_order(edges: Iterable[tuple], path: dict, group: dict, excluded: dict) -> tuple[dict, list]:
    """Edges (id, a, b) in turn join their residues' sets, unless that would put two residues of a path, two explicit groups or an
    excluded group into one: (root of each residue, [(id, reason or None)])."""
    up = {n: n for n in path}
    paths = {n: {p} for n, p in path.items()}
    groups = {n: {group[n]} if group.get(n) is not None else set() for n in path}
    outs = {n: set(excluded.get(n) or ()) for n in path}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    log = []
    for eid, a, b in edges:
        x, y = find(a), find(b)
        if x == y:
            log.append((eid, None))
            continue
        if paths[x] & paths[y]:
            reason = "two residues of one path"
        elif groups[x] and groups[y] and groups[x] != groups[y]:
            reason = "different explicit groups"
        elif groups[x] & outs[y] or groups[y] & outs[x]:
            reason = "an excluded group"
        else:
            reason = None
            x, y = min(x, y), max(x, y)
            up[y] = x
            for s in (paths, groups, outs):
                s[x] |= s.pop(y)
        log.append((eid, reason))
    return {n: find(n) for n in path}, log


def resolve(residues: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments (node, path, copy_group, explicit, confidence) and audit (edge_id, selected, reason).

    residues: node (long), path, grp (explicit group or null), hard, confidence, excluded (array of groups); edges: edge_id, a, b,
    score. O10: edges with more explicit ends come first, then those of higher score, then by id. What the order decides lies within
    a component of all edges, so each is seen whole by a kernel call, with others. A set without an explicit group is named by its smallest residue;
    its confidence is 1 from three residues on, else 0.5.
    """
    ship(residues.sparkSession)
    labels = components(edges, "a", "b")
    nodes = cut(residues.join(labels, "node", "left").select("node", "path", "grp", "hard", "confidence", "excluded", F.coalesce("label", "node").alias("comp")), "copy-residues")
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("grp").isNotNull().cast("int").alias(f"{c}_explicit"), *([F.col("comp").alias("edge_comp")] if c == "a" else []))
    of = edges.join(end("a"), "a").join(end("b"), "b").select("edge_id", "a", "b", "score", (F.col("a_explicit") + F.col("b_explicit")).alias("explicit"), "edge_comp")
    audit_schema = "edge_id long, selected boolean, reason string, node long, root long"

    def run(ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        order = es.sort_values(["explicit", "score", "edge_id"], ascending=[False, False, True])[["edge_id", "a", "b"]].itertuples(index=False, name=None)
        root, log = join_in_order(order, dict(zip(ns.node, ns.path)), dict(zip(ns.node, ns.grp)), {n: x for n, x in zip(ns.node, ns.excluded) if x is not None})
        rows = [(e, r is None, r, None, None) for e, r in log] + [(None, None, None, n, r) for n, r in root.items()]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in audit_schema.split(", ")]).astype({"edge_id": "Int64", "node": "Int64", "root": "Int64", "selected": "boolean"})

    # most components have a few residues: many go through one call, which the order of edges within each allows
    deal = F.lit(max(1, nodes.count() // BATCH))
    batch = lambda c: F.pmod(F.xxhash64(c), deal).alias("batch")
    both = cut(nodes.groupBy(batch("comp")).cogroup(of.groupBy(batch("edge_comp"))).applyInPandas(run, audit_schema), "copy-sets")
    rooted = both.where("node is not null").select("node", "root").join(nodes.drop("comp"), "node")
    sets = rooted.groupBy("root").agg(F.max("grp").alias("g"), F.max("hard").alias("h"), F.max("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    name = F.coalesce("g", F.concat(F.lit("inferred_"), F.col("root").cast("string")))
    sure = F.when(F.col("g").isNotNull(), F.col("c")).when(F.col("n") >= 3, 1.0).otherwise(0.5)
    assigned = rooted.join(sets, "root").select("node", "path", name.alias("copy_group"), F.col("g").isNotNull().alias("explicit"), F.coalesce("h", F.lit(False)).alias("hard"), sure.alias("confidence"))
    return assigned, both.where("edge_id is not null").select("edge_id", "selected", F.coalesce("reason", F.lit("copy-compatible")).alias("reason"))
