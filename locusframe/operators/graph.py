"""Site graphs and ancestral calls: ordered union-find, unique orders, parsimony, decisions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.exprs import mask_of
from locusframe.operators.components import components
from locusframe.plans.runtime import cut_shuffled as cut, ship
from locusframe.sources.newick import Tree


class UnionFind:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root


def ordered_union(edges: Iterable[tuple], path: dict) -> tuple[dict, list]:
    """Edges (id, a, b) in order; one that would put two residues of one path in a site is rejected."""
    uf, paths, rejected = UnionFind(), {}, []
    for eid, a, b in edges:
        x, y = uf.find(a), uf.find(b)
        if x == y:
            continue
        p, q = paths.setdefault(x, {path[x]}), paths.setdefault(y, {path[y]})
        if p & q:
            rejected.append(eid)
            continue
        lo, hi = min(x, y), max(x, y)
        uf.up[hi] = lo
        paths[lo] = p | q
    return {v: uf.find(v) for v in path}, rejected


def sites(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, path, site, rejected)``. Components of all edges bound what must be seen together; the
    veto and the order of edge ids hold within each, in one kernel call. residues: node, path; edges: edge_id, a, b."""
    ship(residues.sparkSession)
    labels = components(edges, "a", "b")
    comp = cut(residues.join(labels, "node", "left").select("node", "path", F.coalesce("label", "node").alias("comp")), "site-components")
    of = edges.join(labels.withColumnRenamed("node", "a").hint("merge"), "a").select("edge_id", "a", "b", F.col("label").alias("comp"))

    def run(nodes: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        path = dict(zip(nodes.node, nodes.path))
        site, bad = ordered_union(es.sort_values("edge_id")[["edge_id", "a", "b"]].itertuples(index=False, name=None), path)
        return pd.DataFrame({"node": list(path), "path": list(path.values()), "site": [site[n] for n in path], "rejected": len(bad)})

    return comp.groupBy("comp").cogroup(of.groupBy("comp")).applyInPandas(run, "node long, path string, site long, rejected long")


def unique_order(nodes: Iterable, edges: Iterable[tuple]) -> list | None:
    """The topological order if it is the only one, else None."""
    after: dict = {n: set() for n in nodes}
    need = dict.fromkeys(after, 0)
    for a, b in set(edges):
        if b not in after[a]:
            after[a].add(b)
            need[b] += 1
    ready, out = [n for n, k in need.items() if not k], []
    while ready:
        if len(ready) > 1:
            return None
        n = ready.pop()
        out.append(n)
        for m in after[n]:
            need[m] -= 1
            if not need[m]:
                ready.append(m)
    return out if len(out) == len(after) else None


def sankoff(tree: Tree, target: str, leaves: dict[str, Column], states: int = 4, cost: list[list[float]] | None = None) -> Column:
    """Array with the least cost of each state at ``target``, the tree re-rooted there.

    leaves: name -> bit mask of the states seen (null: missing, any state). One expression, no UDF:
    the tree is small and known when the query is built.
    """
    cost = cost or [[float(i != j) for j in range(states)] for i in range(states)]
    near: dict[str, set[str]] = {}
    for child, parent in tree.parent.items():
        if parent is not None:
            near.setdefault(child, set()).add(parent)
            near.setdefault(parent, set()).add(child)

    def down(node: str, came: str | None) -> list[Column]:
        total = [F.lit(0.0) for _ in range(states)]
        if node in leaves:
            seen = leaves[node]
            total = [F.when(seen.isNull() | seen.bitwiseAND(1 << k).cast("boolean"), 0.0).otherwise(F.lit(1e6)) for k in range(states)]
        for other in sorted(near.get(node, ())):
            if other != came:
                below = down(other, node)
                total = [t + F.least(*[below[j] + cost[k][j] for j in range(states)]) for k, t in enumerate(total)]
        return total

    return F.array(*down(target, None))


def best_states(costs: Column) -> Column:
    """Bit mask of the states of least cost."""
    low = F.array_min(costs)
    return reduce(lambda a, b: a + b, [F.when(F.get(costs, F.lit(k)) <= low + 1e-9, 1 << k).otherwise(0) for k in range(4)])


def margin(costs: Column) -> Column:
    """How much more the second best state costs; 0 if two are best."""
    ordered = F.array_sort(costs)
    return F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0))


def leaf_masks(observed: DataFrame) -> DataFrame:
    """The bases that a taxon shows at a site, as one mask."""
    return observed.groupBy("site_id", "taxon").agg(F.bit_or(mask_of(F.col("base")).cast("int")).alias("mask"))


def consensus(observed: DataFrame) -> DataFrame:
    """The commonest base of a site; of equals the smallest."""
    n = observed.groupBy("site_id", "base").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("site_id").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("base").alias("base"))).alias("m")).select("site_id", "m.base", (-F.col("m.k")).alias("n"))


def decide(presence: Column, resolved: Column, mask: Column, emit_ambiguous: bool = False) -> Column:
    """With ``emit_ambiguous`` a site of ambiguous presence is emitted under a label of its own."""
    single = mask.isin(1, 2, 4, 8)
    # The decisions.
    ambiguous = "PRESENCE_AMBIGUOUS_EMITTED" if emit_ambiguous else "PRESENCE_AMBIGUOUS"
    return F.when(~resolved, "COPY_UNRESOLVED").when(presence == "AMBIGUOUS", ambiguous).when(presence == "ABSENT", "ANCESTRAL_ABSENT").when(~single, "BASE_AMBIGUOUS").otherwise("EMITTED")
