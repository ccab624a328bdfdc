"""Local repair of a site graph (G8-G10): windows around conflicts, realigned and put back.

residues: site_id, path, pos0, base; absent: site_id, path; sites: site_id, boundary. A conflict is rows (conflict_id, path, pos0):
the residues that evidence would join but the graph keeps apart. Steps along a path are steps of pos0, so a
window is found by joins on (path, pos0) within a bounded reach and never reads a whole path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators import graph
from locusframe.operators.affine import Scores, align, score_rows
from locusframe.plans.runtime import cut_shuffled as cut, ship

#: Scores of local realignment, and sites of a core, at most.
POA, MOST = Scores(2, -4, -4, -2, -80, -1), 200


def windows(conflicts: DataFrame, residues: DataFrame, sites: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(conflict_id, left_site, right_site, failure) and core rows (conflict_id, path, pos0, site_id, base).

    The flanks are the boundary sites before and behind the conflict that all its paths pass, the nearest by the
    longest way to them, of equals the first by id. The core is what lies between them on every path that passes both.
    ``failure`` says why there is no window: flanks farther away than ``most`` sites count as none.
    """
    seeds = conflicts.groupBy("conflict_id", "path").agg(F.min("pos0").alias("lo"), F.max("pos0").alias("hi"))
    n_paths = seeds.groupBy("conflict_id").agg(F.count(F.lit(1)).alias("paths"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(most + 1)))
    around = seeds.select("conflict_id", "path", "lo", "hi", steps.alias("step")).select("conflict_id", "path", "step", F.explode(F.array(F.struct(F.lit("left").alias("side"), (F.col("lo") - F.col("step")).alias("pos0")), F.struct(F.lit("right").alias("side"), (F.col("hi") + F.col("step")).alias("pos0")))).alias("x")).select("conflict_id", "path", "step", "x.*")
    met = around.join(residues.select("path", "pos0", "site_id"), ["path", "pos0"])
    w = Window.partitionBy("conflict_id", "path", "side").orderBy("step")
    whole = met.withColumn("k", F.row_number().over(w)).where("k = step")  # no step is missing up to here
    flank = whole.join(sites.where("boundary").select("site_id"), "site_id").groupBy("conflict_id", "side", "site_id").agg(F.countDistinct("path").alias("n"), F.max("step").alias("far"))
    best = flank.join(n_paths, "conflict_id").where("n = paths").groupBy("conflict_id", "side").agg(F.min(F.struct("far", "site_id"))["site_id"].alias("site_id"))
    sides = best.groupBy("conflict_id").agg(F.max(F.when(F.col("side") == "left", F.col("site_id"))).alias("left_site"), F.max(F.when(F.col("side") == "right", F.col("site_id"))).alias("right_site"))
    flanked = cut(n_paths.join(sides, "conflict_id", "left"), "repair-flanks")
    at = lambda side: flanked.select("conflict_id", F.col(f"{side}_site").alias("site_id")).join(residues, "site_id").select("conflict_id", "path", F.col("pos0").alias(side))
    spans = at("left").join(at("right"), ["conflict_id", "path"]).where((F.col("left") < F.col("right")) & (F.col("right") - F.col("left") - 1 <= 2 * most))
    inner = spans.where("right - left > 1").withColumn("pos0", F.explode(F.sequence(F.col("left") + 1, F.col("right") - 1))).join(residues.select("path", "pos0", "site_id", "base"), ["path", "pos0"])
    full = inner.groupBy("conflict_id", "path").agg(F.count(F.lit(1)).alias("n"))
    passing = cut(spans.join(full, ["conflict_id", "path"], "left").where("coalesce(n, 0) = right - left - 1").select("conflict_id", "path"), "repair-paths")
    core = cut(inner.join(passing, ["conflict_id", "path"], "left_semi").select("conflict_id", "path", "pos0", "site_id", "base"), "repair-core")
    size = core.groupBy("conflict_id").agg(F.countDistinct("site_id").alias("size"))
    missing = seeds.select("conflict_id", "path").join(passing, ["conflict_id", "path"], "left_anti").groupBy("conflict_id").agg(F.lit(True).alias("missing"))
    foreign = core.select("conflict_id", "site_id").distinct().join(residues.select("site_id", "path"), "site_id").join(passing, ["conflict_id", "path"], "left_anti").groupBy("conflict_id").agg(F.lit(True).alias("foreign"))
    rows = flanked.join(size, "conflict_id", "left").join(missing, "conflict_id", "left").join(foreign, "conflict_id", "left")
    # The dispositions.
    failure = (
        F.when(F.col("paths") < 2, "fewer_than_two_conflict_paths").when(F.col("left_site").isNull() | F.col("right_site").isNull(), "no_shared_concordant_flanks").when(F.col("missing"), "conflict_path_does_not_traverse_both_flanks")
        .when(F.coalesce("size", F.lit(0)) == 0, "empty_mutable_core").when(F.col("size") > most, "core_too_large").when(F.col("foreign"), "core_contains_path_without_shared_flanks")
    )
    judged = cut(rows.select("conflict_id", "left_site", "right_site", failure.alias("failure")), "repair-windows")
    fine = judged.where("failure is null").select("conflict_id")
    # paths that pass without a base of their own between the flanks are rows of gaps
    bare = passing.join(core.select("conflict_id", "path").distinct(), ["conflict_id", "path"], "left_anti").select("conflict_id", "path", F.lit(None).cast("long"), F.lit(None).cast(core.schema["site_id"].dataType), F.lit(None).cast("string"))
    return judged, cut(core.union(bare).join(fine, "conflict_id", "left_semi"), "repair-rows")


def _consensus(rows: list[str]) -> str:
    return "".join(min((c for c in set(col) - {"-"}), key=lambda c: (-col.count(c), c)) for col in zip(*rows, strict=True))


def _added(rows: list[str], sequence: str, s: Scores) -> list[str]:
    """``rows`` and one more, aligned to their consensus: what it has between columns opens new ones."""
    top, new, _ = align(_consensus(rows), sequence, s)
    at = [k for k, c in enumerate(top) if c != "-"]
    wide = []
    for row in rows:
        cells = ["-"] * len(top)
        for k, c in zip(at, row, strict=True):
            cells[k] = c
        wide.append("".join(cells))
    return [*wide, new]


def sum_of_pairs(rows: list[str], s: Scores = POA) -> float:
    return sum(score_rows(a, b, s) for k, a in enumerate(rows) for b in rows[k + 1 :])


def realign(sequences: dict[str, str], s: Scores = POA) -> tuple[list[str], list[str], float]:
    """(paths, rows, score): each path in turn as the seed, the others added in order of name; the best by sum of pairs, of equals the smallest by its rows."""
    names = sorted(sequences)
    best: tuple | None = None
    for seed in names:
        order = [seed, *(n for n in names if n != seed)]
        rows = [sequences[seed]]
        for n in order[1:]:
            rows = _added(rows, sequences[n], s) if any(rows) else [*("-" * len(sequences[n]) for _ in rows), sequences[n]]
        table = dict(zip(order, rows, strict=True))
        kept = [k for k, col in enumerate(zip(*rows, strict=True)) if set(col) != {"-"}]
        out = ["".join(table[n][k] for k in kept) for n in names]
        key = (-sum_of_pairs(out, s), out)
        if best is None or key < best:
            best = key
    return names, best[1], -best[0]


def baseline(core: dict[str, list[tuple]], absent: set[tuple]) -> list[str] | None:
    """The rows that the graph has now, paths in order of name, if its sites have one order and every path is known at each. core: path -> [(site, base)]."""
    sites = {s for steps in core.values() for s, _ in steps}
    order = graph.unique_order(sites, [(a[0], b[0]) for steps in core.values() for a, b in zip(steps, steps[1:])])
    if order is None:
        return None
    rows = []
    for path in sorted(core):
        have = dict(core[path])
        if any(x not in have and (x, path) not in absent for x in order):
            return None
        rows.append("".join(have.get(x, "-") for x in order))
    return rows


def _overlapping(core: DataFrame, judged: DataFrame) -> DataFrame:
    """Conflicts of which an earlier one's window (core and flanks) shares a site."""
    flanks = judged.where("failure is null").select("conflict_id", F.explode(F.array("left_site", "right_site")).alias("site_id"))
    held = core.where("site_id is not null").select("conflict_id", "site_id").union(flanks).distinct()
    first = held.groupBy("site_id").agg(F.min("conflict_id").alias("first"))
    return held.join(first, "site_id").where("conflict_id > first").select("conflict_id").distinct()


def repair(conflicts: DataFrame, residues: DataFrame, absent: DataFrame, sites: DataFrame, least: float = 0.0, most: int = MOST, scores: Scores = POA) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(residues, absent, audit): conflicts repaired in the order of their ids, as far as their windows touch.

    In each round all conflicts are repaired whose windows no earlier open one touches; the rest sees the graph as it then is, and
    a conflict of which a residue was realigned is left alone. An alignment is taken if it scores ``least`` more than what the graph has now,
    or the graph has none. New sites are named by a hash of conflict and column. audit: conflict_id, disposition, before, after.
    """
    ship(residues.sparkSession)
    keep = residues.columns
    open_, done, audit = cut(conflicts, "repair-open"), None, None
    schema = "conflict_id string, path string, pos0 long, col long, disposition string, before double, after double"

    def run(core: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        cid = core.conflict_id.iloc[0]
        steps: dict[str, list[tuple]] = {p: [] for p in core.path}
        place: dict[str, list[int]] = {p: [] for p in core.path}
        for r in core.dropna(subset=["pos0"]).sort_values(["path", "pos0"]).itertuples():
            steps[r.path].append((r.site_id, r.base))
            place[r.path].append(int(r.pos0))
        names, rows, after = realign({p: "".join(b for _, b in x) for p, x in steps.items()}, scores)
        now = baseline(steps, set(zip(gone.site_id, gone.path)))
        before = None if now is None else sum_of_pairs(now, scores)
        taken = before is None or after - before + 1e-12 >= least
        out = [(cid, None, None, None, "localized_poa_applied" if taken else "candidate_patch_below_minimum_delta", before, after)]
        for path, row in zip(names, rows, strict=True) if taken else ():
            at = iter(place[path])
            out += [(cid, path, None if c == "-" else next(at), k, None, None, None) for k, c in enumerate(row)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"pos0": "Int64", "col": "Int64"})

    while not open_.isEmpty():
        judged, core = windows(open_, residues, sites, most)
        later = cut(_overlapping(core, judged), "repair-later")
        now = cut(core.join(later, "conflict_id", "left_anti"), "repair-now")
        near = cut(now.select("conflict_id", "site_id").distinct().join(absent, "site_id").select(F.col("conflict_id").alias("of"), "site_id", "path"), "repair-near")
        patch = cut(now.groupBy("conflict_id").cogroup(near.groupBy("of")).applyInPandas(run, schema), "repair-patch")
        told = patch.where("path is null").select("conflict_id", "disposition", "before", "after")
        failed = judged.where("failure is not null").select("conflict_id", F.col("failure").alias("disposition"), F.lit(None).cast("double"), F.lit(None).cast("double"))
        report = told.union(failed)
        audit = report if audit is None else audit.union(report)
        site: Column = F.xxhash64("conflict_id", "col")
        moved = patch.where("path is not null and pos0 is not null").select("path", "pos0", site.alias("new_site"))
        gaps = patch.where("path is not null and pos0 is null").select(site.alias("site_id"), "path")
        touched = now.join(patch.where("path is not null").select("conflict_id").distinct(), "conflict_id", "left_semi").where("site_id is not null").select("site_id").distinct()
        residues = cut(residues.join(moved, ["path", "pos0"], "left").withColumn("site_id", F.coalesce("new_site", "site_id")).select(*keep), "repaired")
        absent = cut(absent.join(touched, "site_id", "left_anti").select("site_id", "path").union(gaps), "repaired-absent")
        fixed = moved.select("path", "pos0")
        done = cut(fixed if done is None else done.union(fixed), "repair-done")
        rest = open_.join(report.select("conflict_id"), "conflict_id", "left_anti")
        hit = cut(rest.join(done, ["path", "pos0"], "left_semi").select("conflict_id").distinct(), "repair-hit")
        audit = cut(audit.union(hit.select("conflict_id", F.lit("overlaps_previously_repaired_core"), F.lit(None).cast("double"), F.lit(None).cast("double"))), "repair-audit")
        open_ = cut(rest.join(hit, "conflict_id", "left_anti"), "repair-open")
    if audit is None:
        audit = residues.sparkSession.createDataFrame([], "conflict_id string, disposition string, before double, after double")
    return residues, absent, audit


def paths_spelled(residues: DataFrame) -> DataFrame:
    """(path, first, last, n, hash): what each path spells, for the check that a repair leaves all sources as they are."""
    h = F.bit_xor(F.xxhash64("pos0", "base"))
    return residues.groupBy("path").agg(F.min("pos0").alias("first"), F.max("pos0").alias("last"), F.count(F.lit(1)).alias("n"), h.alias("hash"))
