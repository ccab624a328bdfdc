"""Reference operators against hand-made fixtures and brute force."""

import gzip
import itertools
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.functions import exprs
from locusframe.operators import affine, ancestry, anchors, assembly, chains, copies, graph, profiles, repair, sequences
from locusframe.operators.components import components
from locusframe.operators.orders import dealt, ranked
from locusframe.operators.quota import PAIR, Chaining, Synteny, chain_quota, quota_blocks, synteny
from locusframe.plans import commands
from locusframe.sinks import text as sinks
from locusframe.sources import newick
from locusframe.sources import text as sources


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_cigar(spark):
    got = lambda c: one(spark, exprs.cigar_summary(F.lit(c)))
    assert tuple(got("5S10M2D3M1H")) == (5, 1, 13, 15)
    assert tuple(got("10M5N10=")) == (0, 0, 20, 25)
    assert tuple(got("4I6M")) == (0, 0, 6, 6)
    assert got("*") is None and got("10Q") is None


def test_scalars(spark):
    assert one(spark, exprs.normalise_bases(F.lit("acgurn"))) == "ACGTNN"
    assert one(spark, exprs.reverse_complement(F.lit("AACCSN"))) == "NSGGTT"
    assert [one(spark, exprs.gap_cost(F.lit(n))) for n in (1, 67, 100)] == [-10, -142, -175]
    assert one(spark, exprs.forward_start(F.lit(10), F.lit(5), F.lit("-"), F.lit(100))) == 85
    assert one(spark, exprs.attribute(F.lit('ID=a;gene_id "b"'), "gene_id")) == "b"
    assert one(spark, exprs.subsequence(F.lit("ACGTACGT"), F.lit(6), F.lit(2))) == "CGTAC"
    assert one(spark, exprs.split_items(F.lit(",a,,b"), ",")) == ["a", "b"]


MATCH = "ref_chr string, query_chr string, ref_start long, ref_end long, query_start long, query_end long, strand string, score double, gene string, line_no long"


def match(*rows):
    return [("R", "Q", a, b, c, d, s, 1.0, f"g{k}", k) for k, (a, b, c, d, s) in enumerate(rows)]


def test_gaps(spark):
    plus = spark.createDataFrame(match((10, 20, 5, 15, "+"), (31, 40, 26, 30, "+")), MATCH)
    minus = spark.createDataFrame(match((10, 20, 50, 60, "-"), (31, 40, 20, 30, "-")), MATCH)
    gap = lambda d: tuple(anchors.inter_anchor_gaps(d, ["ref_chr"], ["ref_start"]).select("gap_ref_start", "gap_ref_end", "gap_query_start", "gap_query_end").first())
    assert gap(plus) == (21, 30, 16, 25) and gap(minus) == (21, 30, 31, 49)


def test_global_chain(spark):
    d = spark.createDataFrame(match((1, 10, 1, 10, "+"), (11, 20, 50, 60, "+"), (21, 30, 11, 20, "+"), (31, 40, 21, 30, "+")), MATCH)
    assert [r.gene for r in chains.chain_global(d, 0.0).orderBy("pos").collect()] == ["g0", "g2", "g3"]


def test_best_chain_is_best_of_all():
    rng = random.Random(3)
    for _ in range(60):
        rows = []
        for k in range(rng.randint(1, 8)):
            r, q = rng.randint(0, 60), rng.randint(0, 60)
            rows.append(dict(ref_start=r, ref_end=r + 5, query_start=q, query_end=q + 5, strand="+", score=rng.choice([1.0, 0.5, 2.0]), gene=str(k), line_no=k))
        rows.sort(key=lambda m: (m["ref_start"], m["query_start"]))
        best = max(sum(m["score"] for m in c) for n in range(1, len(rows) + 1) for c in itertools.combinations(rows, n) if all(a["ref_end"] < b["ref_start"] and a["query_end"] < b["query_start"] for a, b in zip(c, c[1:])))
        assert sum(m["score"] for m in chains.best_chain(rows, 0.0)) == pytest.approx(best)


def test_best_chain_against_the_recurrence():
    """With inversions, word for word: which earlier match may come before a match, the nearest of equals first."""
    rng = random.Random(13)
    for _ in range(200):
        rows = [dict(ref_start=(r := rng.randrange(60)), ref_end=r + 4, query_start=(q := rng.randrange(60)), query_end=q + 4, strand=rng.choice("+-"), score=rng.choice([1.0, 0.5, 2.0]), gene=str(k), line_no=k) for k in range(rng.randint(1, 14))]
        rows = chains.reorder_inversions(sorted(rows, key=lambda m: (m["ref_start"], m["query_start"])), 1.0)
        least = rng.choice([0.0, 1.0, 2.5])
        f, prev = [m["score"] for m in rows], [None] * len(rows)
        for i, b in enumerate(rows):
            for j in range(i - 1, -1, -1):
                a = rows[j]
                if not (f[j] + b["score"] > f[i] and a["query_end"] < b["query_start"]):
                    continue
                before, turned = a["ref_end"] < b["ref_start"], a["ref_start"] > b["ref_end"]
                both = a["strand"] == b["strand"] == "-"
                if (both and (turned or (before and f[j] > least))) or (not both and before):
                    f[i], prev[i] = f[j] + b["score"], j
        k, chain = f.index(max(f)), []
        while k is not None:
            chain.insert(0, rows[k])
            k = prev[k]
        keep = chains._kept(chain, least)
        assert chains.best_chain(rows, least) == [m for m, x in zip(chain, keep) if x]


def quota(spark, rows, p):
    return chain_quota(anchors.row_ids(spark.createDataFrame(rows, MATCH)), p).collect()


def test_quota(spark):
    first = [("R", "Q1", 100 * k, 100 * k + 9, 100 * k, 100 * k + 9, "+", 1.0, f"g{k}", k) for k in range(10)]
    second = [("R", "Q2", 100 * k, 100 * k + 9, 100 * k, 100 * k + 9, "+", 0.9, f"g{k}", 100 + k) for k in range(10)]
    assert {r.query_chr for r in quota(spark, first + second, Chaining())} == {"Q1"}
    assert {r.query_chr for r in quota(spark, first + second, Chaining(ref_quota=2))} == {"Q1", "Q2"}
    # noise off the diagonal is passed over
    noise = [("R", "Q1", 450, 455, 90_000, 90_005, "+", 1.0, "x", 99)] + [("R", "Q1", 50_000 + 100 * k, 50_009 + 100 * k, 20_000 + 100 * k, 20_009 + 100 * k, "-", 1.0, f"y{k}", 200 + k) for k in range(40)]
    assert sum(r.block == 0 for r in quota(spark, first + noise, Chaining())) == 10


def slow_chains(rows, p, ways, genes):
    """The recurrences and the loop of the quota chains, word for word and from scratch for each chain taken.

    rows: dicts in order; a match's index in ``rows`` is its name. Yields (score, [indices])."""
    D, left = p.gap, list(range(len(rows)))
    ref_times, query_times = Counter(), Counter()
    query_key = (lambda m: m["query_gene"]) if genes else (lambda m: (m["query_chr"], m["query_id"]))
    at = {}
    for m in rows:
        at.setdefault(("ref", m["ref_chr"], m["ref_id"]), m)
        at.setdefault(("query", m["query_chr"], m["query_id"]), m)
    local = lambda m: not genes and "localAlignment" in m["gene"]
    quotas_on = not (genes and p.all_pairs)

    def gap(side, chrom, lo, hi, closed):
        used = (lambda m: ref_times[m["ref_gene"]] >= p.ref_quota) if side == "ref" else (lambda m: query_times[query_key(m)] >= p.query_quota)
        n = 0
        for k in range(lo, hi + 1) if closed else range(lo + 1, hi):
            m = at.get((side, chrom, k))
            if m is None or local(m):
                continue
            n += 1
            if quotas_on and used(m):
                return n, True
        return n, False

    while left:
        best = None
        for way in ways:
            f, prev = {}, {}
            for n, i in enumerate(left):
                b = rows[i]
                f[i], prev[i] = b["score"], None
                for j in reversed(left[:n]):
                    a = rows[j]
                    if (a["ref_chr"], a["query_chr"]) != (b["ref_chr"], b["query_chr"]):
                        continue
                    dq = abs(b["query_id"] - a["query_id"])
                    lo, hi = sorted((a["query_id"], b["query_id"]))
                    if genes:
                        if dq - 1 > D or (way == 0 and a["strand"] != b["strand"]):
                            continue
                        falls = b["strand"] == "-" if way == 0 else way < 0
                        if not a["ref_id"] < b["ref_id"] or not (a["query_id"] > b["query_id"] if falls else a["query_id"] < b["query_id"]):
                            continue
                        r, q = b["ref_id"] - a["ref_id"] - 1, dq - 1
                        if r > D:
                            break
                        r += 2 * D * gap("ref", b["ref_chr"], a["ref_id"], b["ref_id"], True)[1]
                        q += 2 * D * gap("query", b["query_chr"], lo, hi, True)[1]
                        dist = (r + q) / 2
                    else:
                        if a["strand"] != b["strand"] or not a["ref_end"] < b["ref_start"]:
                            continue
                        if b["strand"] == "+" and not (a["query_id"] < b["query_id"] and a["query_end"] < b["query_start"]):
                            continue
                        if b["strand"] == "-" and not (a["query_id"] > b["query_id"] and a["query_start"] > b["query_end"]):
                            continue
                        if dq - 1 > D:
                            break
                        (r, x), (q, y) = gap("ref", b["ref_chr"], a["ref_id"], b["ref_id"], False), gap("query", b["query_chr"], lo, hi, False)
                        r, q = r + 2 * D * x, q + 2 * D * y
                        dist = (r + q + abs(r - q)) / p.step
                    if r > D or q > D:
                        break
                    cand = b["score"] + f[j]
                    if dist > 0:
                        cand = cand + (0 if local(a) or local(b) else p.open) + p.extend * dist
                    if cand > f[i]:
                        f[i], prev[i] = cand, j
            for i in left:
                key = (-f[i], (rows[i]["ref_chr"], rows[i]["query_chr"]), left.index(i), ways.index(way))
                if f[i] > p.least and (best is None or key < best[0]):
                    best = key, f[i], i, prev
        if best is None:
            return
        _, score, i, prev = best
        chain = []
        while i is not None:
            chain.insert(0, i)
            i = prev[i]
        yield score, chain
        ms = [rows[i] for i in chain]
        over = lambda m, s: m[f"{s}_chr"] == ms[0][f"{s}_chr"] and m[f"{s}_start"] <= max(x[f"{s}_end"] for x in ms) and min(x[f"{s}_start"] for x in ms) <= m[f"{s}_end"]
        if quotas_on:
            if genes and p.count_members:
                ref_times.update(m["ref_gene"] for m in ms), query_times.update(m["query_gene"] for m in ms)
            else:
                ref_times.update({rows[i]["ref_gene"] for i in left if over(rows[i], "ref")})
                query_times.update({query_key(rows[i]) for i in left if over(rows[i], "query")})
        gone = set(chain)
        if not genes or p.remove_overlap:
            gone |= {i for i in left if over(rows[i], "ref") and over(rows[i], "query")}
        left = [i for i in left if i not in gone and not (quotas_on and (ref_times[rows[i]["ref_gene"]] >= p.ref_quota or query_times[query_key(rows[i])] >= p.query_quota))]


@pytest.mark.parametrize("seed", range(6))
def test_position_chains_against_the_recurrence(seed):
    rng = random.Random(seed)
    p = Chaining(least=rng.choice([0.5, 2.0]), gap=rng.choice([2, 5, 25]), ref_quota=rng.choice([1, 2]), query_quota=rng.choice([1, 2]), step=rng.choice([1.0, 3.0]))
    rows = []
    for k in range(90):
        diagonal, chrom = rng.random() < 0.7, rng.choice("AAB")
        q = 10 * (k if chrom == "A" else 95 - k) if diagonal else 10 * rng.randrange(95)
        rows.append(dict(ref_chr="R" + rng.choice("11112"), query_chr="Q" + chrom, ref_start=10 * k, ref_end=10 * k + 6, query_start=q, query_end=q + 6, strand="+" if chrom == "A" else "-", score=rng.choice([1.0, 0.9, 0.5]), gene=("localAlignment_" if rng.random() < 0.15 else "g") + str(k // rng.choice([1, 1, 2])), line_no=k))
    for c, key in (("ref", "ref_start ref_end query_start query_end line_no"), ("query", "query_start query_end ref_start ref_end line_no")):
        seen = Counter()
        for m in sorted(rows, key=lambda m: [m[x] for x in key.split()]):
            m[f"{c}_id"] = seen[m[f"{c}_chr"]]
            seen[m[f"{c}_chr"]] += 1
    for m in rows:
        m["ref_gene"] = m["query_gene"] = m["gene"]
    rows.sort(key=lambda m: [m[x] for x in "ref_chr query_chr ref_start ref_end query_start query_end line_no".split()])
    got, want = quota_blocks(pd.DataFrame(rows), p), list(slow_chains(rows, p, [0], False))
    assert [c for _, c in got] == [c for _, c in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want]) and len(got) > 1


@pytest.mark.parametrize("seed", range(12))
def test_gene_chains_against_the_recurrence(seed):
    rng = random.Random(100 + seed)
    p = Synteny(least=rng.choice([1.0, 3.0]), gap=rng.choice([2, 5, 25]), ref_quota=rng.choice([1, 2]), query_quota=rng.choice([1, 2]), strict=seed % 2 == 0, count_members=rng.random() < 0.5, remove_overlap=rng.random() < 0.5, all_pairs=seed % 5 == 4)
    rows = []
    for k in range(80):
        chrom, r = rng.choice("AAB"), rng.randrange(60)
        q = (r if chrom == "A" else 60 - r) if rng.random() < 0.7 else rng.randrange(60)
        refc = "R" + (rng.choice("112") if not p.all_pairs else "1")
        rows.append(dict(ref_gene=f"{refc}g{r}", ref_chr=refc, ref_id=r, ref_start=10 * r, ref_end=10 * r + 6, query_gene=f"Q{chrom}h{q}", query_chr="Q" + chrom, query_id=q, query_start=10 * q, query_end=10 * q + 6, strand=rng.choice("++-" if chrom == "A" else "--+"), score=rng.choice([1.0, 0.9, 0.5]), line_no=k))
    rows.sort(key=lambda m: (m["ref_chr"] + "_" + m["query_chr"], m["ref_start"], -m["ref_end"], m["ref_gene"], m["query_start"], -m["query_end"], m["line_no"]))
    ways = [0] if p.strict else [1, -1]
    got, want = quota_blocks(pd.DataFrame(rows), p), list(slow_chains(rows, p, ways, True))
    assert [c for _, c in got] == [c for _, c in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want]) and got


def test_synteny_and_helpers(spark):
    rows = [(f"a{k}", "R", k, 100 * k, 100 * k + 9, f"b{k}", "Q", 20 - k, 100 * (20 - k), 100 * (20 - k) + 9, "-", 1.0, k) for k in range(6)]
    d = spark.createDataFrame(rows, PAIR)
    for p in (Synteny(), Synteny(strict=False), Synteny(all_pairs=True)):
        got = synteny(d, p)
        assert got.count() == 6 and {r.block for r in got.collect()} == {0}
    assert chains.increasing([(1, 5), (2, 1), (3, 2), (4, 9)]) in ([(2, 1), (3, 2), (4, 9)],)
    assert len(chains.monotone([dict(strand="+", ref_start=s, ref_end=s + 5, query_start=s, query_end=s + 5) for s in (0, 3, 10)])) == 2


def test_inversion_runs_that_earn_too_little_go():
    m = lambda r, q, strand, score=1.0: dict(ref_start=r, ref_end=r + 5, query_start=q, query_end=q + 5, strand=strand, score=score)
    # a run of two, closed by a minus match that doesn't go on with it and belongs to no run itself
    chain = [m(0, 0, "+"), m(40, 10, "-"), m(30, 20, "-"), m(60, 40, "-"), m(50, 50, "-"), m(70, 70, "+"), m(80, 80, "-")]
    assert chains._kept(chain, 2.0) == [True, False, False, True, False, True, False]
    assert chains._kept(chain, 1.0) == [True, True, True, True, False, True, False] and all(chains._kept(chain, 0.5))


def brute_align(a, b, s):
    best = None

    def go(i, j, x, y):
        nonlocal best
        if i == len(a) and j == len(b):
            v = affine.score_rows(x, y, s)
            best = v if best is None else max(best, v)
            return
        if i < len(a) and j < len(b):
            go(i + 1, j + 1, x + a[i], y + b[j])
        if i < len(a):
            go(i + 1, j, x + a[i], y + "-")
        if j < len(b):
            go(i, j + 1, x + "-", y + b[j])

    go(0, 0, "", "")
    return best


def test_alignment_is_best_of_all():
    rng = random.Random(1)
    for s in (affine.Scores(), affine.Scores(2, -4, -4, -2, -5, -1)):
        for _ in range(25):
            a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 5))) for _ in range(2))
            x, y, v = affine.align(a, b, s)
            assert x.replace("-", "") == a and y.replace("-", "") == b
            assert v == pytest.approx(brute_align(a, b, s)) and affine.score_rows(x, y, s) == pytest.approx(v)


def test_windows_follow_an_insertion():
    rng = random.Random(5)
    a = "".join(rng.choices("ACGT", k=700))
    s = affine.Scores()
    for b in (a[:50] + "".join(rng.choices("ACGT", k=30)) + a[50:], a[:50] + a[80:]):
        for p, q in ((a, b), (b, a)):
            x, y, v = affine.chunked(p, q, s, 10_000)
            assert (x.replace("-", ""), y.replace("-", "")) == (p, q) and v == affine.score_rows(x, y, s) == s.gap(30)


def test_bands_and_the_choice_beyond_exact_cells(spark):
    rng = random.Random(7)
    for s in (affine.Scores(), affine.Scores(2, -4, -4, -2, -5, -1)):
        for _ in range(40):
            a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 14))) for _ in range(2))
            x, y, v = affine.banded(a, b, 20, s)
            assert (x.replace("-", ""), y.replace("-", "")) == (a, b) and v == pytest.approx(affine.align(a, b, s)[2]) == affine.score_rows(x, y, s)
            if got := affine.banded(a, b, 2, s):
                assert (got[0].replace("-", ""), got[1].replace("-", "")) == (a, b) and got[2] <= v + 1e-9 and affine.score_rows(*got[:2], s) == pytest.approx(got[2])
    assert affine.banded("ACGT", "", 2) is None or affine.banded("ACGT", "", 2)[1] == "----"
    a = "".join(rng.choices("ACGT", k=300))
    b = a[:100] + "T" + a[100:200] + a[203:]
    d = spark.createDataFrame([(1, a, b), (2, a, a[:40] + "".join(rng.choices("ACGT", k=200)) + a[40:])], "id long, a string, b string")
    got = {r.id: r for r in affine.align_pairs(d, cells=10_000).collect()}
    assert got[1].score == affine.align(a, b)[2] and got[1].method == "BANDED_MINIMAP2"
    assert all(r.row_a.replace("-", "") == a and affine.score_rows(r.row_a, r.row_b) == r.score for r in got.values())
    with pytest.raises(ValueError, match="two gaps"):
        affine.score_rows("A-", "A-", strict=True)


def test_align_pairs(spark):
    d = spark.createDataFrame([(1, "NNN", "ACGTA"), (2, "ACGT", "ACGT"), (3, None, "AC")], "id long, a string, b string")
    got = {r.id: tuple(r)[1:] for r in affine.align_pairs(d).collect()}
    assert got[1] == ("NNN--", "ACGTA", 0.0, "FILLING") and got[2] == ("ACGT", "ACGT", 0.0, "EXACT") and got[3][3] == "FILLING"
    assert affine.chunked("ACGT" * 10, "ACGT" * 10, affine.Scores(), 100)[2] == 0


def test_overlap_join_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    a = [("c", s, s + rng.randint(0, 90)) for s in (rng.randrange(1000) for _ in range(60))]
    b = [("c", s, s + rng.randint(0, 90)) for s in (rng.randrange(1000) for _ in range(60))]
    got = anchors.overlap_join(spark.createDataFrame(a, "k string, s1 long, e1 long"), spark.createDataFrame(b, "k string, s2 long, e2 long"), ["k"], "s1", "e1", "s2", "e2", 64).collect()
    assert sorted(tuple(r) for r in got) == sorted(("c", x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_graph(spark):
    site, bad = graph.ordered_union([(1, 0, 1), (2, 2, 3), (3, 1, 2)], {0: "p", 1: "q", 2: "p", 3: "r"})
    assert bad == [3] and site[0] == site[1] != site[2] == site[3]
    assert graph.unique_order([1, 2, 3], [(1, 2), (2, 3)]) == [1, 2, 3] and graph.unique_order([1, 2, 3], [(1, 2)]) is None
    nodes = spark.createDataFrame([(0, "p"), (1, "q"), (2, "p"), (3, "r"), (9, "s")], "node long, path string")
    edges = spark.createDataFrame([(1, 0, 1), (2, 2, 3), (3, 1, 2)], "edge_id long, a long, b long")
    assert {r.node: r.site for r in graph.sites(nodes, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 9: 9}


def test_sankoff(spark):
    tree = newick.parse("((a,b)anc,c)root;")
    d = spark.createDataFrame([("A", "A", "C"), ("A", "C", None)], "a string, b string, c string")
    leaves = {x: F.when(F.col(x).isNotNull(), exprs.mask_of(F.col(x)).cast("int")) for x in "abc"}
    cost = graph.sankoff(tree, "anc", leaves)
    got = d.select(F.array_min(cost).alias("best"), exprs.letter_of(graph.best_states(cost)).alias("call"), graph.margin(cost).alias("m")).collect()
    assert [tuple(r) for r in got] == [(1.0, "A", 1.0), (1.0, "M", 0.0)]


def test_newick():
    t = newick.parse("(('a b':1,c:2)[note]x:0.5,d);")
    assert t.leaves == ["a b", "c", "d"] and t.parent["c"] == "x" and t.length["x"] == 0.5
    for bad in ("(a,a);", "(a,b)", "(a:-1,b);", "(,b);"):
        with pytest.raises(ValueError):
            newick.parse(bad)


def test_gff2seq(spark, tmp_path):
    (tmp_path / "g.fa").write_bytes(b">c1 first\nACGTACGT\nAACCGGTT\n>c2\nAC\n>c1 again\nACGTACGTAACCGGTT\n")
    cds = ["c1\t.\tCDS\t1\t4\t.\t+\t0\tParent=t1", "c1\t.\tCDS\t7\t8\t.\t+\t0\tParent=t1", "c1\t.\tCDS\t9\t12\t.\t-\t0\tParent=t2"]
    genes = ["c1\t.\tmRNA\t1\t8\t.\t+\t.\tID=t1;Parent=g1", "c1\t.\tmRNA\t9\t12\t.\t-\t.\tID=t2;Parent=g2"]
    (tmp_path / "g.gff").write_bytes(gzip.compress("\n".join(["#", *cds, *genes]).encode()))  # no suffix tells of the compression
    run = lambda: {r.gene: (r.transcript, r.seq) for r in commands.gff2seq(sources.read_sequences(spark, f"{tmp_path}/g.fa"), sources.read_gff(spark, f"{tmp_path}/g.gff"), sources.read_gene_map(spark, f"{tmp_path}/g.gff")).collect()}
    assert run() == {"g1": ("t1", "ACGTGT"), "g2": ("t2", "GGTT")}
    more = [x.replace("t1", "t3") for x in cds[:2]] + [genes[0].replace("t1", "t3")]
    (tmp_path / "g.gff").write_bytes("\n".join(cds + genes + more).encode())
    assert run() == {"g2": ("t2", "GGTT")}


def test_sam_maf_pairs_and_manifests(spark, tmp_path):
    p = lambda name, text: (tmp_path / name).write_text(text) and f"{tmp_path}/{name}"
    sam = p("a.sam", "@PG\tID:minimap2\tCL:minimap2 -k 12 -O 6,26 -E 2,1 x\nq\t16\tc1\t5\t60\t5S10M\tx\nbad\tz\tc1\t5\t60\t5M\tx\nu\t4\t*\t0\t0\t*\tx\n")
    assert [(r.qname, r.reverse, r.head, r.span) for r in sources.read_sam(spark, sam).collect()] == [("q", True, 5, 10)]
    assert sources.mapper_settings(spark, sam) | {} == {"k": 12, "A": 2, "B": 4, "O": 6, "E": 6, "H": 0, "w": 7}
    maf = p("a.maf", "##maf\na score=1\ns x.c 10 3 - 100 A-CG\ns y.c 0 4 + 50 AACG\n\n")
    assert [(r.source, r.row) for r in sources.read_maf(spark, maf).orderBy("row").collect()] == [("x.c", 0), ("y.c", 1)]
    with pytest.raises(Exception, match="malformed"):
        sources.read_maf(spark, p("b.maf", "a\ns x 0 3 + 9 ACGT\ns y 0 4 + 9 ACGT\n")).collect()
    with pytest.raises(Exception, match="13 columns"):
        sources.read_pairs(spark, p("p.tsv", "a\tb\n")).collect()
    good = "g1\tc1\t1\t10\t20\t+\th1\td1\t2\t30\t40\t-\t90.0\n"
    assert [(r.score, r.strand) for r in sources.read_pairs(spark, p("q.tsv", "#x\n" + good)).collect()] == [(0.9, "-")]
    head = "taxon_id\trole\tfasta\tgff\tanchor_sam\tanchor_fasta\tcallability_bed\tquality_weight\n"
    row = lambda i, r: f"{i}\t{r}\t.\t.\t.\t.\t.\t1\n"
    taxa = sources.read_taxa(spark, p("t.tsv", head + row("a", "ingroup_reference") + row("b", "ingroup") + row("c", "primary_outgroup")))
    assert taxa.count() == 3
    with pytest.raises(ValueError, match="role"):
        sources.read_taxa(spark, p("u.tsv", head + row("a", "ingroup") + row("b", "guest") + row("c", "primary_outgroup")))
    pairs = "taxon_a\ttaxon_b\tmaf\tanchor_map\tscore_profile\tweight\na\tb\tm\t.\t.\t1\na\tc\tm\t.\t.\t1\n"
    with pytest.raises(ValueError, match="missing"):
        sources.read_pairwise(spark, p("w.tsv", pairs), taxa)
    assert sources.read_pairwise(spark, p("x.tsv", pairs + "b\tc\tm\t.\t.\t1\n"), taxa).count() == 3


def test_sinks(spark, tmp_path):
    chain = spark.createDataFrame(match((10, 20, 5, 15, "+"), (31, 40, 26, 30, "+")), MATCH).withColumn("block", F.lit(0))
    gaps = anchors.inter_anchor_gaps(chain, ["block", "ref_chr", "query_chr"], ["ref_start"])
    head = ["#tool -x 1", sinks.ANCHOR_HEAD]
    sinks.write_lines(sinks.anchor_lines(chain, gaps), f"{tmp_path}/anchors", ["block", "at"], head)
    lines = [x for f in sorted((tmp_path / "anchors").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:3] == [*head, "#block begin"] and lines[-1] == "#block end" and "\tinteranchor\t" in lines[4] and len(lines) == 7
    whole = tmp_path / "anchors.tsv"
    whole.write_text("\n".join(lines) + "\n")
    assert sources.read_anchors(spark, f"{whole}").count() == 2
    assert sources.resumed_anchors(spark, f"{whole}", "tool -x 1").count() == 2 and sources.resumed_anchors(spark, f"{whole}", "tool -x 2") is None and sources.resumed_anchors(spark, f"{tmp_path}/none", "x") is None
    whole.write_text("\n".join(lines[:-1]) + "\n")
    assert sources.resumed_anchors(spark, f"{whole}", "tool -x 1") is None
    size = lambda n: spark.createDataFrame([("R", n), ("Q", n)], "name string, length long")
    tail = [r.line for r in sinks.anchor_lines(chain, gaps, size(100), size(90)).orderBy("block", "at").collect()][-2]
    assert tail.split("\t")[:8] == ["R", "41", "100", "Q", "31", "90", "+", "interanchor"]
    rows = [(f"a{k}", "R", k, 100 * k, 100 * k + 9, f"b{k}", "Q", 20 - k, 100 * (20 - k), 100 * (20 - k) + 9, "-", 1.0, k) for k in range(6)]
    got = [r.line for r in sinks.synteny_lines(synteny(spark.createDataFrame(rows, PAIR))).orderBy("block", "pos").collect()]
    assert got[0].split("\t")[:3] == ["##Alignment", "1", "N=6"] and got[0].endswith("R&Q\tNEGATIVE") and len(got) == 7 and got[1].startswith("a0\tR\t0\t0\t9\tb0\tQ\t20\t")
    frag = spark.createDataFrame([(0, "r", "q", "-", 1, 4, 11, 13, "ACGT", "AC-T", -10.0, 100, 50, "BANDED_MINIMAP2")], "block long, ref_chr string, query_chr string, strand string, ref_start long, ref_end long, query_start long, query_end long, ref_row string, query_row string, score double, ref_size long, query_size long, method string")
    maf = sinks.maf_lines(frag, ["block"], 3).first().line.split("\n")
    assert maf[0] == "a\tscore=-10" and maf[2] == "s\tq  \t       37\t        3\t-\t50\tAC-T" and maf[1].split("\t")[2:4] == ["        0", "        4"]
    assert sinks.bed_lines(frag).first().line == "r\t0\t4\tBANDED_KSW2\t-10\t-\tq\t10\t13"
    with pytest.raises(ValueError, match="no genes"):
        sinks.at_least_one(frag.limit(0), "genes")


def test_catalog_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


# ---------------------------------------------------------------- files in many tasks, sequences in chunks


def test_lines_and_sequences_in_many_splits(spark, tmp_path):
    rng = random.Random(3)
    base = lambda n: "".join(rng.choices("ACGTN", k=n))
    seqs = {"a": base(1000), "b": "", "c": base(7), "d": base(333)}
    wrapped = lambda s, w: "".join(f"{s[k : k + w]}\r\n" for k in range(0, len(s), w))
    text = "".join(f">{n} told \tmore\n{wrapped(s, 31)}" for n, s in seqs.items()) + "\n>a again\nAC\n\nGT\n"
    seqs["a"] = "ACGT"
    (tmp_path / "plain.fa").write_text(text)
    (tmp_path / "named.fa.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "told.fa").write_bytes(gzip.compress(text.encode()))
    odd = "one\r\ntwo\x0b\x0c\x1c\x85three\u2028four\n\nlast"
    (tmp_path / "odd.txt").write_text(odd, newline="")
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "100")
    try:
        assert spark.read.text(f"{tmp_path}/plain.fa").rdd.getNumPartitions() > 5
        for name in ("plain.fa", "named.fa.gz", "told.fa"):
            for size in (16, 1 << 16):
                chunks = sources.read_sequences(spark, f"{tmp_path}/{name}", size).collect()
                assert all(len(r.bases) <= size for r in chunks)
                got = {n: "".join(r.bases for r in sorted(chunks, key=lambda r: r.chunk) if r.name == n) for n in {r.name for r in chunks}}
                assert got == seqs, name
            lines = sources.read_lines(spark, f"{tmp_path}/{name}").orderBy("line_no").collect()
            assert [(r.line_no, r.value) for r in lines] == list(enumerate(x.rstrip("\r") for x in text[:-1].split("\n")))
        assert [r.value for r in sources.read_lines(spark, f"{tmp_path}/odd.txt").orderBy("line_no").collect()] == ["one", "two\x0b\x0c\x1c\x85three\u2028four", "", "last"]
    finally:
        spark.conf.set(conf, before)
    assert {r.name: (r.length, r.seq) for r in sources.read_fasta(spark, f"{tmp_path}/told.fa").collect()} == {n: (len(s), s) for n, s in seqs.items()}


def test_intervals_of_chunked_sequences(spark):
    rng = random.Random(4)
    seqs = {n: "".join(rng.choices("ACGTRYU", k=k)) for n, k in (("a", 100), ("b", 16), ("c", 1))}
    chunks = sequences.chunked(spark.createDataFrame(list(seqs.items()), "name string, seq string"), 16)
    assert {r.name: r.length for r in sequences.lengths(chunks, 16).collect()} == {n: len(s) for n, s in seqs.items()}
    want, rows = {}, []
    for k in range(60):
        n, a, b = rng.choice(list(seqs)), rng.randint(-5, 110), rng.randint(-5, 110)
        rows.append((k, n, a, b))
        lo, hi = (min(max(x, 1), len(seqs[n])) for x in sorted((a, b)))
        want[k] = seqs[n][lo - 1 : hi].translate(str.maketrans("RYU", "NNT"))
    got = sequences.fetch(spark.createDataFrame([*rows, (99, "unknown", 1, 2)], "id long, name string, start1 long, end1 long"), chunks, 16)
    assert {r.id: r.bases for r in got.collect()} == want


# ---------------------------------------------------------------- from anchors to alignments


def test_chromosome_and_block_alignment(spark):
    rng = random.Random(6)
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    ref = base(200)
    query = "GG" + ref[:60] + base(5) + turn(ref[60:120]) + ref[125:200] + "TTT"
    # the middle is turned around: its first anchor on the reference is its last on the query
    at = {"m1": (1, 50, 3, 52, "+"), "m2": (61, 80, 108, 127, "-"), "m3": (91, 120, 68, 97, "-"), "m4": (131, 200, 133, 202, "+")}
    assert all(ref[a - 1 : b] == (query[c - 1 : d] if s == "+" else turn(query[c - 1 : d])) for a, b, c, d, s in at.values())
    rows = [("R", "Q", a, b, c, d, s, 1.0, g, k, k) for k, (g, (a, b, c, d, s)) in enumerate(at.items())]
    chain = spark.createDataFrame(rows, MATCH + ", pos long")
    whole = lambda n, s: sequences.chunked(spark.createDataFrame([(n, s)], "name string, seq string"))
    r, q = whole("R", ref), whole("Q", query)
    for kept in (chain, chain.where("gene in ('m1', 'm4')")):
        frags = commands.chromosome_alignment(kept, r, q)
        got = frags.orderBy("ord").collect()
        assert assembly.check_rows(frags, r, q).count() == 0
        assert got[0].kind == "GAP" and got[0].method == "FILLING" and got[0].query_row == "GG" and got[0].ref_row == "--"
        blocks = {b.sub: b for b in assembly.blocks(frags).collect()}
        if kept is chain:
            assert [f.kind for f in got] == ["GAP", "ANCHOR", "ANCHOR", "GAP", "ANCHOR", "ANCHOR"] and set(blocks) == {0, 1, 2}
            assert blocks[1].strand == "-" and blocks[1].ref_row == ref[60:120] == blocks[1].query_row and blocks[1].score == 0 and (blocks[1].query_start, blocks[1].query_end) == (68, 127)
        else:  # without an inversion the chromosomes are aligned from end to end
            (b,) = blocks.values()
            assert got[-1].kind == "TAIL" and b.ref_row.replace("-", "") == ref and b.query_row.replace("-", "") == query and b.score == sum(f.score for f in got)
            assert (b.ref_start, b.ref_end, b.query_start, b.query_end) == (1, 200, 1, len(query))
    minus = chain.where("strand = '-'").withColumn("block", F.lit(7)).withColumn("pos", F.col("pos") - 1)
    frags = commands.block_alignment(minus, r, q)
    assert [f.kind for f in frags.orderBy("ord").collect()] == ["ANCHOR", "GAP", "ANCHOR"] and assembly.blocks(frags).first().query_row == ref[60:120]


def test_two_sequences(spark):
    one_ = lambda n, s: spark.createDataFrame([(n, s)], "name string, seq string")
    got = commands.align_sequences(one_("r", "ACGTACGT"), one_("q", "ACGACGT")).orderBy("ord").collect()
    assert [(x.name, x.row.replace("-", "")) for x in got] == [("r", "ACGTACGT"), ("q", "ACGACGT")] and got[0].score == -10
    assert sinks.record_lines(commands.align_sequences(one_("r", "AC"), one_("q", "AC"))).orderBy("ord").collect()[1].line == ">q\nAC"


# ---------------------------------------------------------------- orders, matches, profiles


def test_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), k) for k in range(400)]
    d = spark.createDataFrame(rows, "g string, x long, id long").repartition(7)
    got = {r.id: r.k for r in ranked(d, ["x", "id"], "k").collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    within = {r.id: r.k for r in ranked(d, [F.desc("x"), "id"], "k", ["g"]).collect()}
    for g in ("a", "b", None):
        assert [within[r[2]] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))] == list(range(sum(r[0] == g for r in rows)))
    parts = dealt(d, "x", 4).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(parts) == 4 and max(r.s for r in parts) - min(r.s for r in parts) <= 100 and {r.n for r in parts} == {100}
    assert ranked(d.limit(0), ["x"], "k").count() == 0


def test_lifted_alignments(spark):
    exons = [("plus", "c", "+", 11, 20, 1), ("plus", "c", "+", 31, 40, 2), ("minus", "c", "-", 11, 20, 3), ("minus", "c", "-", 31, 40, 4)]
    f = spark.createDataFrame(exons, "transcript string, seqid string, strand string, start1 long, end1 long, line_no long")
    hits = [(1, "plus", False, 2, 3, 20), (2, "plus", True, 2, 3, 20), (3, "minus", False, 2, 3, 20), (4, "minus", True, 2, 3, 20), (5, "plus", False, 25, 0, 20)]
    h = spark.createDataFrame(hits, "line_no long, transcript string, reverse boolean, head long, tail long, cds_len long")
    got = {r.line_no: (r.ref_start, r.ref_end) for r in anchors.lifted(h, anchors.cds_segments(f)).collect()}
    assert got == {1: (13, 37), 2: (14, 38), 3: (14, 38), 4: (13, 37)}


def test_matches_from_records(spark):
    exons = [(t, "c1", s, a, a + 99, k) for k, (t, s, a) in enumerate([("t1", "+", 1001), ("t2", "-", 2001), ("t3", "+", 3001)])]
    f = spark.createDataFrame(exons, "transcript string, seqid string, strand string, start1 long, end1 long, line_no long")
    genes = spark.createDataFrame([("t1", "g1"), ("t2", "g2"), ("t3", "g3")], "transcript string, gene string")
    sam = [(0, "t1", 0, "d", 501, False, 0, 0, 100, 100), (1, "t2", 0, "d", 901, False, 0, 0, 90, 100), (2, "t3", 0, "d", 5000, False, 0, 0, 95, 100), (3, "t3", 16, "d", 5050, True, 0, 0, 95, 100), (4, "t9", 0, "d", 1, False, 0, 0, 9, 9), (5, "t1", 0, "*", 1, False, 0, 0, 9, 9)]
    s = spark.createDataFrame(sam, "line_no long, qname string, flag int, rname string, pos1 long, reverse boolean, head long, tail long, aligned long, span long")
    got = {r.gene: r for r in anchors.matches(s, f, genes).collect()}
    # t3 maps twice, near its own last place
    assert set(got) == {"g1", "g2"} and got["g1"].strand == "+" and got["g2"].strand == "-" and got["g2"].score == 0.9
    assert (got["g1"].ref_start, got["g1"].ref_end, got["g1"].query_start, got["g1"].query_end) == (1001, 1100, 501, 600)


def test_union_length_over_the_edges_of_bins(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), s, s + rng.randint(0, 60)) for s in (rng.randrange(600) for _ in range(80))]
    d = spark.createDataFrame(rows, "k string, s long, e long")
    got = {r.k: (r.covered, r.n, r.islands) for r in anchors.merged_length(d, ["k"], "s", "e", 16).collect()}
    for k in "ab":
        mine = sorted(r[1:] for r in rows if r[0] == k)
        islands, high = 0, None
        for s, e in mine:
            islands += high is None or s > high
            high = e if high is None else max(high, e)
        assert got[k] == (len({x for s, e in mine for x in range(s, e + 1)}), len(mine), islands)


def test_seed_chains_look_back_far_enough():
    from locusframe.operators import mapping

    rng = random.Random(15)
    for _ in range(60):
        pairs = sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(25)} | {(10 * k, 10 * k + rng.choice([0, 0, 3])) for k in range(20)})
        every = mapping.chain_seeds(pairs, 15, misses=10**9)
        few = mapping.chain_seeds(pairs, 15)
        assert few[0] <= every[0] and few[0] >= 0.95 * every[0] and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(few[1], few[1][1:]))
    assert mapping.chain_seeds([], 15) == (0.0, [])


def test_kmer_sketches(spark):
    rng = random.Random(10)
    seqs = {k: "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=rng.randint(0, 300))) for k in range(6)} | {7: "ACACACACACACACACACAC", 8: None}
    got = {}
    for r in profiles.sketch(spark.createDataFrame(list(seqs.items()), "id long, seq string"), 5, most=2).collect():
        got.setdefault(r.id, []).append((r.hash, r.pos))
    for k, s in seqs.items():
        places = {}
        for i in range(len(s or "") - 4):
            if "N" not in s[i : i + 5]:
                places.setdefault(s[i : i + 5], []).append(i)
        assert sorted(p for _, p in got.get(k, [])) == sorted(p for ps in places.values() for p in ps[:2])
        assert len({h for h, _ in got.get(k, [])}) == len(places)


# ---------------------------------------------------------------- graph


def test_copy_resolution(spark):
    nodes = [(1, "x|c", None, False, None, None), (2, "y|c", "A", True, 0.9, None), (3, "z|c", None, False, None, ["A"]), (4, "y|d", "B", False, 0.4, None), (5, "x|d", None, False, None, None), (6, "w|c", None, False, None, None)]
    edges = [(10, 1, 2, 5.0), (11, 1, 3, 9.0), (12, 2, 3, 1.0), (13, 2, 4, 3.0), (14, 1, 5, 8.0), (15, 5, 4, 8.0)]
    assigned, audit = copies.resolve(spark.createDataFrame(nodes, "node long, path string, grp string, hard boolean, confidence double, excluded array<string>"), spark.createDataFrame(edges, "edge_id long, a long, b long, score double"))
    # explicit ends first: 13 (two, rejected), 15, 10, 12 (excluded) by score, then 11 and 14
    log = {r.edge_id: (r.selected, r.reason) for r in audit.collect()}
    assert [k for k, v in log.items() if v[0]] and {k: v[0] for k, v in log.items()} == {10: True, 11: False, 12: False, 13: False, 14: False, 15: True}
    assert log[13][1] == "different explicit groups" and log[12][1] == "an excluded group" and log[11][1] == "an excluded group" and log[14][1] == "different explicit groups"
    got = {r.node: (r.copy_group, r.hard, r.confidence) for r in assigned.collect()}
    assert got[1] == got[2] == ("A", True, 0.9) and got[4] == got[5] == ("B", False, 0.4) and got[3] == ("inferred_3", False, 0.5) and got[6] == ("inferred_6", False, 0.5)


def test_children_and_projections(spark):
    # sites 1 to 5 in a row; path p lacks site 3 (an aligned absence), path q jumps at site 5
    rows = [(s, "x", "x|p", "p", s + 9 - (s > 3), 50, "ACGTA"[s - 1]) for s in (1, 2, 4, 5)] + [(s, "y", "y|q", "q", s + (20 if s == 5 else 0), 50, "ACGTA"[s - 1]) for s in range(1, 6)]
    g = spark.createDataFrame(rows, "site_id long, taxon string, path string, sequence string, pos0 long, source_size long, base string")
    absent = spark.createDataFrame([(3, "x", "x|p")], "site_id long, taxon string, path string")
    order = {r.site_id: (r.comp, r.place) for r in ancestry.orders(g).collect()}
    assert order == {s: (1, s - 1) for s in range(1, 6)}
    called = g.select("site_id").distinct().withColumn("emitted", F.lit(True)).withColumn("base", F.substring(F.lit("ACGTA"), F.col("site_id").cast("int"), F.lit(1)))
    sites = ancestry.blocks(called, ancestry.orders(g))
    assert [(r.length, r.sequence) for r in ancestry.block_sequences(sites).collect()] == [(5, "ACGTA")]
    kids = ancestry.children(sites, g, absent, ["x", "y"]).collect()
    assert [(k.path, k.child_text, k.child_start0, k.child_size, k.start0, k.size) for k in kids] == [("x|p", "AC-TA", 10, 4, 0, 5)]
    assert sinks.child_lines(spark.createDataFrame(kids)).first().line.split("\n")[2].split("\t") == ["s", "p", "10", "4", "+", "50", "AC-TA"]
    good, out = ancestry.projections(g, absent, ancestry.orders(g))
    assert good.count() == 0 and [(r.reason, r.sites) for r in out.collect()] == [("path_coordinates_are_not_contiguous", 5)]
    straight = g.withColumn("pos0", F.when(F.col("path") == "y|q", F.col("site_id")).otherwise(F.col("pos0")))
    good, out = ancestry.projections(straight, absent, ancestry.orders(straight))
    assert {(r.path, r.text, r.start0, r.size) for r in good.collect()} == {("x|p", "AC-TA", 10, 4), ("y|q", "ACGTA", 1, 5)} and out.count() == 0
    # two sites that no path puts in order: no order, a block each
    loose = g.where("site_id in (1, 2) and path = 'x|p'").unionByName(g.where("site_id in (1, 3)  and path = 'y|q'"))
    assert {r.site_id: r.place for r in ancestry.orders(loose).collect()} == {1: None, 2: None, 3: None}
    assert sorted(r.block for r in ancestry.blocks(called, ancestry.orders(loose)).collect()) == ["site:1", "site:2", "site:3"]
    ancestry.check_tree(newick.parse("((x,y)anc,z)root;"), ["x", "y", "z"], "anc")
    for taxa, target in ((["x", "y"], "anc"), (["x", "y", "z"], "x"), (["x", "y", "z"], "none")):
        with pytest.raises(ValueError):
            ancestry.check_tree(newick.parse("((x,y)anc,z)root;"), taxa, target)
    a, b = (ancestry.core_hash(d).first().core_hash for d in (g, g.orderBy(F.desc("pos0")).repartition(3)))
    assert a == b != ancestry.core_hash(straight).first().core_hash


def test_graph_lines(spark):
    rows = [(s, "x", "x|p", "p", s, 50, "AC"[s % 2]) for s in (1, 2, 4)]
    g = spark.createDataFrame(rows, "site_id long, taxon string, path string, sequence string, pos0 long, source_size long, base string")
    sites = spark.createDataFrame([(1, "CONSISTENT", "f a"), (2, "MISSING_EVIDENCE", None), (4, "CONSISTENT", None)], "site_id long, consistency string, copy_group string")
    lines = [r.line for r in sinks.gfa_lines(g, sites, "core_x").orderBy("part", "key").collect()]
    assert lines[0] == "H\tVN:Z:1.1\tCH:Z:core_x" and "S\t1_C\tC\tSI:Z:1\tCL:Z:CONSISTENT\tCG:Z:f a" in lines and "P\tx|p:1\t1_C+,2_A+\t*\tTX:Z:x\tSN:Z:p\tSO:i:1\tEO:i:3" in lines
    assert [x for x in lines if x.startswith("L")] == ["L\t1_C\t+\t2_A\t+\t0M"] and sum(x.startswith("P") for x in lines) == 2
    absent = spark.createDataFrame([(2, "y", "y|q")], "site_id long, taxon string, path string")
    meta = sorted(r.line for r in sinks.metadata_lines(g, absent, sites).collect())
    assert len(meta) == 4 and "2\t.\t.\ty|q\t.\t.\t.\tALIGNED_ABSENCE\t-\t.\tMISSING_EVIDENCE" in meta


def test_realignment_is_as_good_as_any_progressive_one():
    names, rows, score = repair.realign({"b": "ACGT", "a": "AGT", "c": ""})
    assert names == ["a", "b", "c"] and [r.replace("-", "") for r in rows] == ["AGT", "ACGT", ""] and score == repair.sum_of_pairs(rows) and len({len(r) for r in rows}) == 1
    assert repair.realign({"x": "", "y": ""})[1] == ["", ""]
    assert repair.baseline({"p": [(1, "A"), (2, "C")], "q": [(1, "A")]}, {(2, "q")}) == ["AC", "A-"] and repair.baseline({"p": [(1, "A"), (2, "C")], "q": [(1, "A")]}, set()) is None
    assert repair.baseline({"p": [(1, "A"), (2, "C")], "q": [(2, "C"), (1, "A")]}, set()) is None


def test_local_repair(spark):
    # two paths agree on sites 0 to 2 and 7 to 9; between them one base was put beside itself: q's sites 13 to 16 are its own
    p = [(k, "x|p", k, "ACGTACGTAC"[k]) for k in range(10)]
    q = [(k if k < 3 or k > 6 else 10 + k, "y|q", k, "ACGTACGTAC"[k]) for k in range(10)]
    far = [(50 + k, path, 100 + k, "A") for path in ("x|p", "y|q") for k in range(4)]
    residues = spark.createDataFrame([*p, *q, *far], "site_id long, path string, pos0 long, base string")
    absent = spark.createDataFrame([(s, "y|q") for s in range(3, 7)] + [(10 + s, "x|p") for s in range(3, 7)], "site_id long, path string")
    sites = residues.select("site_id").distinct().withColumn("boundary", (F.col("site_id") < 3) | F.col("site_id").between(7, 9))
    conflicts = spark.createDataFrame([("c1", "x|p", 4), ("c1", "y|q", 4), ("c2", "x|p", 5), ("c2", "y|q", 5), ("c3", "x|p", 102), ("c3", "y|q", 102), ("c4", "x|p", 1)], "conflict_id string, path string, pos0 long")
    judged, core = repair.windows(conflicts, residues, sites)
    assert {(r.conflict_id, r.left_site, r.right_site, r.failure) for r in judged.collect()} == {("c1", 2, 7, None), ("c2", 2, 7, None), ("c3", None, None, "no_shared_concordant_flanks"), ("c4", 0, 2, "fewer_than_two_conflict_paths")}
    assert core.where("conflict_id = 'c1'").count() == 8
    new, gaps, audit = repair.repair(conflicts, residues, absent, sites)
    log = {r.conflict_id: r for r in audit.collect()}
    assert {k: v.disposition for k, v in log.items()} == {"c1": "localized_poa_applied", "c2": "overlaps_previously_repaired_core", "c3": "no_shared_concordant_flanks", "c4": "fewer_than_two_conflict_paths"}
    assert log["c1"].after == 8 and log["c1"].before is None  # p's and q's own sites have no order among each other
    at = {(r.path, r.pos0): r.site_id for r in new.collect()}
    assert all(at["x|p", k] == at["y|q", k] for k in range(10)) and all(at["x|p", k] == k for k in (0, 1, 2, 7, 8, 9)) and len(set(at.values())) == 14 and gaps.count() == 0
    assert sorted(map(tuple, repair.paths_spelled(new).collect())) == sorted(map(tuple, repair.paths_spelled(residues).collect()))
    kept, _, audit = repair.repair(conflicts.where("conflict_id = 'c1'"), new, gaps, sites.where("boundary").union(new.select("site_id", F.lit(False)).distinct()), least=1.0)
    assert [(r.disposition, r.before, r.after) for r in audit.collect()] == [("candidate_patch_below_minimum_delta", 8.0, 8.0)] and {(r.path, r.pos0): r.site_id for r in kept.collect()} == at


def test_commands_from_matches_to_alignments(spark):
    """Both commands end to end: anchors, new anchors in the gap between them, aligned fragments that spell their sources."""
    rng = random.Random(12)
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    ref = base(900)
    query = base(20) + ref[:350] + base(15) + ref[380:900]
    one_ = lambda s: sequences.chunked(spark.createDataFrame([("c", s)], "name string, seq string"))
    r, q = one_(ref), one_(query)
    rows = [("c", "c", a, a + 29, b, b + 29, "+", 1.0, f"g{k}", k) for k, (a, b) in enumerate([(1, 21), (41, 61), (81, 101), (821, len(query) - 79), (861, len(query) - 39)])]
    d = spark.createDataFrame(rows, MATCH)
    whole = commands.genome_anchors(d, r, q, side=100)
    got = whole.orderBy("pos").collect()
    assert len(got) > 5 and [x.pos for x in got] == list(range(len(got))) and all(a.ref_end < b.ref_start and a.query_end < b.query_start for a, b in zip(got, got[1:]))
    frags = commands.chromosome_alignment(whole, r, q)
    assert assembly.check_rows(frags, r, q).count() == 0
    (block,) = assembly.blocks(frags).collect()
    assert block.ref_row.replace("-", "") == ref and block.query_row.replace("-", "") == query
    mine = commands.quota_anchors(d, r, q, Chaining(least=1.0), side=100)
    assert sum(x.gene.startswith("localAlignment_c_") for x in mine.collect()) > 0
    frags = commands.block_alignment(mine, r, q)
    assert assembly.check_rows(frags, r, q).count() == 0 and frags.where("kind = 'TAIL'").count() == 0
    size = lambda c: sequences.lengths(c)
    lines = sinks.maf_lines(sinks.block_sizes(assembly.blocks(frags), size(r), size(q)), ["block", "sub"]).collect()
    assert len(lines) == 1 and lines[0].line.split("\n")[1].split("\t")[2:6] == ["        0", "      890", "+", "900"]
    assert all(x.line.count("\t") == 17 for x in sinks.trace_lines(frags).collect())
