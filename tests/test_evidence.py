"""Alignment evidence, adjacencies, ids and local mapping."""

import itertools
import random

from pyspark.sql import functions as F

from locusframe.operators import evidence, mapping, sequences


def rows(spark, a, b, strand="+"):
    n = lambda t: len(t.replace("-", ""))
    return spark.createDataFrame([(0, 0, "x", 0, n(a), "+", 100, a), (0, 1, "y", 10, n(b), strand, 100, b)], "block long, row int, source string, start0 long, size long, strand string, source_size long, text string")


def test_minus_row_counts_from_the_other_end(spark):
    got = evidence.alignment_columns(rows(spark, "ACGTA", "ACGTA", "-")).where("row = 1").orderBy("col").collect()
    assert [r.pos0 for r in got] == [89, 88, 87, 86, 85] and [r.base for r in got] == list("TGCAT")


def test_terminal_gap_is_missing(spark):
    gaps = lambda b: evidence.absences(evidence.alignment_columns(rows(spark, "ACGT", b))).count()
    assert gaps("--GT") == 0 and gaps("A--T") == 2 and gaps("AC--") == 0
    assert evidence.homologies(evidence.alignment_columns(rows(spark, "AC-T", "A-GA"))).orderBy("col").select("left_pos0", "right_pos0", "same").collect() == [(0, 10, True), (2, 12, False)]


def test_swap(spark):
    got = evidence.swap_rows(rows(spark, "ACG-", "AC-T", "-"), 1).orderBy("row").collect()
    assert [(r.source, r.strand, r.text) for r in got] == [("y", "+", "A-GT"), ("x", "-", "-CGT")]


def test_stable_id(spark):
    d = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", "")], "x string, y string")
    got = [r.i for r in d.select(evidence.stable_id("s", F.col("x"), F.col("y")).alias("i")).collect()]
    h = 0xCBF29CE484222325
    for c in b"locusframe-v1|1:a|1:b":
        h = (h ^ c) * 0x100000001B3 % 2**64
    assert got[0] == got[1] == f"s_{h:016x}" and got[2] != got[0]


def test_cigar_segments_are_best_runs(spark):
    rng = random.Random(1)
    cigars = ["".join(f"{rng.randint(1, 90)}{rng.choice('=XDI')}" for _ in range(rng.randint(1, 7))) for _ in range(30)]
    got = evidence.cigar_segments(spark.createDataFrame(list(enumerate(cigars)), "id long, cigar string")).collect()
    import re

    for i, c in enumerate(cigars):
        v = [int(n) * (37 if o == "=" else -1) for n, o in re.findall(r"(\d+)(.)", c)]
        best = max(sum(v[a:b]) for a, b in itertools.combinations(range(len(v) + 1), 2))
        mine = [r.score for r in got if r.id == i]
        assert max(mine, default=0) == max(best, 0)


def test_local_map_finds_the_place(spark):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(600))
    piece = list(ref[200:420])
    piece[100] = "A" if piece[100] != "A" else "C"
    query = "".join(rng.choice("ACGT") for _ in range(50)) + "".join(piece)
    d = spark.createDataFrame([(1, ref, query), (2, ref, "N" * 80), (3, None, query)], "id long, ref string, query string")
    (r,) = mapping.local_map(d).collect()
    assert r.id == 1 and r.ref_start - r.query_start == 150 and 195 < r.ref_start < 230 and 390 < r.ref_end <= 420


def test_stable_ids_are_fnv1a():
    rng = random.Random(1)
    items = [bytes(rng.choices(range(256), k=rng.randint(0, 40))) for _ in range(300)] + [b"", b"a", b"foobar"]

    def slow(x):
        h = 0xCBF29CE484222325
        for b in x:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    assert evidence.fnv1a(items) == list(map(slow, items)) and evidence.fnv1a([b"foobar"]) == [0x85944171F73967E8] and evidence.fnv1a([]) == []


def test_novel_anchors_fill_gaps_of_both_strands(spark):
    from locusframe.functions.exprs import reverse_complement
    from locusframe.plans import commands

    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    ref = base(1200)
    query = ref[:150] + base(60) + ref[200:420] + base(80) + ref[520:800] + base(40) + ref[900:]
    seqs = spark.createDataFrame([("c", ref, query)], "name string, r string, q string")
    whole = lambda c: sequences.chunked(seqs.select("name", F.col(c).alias("seq")))
    chain = spark.createDataFrame([("c", "c", 1, 100, 1, 100, "+", 1.0, "a", 1, 0), ("c", "c", 1101, 1200, len(query) - 99, len(query), "+", 1.0, "b", 2, 0)], commands.chains.MATCH + ", block long")
    got = commands.novel_anchors(chain, whole("r"), whole("q"), side=40).orderBy("ref_start").collect()
    new = [r for r in got if r.gene.startswith("local")]
    assert len(got) > 2 and new and all(100 < r.ref_start < r.ref_end < 1101 and r.query_start > 100 for r in new)
    turned = sequences.chunked(seqs.select("name", reverse_complement(F.col("q")).alias("seq")))
    n = len(query)
    flipped = chain.selectExpr("ref_chr", "query_chr", "ref_start", "ref_end", f"{n} + 1 - query_end AS query_start", f"{n} + 1 - query_start AS query_end", "'-' AS strand", "score", "gene", "line_no", "block")
    back = commands.novel_anchors(flipped, whole("r"), turned, side=40).orderBy("ref_start").collect()
    assert [(r.ref_start, r.ref_end, n + 1 - r.query_end, n + 1 - r.query_start) for r in back] == [(r.ref_start, r.ref_end, r.query_start, r.query_end) for r in got]


def test_copy_relations(spark, tmp_path):
    import pytest

    from locusframe.sources import text as sources

    def read(*rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.tsv"
        lines = ["#v1", "\t".join(sources.COPY_COLUMNS)] + ["\t".join({**dict.fromkeys(sources.COPY_COLUMNS, "."), **r}.values()) for r in rows]
        path.write_text("\n".join(lines) + "\n")
        return sources.read_copy_relations(spark, str(path), "#v1")

    group = {"record_type": "GROUP", "family_id": "f", "ancestral_copy_id": "a"}
    member = {"record_type": "MEMBER", "family_id": "f", "ancestral_copy_id": "a", "taxon_id": "t", "member_type": "anchor", "member_id": "m", "relation": "ortholog", "constraint": "hard", "confidence": "0.5"}
    assert read(group, member).where("confidence = 0.5").count() == 1
    for bad in ((group, group), (member | {"confidence": "2"},), ({"record_type": "X"},), (member, member | {"ancestral_copy_id": "b"}), ({"record_type": "COUNT"},)):
        with pytest.raises(ValueError):
            read(*bad)


def test_blocks_are_placed_wherever_all_sites_follow(spark):
    rng = random.Random(4)
    paths = {f"p{k}": [rng.randrange(3) for _ in range(30)] for k in range(4)}
    blocks = {f"b{k}": [rng.randrange(3) for _ in range(1 + k % 4)] for k in range(12)}
    want = set()
    for b, sites in blocks.items():
        for p, line in paths.items():
            for at in range(len(line) - len(sites) + 1):
                part = line[at : at + len(sites)]
                ways = [o for o, s in (("+", sites), ("-", sites[::-1])) if part == s]
                if ways:
                    want.add((b, p, at, len(sites), "?" if len(ways) == 2 else ways[0]))
    bs = spark.createDataFrame([(b, k, s) for b, v in blocks.items() for k, s in enumerate(v)], "block_id string, idx int, site_id long")
    ps = spark.createDataFrame([(p, 10 * k, s) for p, v in paths.items() for k, s in enumerate(v)], "path string, pos long, site_id long")
    got = [tuple(r) for r in evidence.place_blocks(bs, ps).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert evidence.place_blocks(bs.limit(0), ps).count() == 0
