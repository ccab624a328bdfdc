"""All queries over the reference's operators, with their SQL.

Names begin with the survey's ids. Each query applies an operator of this package to a
genomic view of the driver's tables (see :mod:`locusframe.plans.views`) or to a table itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions import exprs
from locusframe.operators import adjacency, affine, ancestry, anchors, chains, copies, evidence, graph, mapping, profiles, quota, repair, sequences
from locusframe.operators.components import components
from locusframe.operators.orders import ranked
from locusframe.plans import commands
from locusframe.plans.runtime import shared_folder, table
from locusframe.plans.views import duck, view
from locusframe.sinks import text as sinks
from locusframe.sources import newick
from locusframe.sources import text as sources

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = duck(sql)
        return f

    return keep


def on(name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """Register ``build`` over one view or table."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(view(spark, sf_dir, source) if source.startswith("v_") else table(spark, sf_dir, source))

    f.__name__ = name
    query(sql)(f)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v2_inter_anchor_gap(spark, sf_dir)


# ---------------------------------------------------------------- scalar functions

_METHODS = "WAVEFRONT_SINGLETRACK WAVEFRONT WAVEFRONT_MEDIUM KSW2_SINGLETRACK MINIMAP2 BANDED_MINIMAP2 SLIDING_WINDOW FILLING".split()
_LABELLED = "CASE WHEN m LIKE 'WAVEFRONT%' THEN 'WAVEFRONT' WHEN m IN ('KSW2_SINGLETRACK', 'MINIMAP2') THEN 'KSW2' WHEN m = 'BANDED_MINIMAP2' THEN 'BANDED_KSW2' ELSE m END"

on("f1_normalise_bases", "benchmark", lambda d: d.select("item_id", exprs.normalise_bases(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")),
   "SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'RYSWKMBDHVU', 'NNNNNNNNNNT') AS seq FROM benchmark")
on("f2_reverse_complement", "v_seq", lambda d: d.select("seq_id", exprs.reverse_complement(F.col("seq")).alias("rc")),
   "SELECT seq_id, translate(reverse(seq), 'ATUCGRYKMBVDH', 'TAAGCYRMKVBHD') AS rc FROM v_seq")
on("f3_complement", "v_seq", lambda d: d.select("seq_id", exprs.complement(F.lower("seq")).alias("c")),
   "SELECT seq_id, translate(upper(seq), 'ATUCGRYKMBVDH', 'TAAGCYRMKVBHD') AS c FROM v_seq")
on("s3_interval_fetch", "v_seq", lambda d: d.select("seq_id", exprs.subsequence(F.col("seq"), F.col("seq_id") + 40, F.col("seq_id") * 3 - 7).alias("part")),
   """SELECT seq_id, substr(seq, a, b - a + 1) AS part FROM (SELECT *, CAST(least(greatest(least(seq_id + 40, seq_id * 3 - 7), 1), greatest(length(seq), 1)) AS INT) AS a,
 CAST(least(greatest(greatest(seq_id + 40, seq_id * 3 - 7), 1), greatest(length(seq), 1)) AS INT) AS b FROM v_seq)""")
on("f4_cigar_summary", "v_sam", lambda d: d.select("line_no", exprs.cigar_summary(F.col("cigar")).alias("c")).select("line_no", "c.*"),
   """WITH o AS (SELECT line_no, cigar, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS p FROM v_sam)
SELECT line_no, CASE WHEN p[1][-1:] IN ('S', 'H') THEN CAST(p[1][:-2] AS BIGINT) ELSE 0 END AS head,
 CASE WHEN p[-1][-1:] IN ('S', 'H') AND len(p) > 1 THEN CAST(p[-1][:-2] AS BIGINT) ELSE 0 END AS tail,
 CAST(list_sum([CASE WHEN x[-1:] IN ('M', '=', 'X') THEN CAST(x[:-2] AS BIGINT) ELSE 0 END for x in p]) AS BIGINT) AS aligned,
 CAST(list_sum([CASE WHEN x[-1:] IN ('M', '=', 'X', 'D', 'N') THEN CAST(x[:-2] AS BIGINT) ELSE 0 END for x in p]) AS BIGINT) AS span FROM o""")
on("f5_reverse_flag", "v_sam", lambda d: d.groupBy(exprs.is_reverse(F.col("flag")).alias("reverse")).agg(F.count(F.lit(1)).alias("n")),
   "SELECT flag % 32 <> 0 AS reverse, count(*) AS n FROM v_sam GROUP BY 1")
on("f6_iupac_mask", "v_site", lambda d: d.select("site_id", exprs.mask_of(F.col("a")).cast("int").alias("mask"), exprs.letter_of(exprs.mask_of(F.col("a"))).alias("letter")),
   "SELECT site_id, CAST(greatest(strpos('-ACMGRSVTWYHKDBN', upper(a)) - 1, 0) AS INT) AS mask, upper(a) AS letter FROM v_site")
on("f8_forward_start", "v_match", lambda d: d.select("line_no", exprs.forward_start(F.col("ref_start"), F.col("ref_end") - F.col("ref_start"), F.col("strand"), F.lit(1 << 40)).alias("start0")),
   "SELECT line_no, CASE WHEN strand = '-' THEN 1099511627776 - ref_start - (ref_end - ref_start) ELSE ref_start END AS start0 FROM v_match")
on("f12_pair_id", "v_match", lambda d: d.select(exprs.pair_id(F.col("ref_chr"), F.col("query_chr")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")),
   "SELECT least(ref_chr, query_chr) || '--' || greatest(ref_chr, query_chr) AS pair, count(*) AS n FROM v_match GROUP BY 1")
on("f13_saturating_multiply", "v_match", lambda d: d.select("line_no", exprs.saturating_multiply(F.col("ref_end"), F.col("query_end") * 1_000_000_000_000).alias("area")),
   "SELECT line_no, CAST(least(CAST(ref_end AS HUGEINT) * query_end * 1000000000000, 9223372036854775807) AS BIGINT) AS area FROM v_match")
on("f14_close", "v_match", lambda d: d.groupBy(exprs.close(F.col("score"), F.lit(0.9) + F.lit(1e-14)).alias("near")).agg(F.count(F.lit(1)).alias("n")),
   "SELECT abs(score - (0.9 + 1e-14::DOUBLE)) <= 1e-12 * greatest(1.0, abs(score), 0.9) AS near, count(*) AS n FROM v_match GROUP BY 1")
on("f15_tsv_clean", "benchmark", lambda d: d.select("item_id", exprs.tsv_clean(F.col("text")).alias("line")),
   "SELECT item_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS line FROM benchmark")
on("f16_split_items", "benchmark", lambda d: d.select("item_id", F.size(exprs.split_items(F.col("text"), ".")).cast("long").alias("n")),
   "SELECT item_id, CAST(len(list_filter(string_split(text, '.'), lambda x: x <> '')) AS BIGINT) AS n FROM benchmark")
on("f17_interval_check", "v_block", lambda d: d.select("projection_id", exprs.interval_fits(F.col("start0"), F.col("end0"), F.lit(1000)).alias("fits")),
   "SELECT projection_id, start0 >= 0 AND end0 > start0 AND end0 <= 1000 AS fits FROM v_block")
on("f13_saturating_add", "v_match", lambda d: d.select("line_no", exprs.saturating_add(F.col("ref_end"), F.lit(9223372036854775807) - F.col("line_no")).alias("total")),
   "SELECT line_no, CAST(least(CAST(ref_end AS HUGEINT) + (9223372036854775807 - line_no), 9223372036854775807) AS BIGINT) AS total FROM v_match")
on("f15_strict_numbers", "benchmark", lambda d: d.select("item_id", F.explode(F.split(F.concat("text", F.lit(" 12 +7 -3.5 .5 1e3 1e999 x1 0x1 9999999999999999999 "), F.col("item_id").cast("string")), " ")).alias("token")).groupBy("item_id").agg(
    F.sum(exprs.strict_integer(F.col("token"))).alias("integers"), F.count(exprs.strict_double(F.col("token"))).alias("doubles")),
   r"""WITH t AS (SELECT item_id, trim(unnest(string_split(text || ' 12 +7 -3.5 .5 1e3 1e999 x1 0x1 9999999999999999999 ' || CAST(item_id AS VARCHAR), ' '))) AS token FROM benchmark)
SELECT item_id, CAST(sum(CASE WHEN regexp_full_match(token, '[+-]?[0-9]+') THEN TRY_CAST(token AS BIGINT) END) AS BIGINT) AS integers,
 count(CASE WHEN regexp_full_match(token, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND abs(TRY_CAST(token AS DOUBLE)) < 'inf'::DOUBLE THEN 1 END) AS doubles FROM t GROUP BY 1""")
on("f11_method_labels", "v_match", lambda d: d.select("line_no", exprs.method_label(F.element_at(F.array(*map(F.lit, _METHODS)), (F.col("line_no") % len(_METHODS) + 1).cast("int"))).alias("label")),
   f"SELECT line_no, {_LABELLED} AS label FROM (SELECT line_no, [{', '.join(repr(m) for m in _METHODS)}][CAST(line_no % {len(_METHODS)} + 1 AS INT)] AS m FROM v_match)")
on("s6_attribute", "v_feature", lambda d: d.select("line_no", exprs.attribute(F.concat(F.lit("ID=x;Parent="), "transcript", F.lit(";gene_id \""), "gene", F.lit('"')), "gene_id").alias("gene")),
   "SELECT line_no, gene FROM v_feature")
on("l4_gap_cost", "v_match", lambda d: d.select("line_no", exprs.gap_cost((F.col("ref_end") - F.col("ref_start")) * 3).cast("double").alias("cost")),
   "SELECT line_no, CAST(greatest(-8 - 2 * (ref_end - ref_start) * 3, -75 - (ref_end - ref_start) * 3) AS DOUBLE) AS cost FROM v_match")


def _pairs_to_fill(d: DataFrame, all_n: bool) -> DataFrame:
    return d.select(F.col("seq_id").alias("id"), (F.repeat(F.lit("N"), (F.col("seq_id") % 50).cast("int")) if all_n else F.lit("")).alias("a"), F.col("seq").alias("b"))


on("l11_all_n", "v_seq", lambda d: affine.align_pairs(_pairs_to_fill(d, True).where("a <> ''")),
   "SELECT seq_id AS id, rpad(repeat('N', seq_id % 50), CAST(greatest(seq_id % 50, length(seq)) AS INT), '-') AS row_a, rpad(seq, CAST(greatest(seq_id % 50, length(seq)) AS INT), '-') AS row_b, 0.0::DOUBLE AS score, 'FILLING' AS method FROM v_seq WHERE seq_id % 50 > 0")
on("l12_one_sided_fill", "v_seq", lambda d: affine.align_pairs(_pairs_to_fill(d, False)),
   "SELECT seq_id AS id, repeat('-', length(seq)) AS row_a, seq AS row_b, CAST(greatest(-8 - 2 * length(seq), -75 - length(seq)) AS DOUBLE) AS score, 'FILLING' AS method FROM v_seq")

# ---------------------------------------------------------------- filters

on("p1_chromosome_intersection", "v_sam", lambda d: anchors.common_names(d.select("rname"), d.where("pos1 % 3 = 0").select("rname"), d.where("rname <> 'c3'").select("rname")), "SELECT rname FROM v_sam INTERSECT SELECT rname FROM v_sam WHERE pos1 % 3 = 0 INTERSECT SELECT rname FROM v_sam WHERE rname <> 'c3'")
on("p2_min_feature_length", "v_feature", lambda d: anchors.long_enough(d, 20).groupBy("transcript").agg(F.count(F.lit(1)).alias("n")),
   "SELECT transcript, count(*) AS n FROM v_feature WHERE end1 - start1 + 1 >= 20 GROUP BY 1")
on("p4_similarity_filter", "v_match", lambda d: anchors.similar(d, 0.95).select("line_no", "score"), "SELECT line_no, score FROM v_match WHERE score > 0.95")
on("p5_same_chromosome", "v_anchor", lambda d: anchors.same_chromosome(d, False).select("line_no"), "SELECT line_no FROM v_anchor WHERE ref_chr = query_chr AND strand = '+'")
on("p6_chromosome_admission", "v_match", lambda d: anchors.admitted(d, 4000).groupBy("ref_chr", "query_chr").agg(F.count(F.lit(1)).alias("n")),
   "SELECT ref_chr, query_chr, count(*) AS n FROM v_match GROUP BY ALL HAVING count(*) >= 4000")


def _tandem(d: DataFrame) -> DataFrame:
    names = {"ref_chr": F.substring("ref_chr", 2, 9), "query_chr": F.substring("query_chr", 2, 9), "ref_gene": F.col("ref_id").cast("string"), "query_gene": F.col("query_id").cast("string")}
    return anchors.tandem_filter(d.withColumns(names), 5).select("line_no")


on("p7_tandem_filter", "v_ranked", _tandem,
   """WITH f AS (SELECT min(line_no) AS first_self FROM v_ranked WHERE ref_id = query_id)
SELECT line_no FROM v_ranked, f WHERE NOT (coalesce(line_no >= first_self, false) AND substr(ref_chr, 2) = substr(query_chr, 2) AND abs(ref_id - query_id) - 1 <= 5)""")


# ---------------------------------------------------------------- windows

_IDS = """SELECT *, row_number() OVER (PARTITION BY ref_chr ORDER BY ref_start, ref_end, query_start, query_end, line_no) - 1 AS ref_id,
 row_number() OVER (PARTITION BY query_chr ORDER BY query_start, query_end, ref_start, ref_end, line_no) - 1 AS query_id FROM v_match"""
on("v1_row_ids", "v_match", lambda d: anchors.row_ids(d).select("line_no", F.col("ref_id").cast("long").alias("ref_id"), F.col("query_id").cast("long").alias("query_id")), f"SELECT line_no, ref_id, query_id FROM ({_IDS})")

_GAPS = """WITH p AS (SELECT ref_chr, query_chr, line_no, strand, ref_start, ref_end, query_start, query_end, lag(strand) OVER w AS ps, lag(ref_end) OVER w AS pr, lag(query_end) OVER w AS pqe, lag(query_start) OVER w AS pqs
 FROM v_match WINDOW w AS (PARTITION BY ref_chr, query_chr ORDER BY ref_start, line_no, query_start, ref_end)),
g AS (SELECT ref_chr, query_chr, strand, pr + 1 AS gap_ref_start, ref_start - 1 AS gap_ref_end, CASE WHEN strand = '+' THEN pqe + 1 ELSE query_end + 1 END AS gap_query_start,
 CASE WHEN strand = '+' THEN query_start - 1 ELSE pqs - 1 END AS gap_query_end FROM p WHERE ps = strand),
a AS (SELECT *, (gap_ref_end - gap_ref_start + 1) * (gap_query_end - gap_query_start + 1) AS area FROM g WHERE gap_ref_end - gap_ref_start + 1 >= 0 AND gap_query_end - gap_query_start + 1 >= 0)"""


def _gaps(d: DataFrame) -> DataFrame:
    return anchors.inter_anchor_gaps(d, ["ref_chr", "query_chr"], ["ref_start", "line_no", "query_start", "ref_end"])


@query(_GAPS + " SELECT * FROM a")
def v2_inter_anchor_gap(spark, sf_dir):
    return _gaps(view(spark, sf_dir, "v_match"))


on("p8_novel_anchor_admission", "v_match", lambda d: anchors.novel_anchor_gaps(_gaps(d), 2000).groupBy("ref_chr", "query_chr").agg(F.count(F.lit(1)).alias("n")),
   _GAPS + " SELECT ref_chr, query_chr, count(*) AS n FROM a WHERE area > 4000000 GROUP BY ALL")
on("p9_gap_cost_class", "v_match", lambda d: anchors.own_task(_gaps(d)).groupBy("own_task").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")),
   _GAPS + " SELECT area >= 100000000 AS own_task, count(*) AS n, CAST(sum(area) AS BIGINT) AS area FROM a WHERE area > 0 GROUP BY 1")
on("a7_total_area", "v_match", lambda d: _gaps(d).groupBy("strand").agg(F.sum("area").alias("area")), _GAPS + " SELECT strand, CAST(sum(area) AS BIGINT) AS area FROM a GROUP BY 1")
on("o11_cost_order", "v_match", lambda d: ranked(_gaps(d).select("ref_chr", "query_chr", "gap_ref_start", "gap_query_start", "area"), [F.desc("area"), "ref_chr", "query_chr", "gap_ref_start", "gap_query_start"]),
   _GAPS + " SELECT ref_chr, query_chr, gap_ref_start, gap_query_start, area, row_number() OVER (ORDER BY area DESC, ref_chr, query_chr, gap_ref_start, gap_query_start) - 1 AS rank FROM a")
on("v3_suspicious_repeat", "v_copies", anchors.suspicious_repeats,
   """WITH p AS (SELECT gene, query_chr, query_start, query_end, p_start, p_end, lag(query_chr) OVER w AS pc, lag(query_end) OVER w AS pe FROM v_copies WINDOW w AS (PARTITION BY gene ORDER BY line_no))
SELECT DISTINCT gene FROM p WHERE pc = query_chr AND least(abs(pe - query_end), abs(pe - query_start)) < abs(p_start - p_end)""")


def _collapsed(fixed: str, moving: str, source: str) -> str:
    return f"""SELECT * EXCLUDE (bin, k, nb) FROM (SELECT *, row_number() OVER (PARTITION BY ref_chr, query_chr, {fixed}_id, bin ORDER BY score DESC, {moving}_id, line_no) AS k FROM (
 SELECT *, sum(nb) OVER (PARTITION BY ref_chr, query_chr, {fixed}_id ORDER BY {moving}_id, line_no) AS bin FROM (
 SELECT *, CASE WHEN {moving}_id - lag({moving}_id) OVER (PARTITION BY ref_chr, query_chr, {fixed}_id ORDER BY {moving}_id, line_no) <= 500 THEN 0 ELSE 1 END AS nb FROM ({source})))) WHERE k = 1"""


on("v4_collapse_near_pairs", "v_ranked", lambda d: anchors.collapse_near_pairs(d, 500).select("line_no", "score"),
   f"SELECT line_no, score FROM ({_collapsed('ref', 'query', _collapsed('query', 'ref', 'SELECT line_no, ref_chr, query_chr, score, ref_id, query_id FROM v_ranked'))})")
on("v5_path_segments", "v_graph", ancestry.path_segments,
   "SELECT path, min(pos0) AS first, max(pos0) AS last, count(*) AS n FROM (SELECT path, pos0, pos0 - row_number() OVER (PARTITION BY path ORDER BY pos0) AS run FROM (SELECT DISTINCT path, pos0 FROM v_graph)) GROUP BY path, run")


def _lines(d: DataFrame) -> DataFrame:
    """Sites in the order of their numbers, as the sites of blocks of 500."""
    return d.select(F.floor(F.col("site_id") / 500).alias("block"), F.col("site_id")).distinct().withColumn("idx", F.col("site_id") % 500)


on("v6_coverage_runs", "v_graph", lambda d: ancestry.coverage_runs(_lines(d), d.select("site_id", "path")).select("site_id", "run"),
   """WITH s AS (SELECT site_id, site_id // 500 AS block, site_id % 500 AS idx, string_agg(DISTINCT path, ',' ORDER BY path) AS shape FROM v_graph GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 AND lag(shape) OVER w = shape THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY block ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY idx) AS k FROM m)
SELECT site_id, CAST(min(idx) OVER (PARTITION BY block, k) AS BIGINT) AS run FROM r""")


def _emitted(d: DataFrame) -> DataFrame:
    sites = d.select("site_id").distinct()
    return ancestry.blocks(sites.select("site_id", F.lit("A").alias("base"), (F.col("site_id") % 7 != 0).alias("emitted")), sites.select("site_id", F.floor(F.col("site_id") / 500).alias("comp"), F.when(F.col("site_id") % 500 < 400, F.col("site_id") % 500).alias("place"))).select("block", "idx", "site_id")


on("v7_emitted_blocks", "v_graph", _emitted,
   """WITH s AS (SELECT DISTINCT site_id, site_id // 500 AS comp, site_id % 500 AS place FROM v_graph WHERE site_id % 7 <> 0),
r AS (SELECT *, place - row_number() OVER (PARTITION BY comp ORDER BY place) AS run FROM s WHERE place < 400), f AS (SELECT *, min(place) OVER (PARTITION BY comp, run) AS first FROM r)
SELECT CAST(comp AS VARCHAR) || ':' || CAST(first AS VARCHAR) AS block, place - first AS idx, site_id FROM f UNION ALL SELECT 'site:' || CAST(site_id AS VARCHAR), 0, site_id FROM s WHERE place >= 400""")

_FIT = """WITH d AS (SELECT taxon, block_id FROM v_projection GROUP BY ALL HAVING count(*) > 1),
ov AS (SELECT a.taxon, a.path, a.projection_id AS left_id, b.projection_id AS right_id FROM v_projection a JOIN v_projection b ON a.taxon = b.taxon AND a.path = b.path AND (a.start0, a.projection_id) < (b.start0, b.projection_id) AND b.start0 < a.end0),
fit AS (SELECT p.*, p.orientation <> '?' AND NOT EXISTS (SELECT 1 FROM d WHERE d.taxon = p.taxon AND d.block_id = p.block_id) AND NOT EXISTS (SELECT 1 FROM ov WHERE ov.left_id = p.projection_id OR ov.right_id = p.projection_id) AS fit FROM v_projection p),
nb AS (SELECT *, lead(block_id) OVER w AS nblock, lead(orientation) OVER w AS norient, lead(fit) OVER w AS nfit, lead(projection_id) OVER w AS nid FROM fit WINDOW w AS (PARTITION BY taxon, path ORDER BY start0, end0, block_id, projection_id)),
en AS (SELECT taxon, block_id || ':' || CASE WHEN orientation = '+' THEN 'T' ELSE 'H' END AS e1, nblock || ':' || CASE WHEN norient = '+' THEN 'H' ELSE 'T' END AS e2 FROM nb WHERE fit AND nfit AND block_id <> nblock),
ob AS (SELECT DISTINCT taxon, CASE WHEN (string_split(e1, ':')[1], e1) < (string_split(e2, ':')[1], e2) THEN e1 ELSE e2 END AS x, CASE WHEN (string_split(e1, ':')[1], e1) < (string_split(e2, ':')[1], e2) THEN e2 ELSE e1 END AS y FROM en)"""
on("a18_duplicate_copy", "v_projection", adjacency.duplicate_copies, "SELECT taxon, block_id, count(*) AS n FROM v_projection GROUP BY ALL HAVING count(*) > 1")
on("v9_overlapping_on_path", "v_projection", adjacency.overlapping, _FIT + " SELECT * FROM ov")
on("v8_oriented_adjacency", "v_projection", lambda d: adjacency.observed(adjacency.usable(d)).select("taxon", F.concat_ws(":", "block1", "end1").alias("x"), F.concat_ws(":", "block2", "end2").alias("y")), _FIT + " SELECT taxon, x, y FROM ob")
on("a20_issues", "v_projection", lambda d: adjacency.issues(d).select("kind", "taxon", "path", F.array_join("blocks", ",").alias("blocks"), F.array_join("projections", ",").alias("projections")),
   _FIT + """ SELECT 'DUPLICATE_BLOCK_COPY' AS kind, p.taxon, '' AS path, p.block_id AS blocks, string_agg(projection_id, ',' ORDER BY projection_id) AS projections FROM v_projection p JOIN d ON p.taxon = d.taxon AND p.block_id = d.block_id GROUP BY ALL
UNION ALL SELECT 'UNKNOWN_ORIENTATION', taxon, path, block_id, projection_id FROM v_projection WHERE orientation = '?'
UNION ALL SELECT 'OVERLAPPING_PROJECTIONS', ov.taxon, ov.path, a.block_id || ',' || b.block_id, left_id || ',' || right_id FROM ov JOIN v_projection a ON a.projection_id = left_id JOIN v_projection b ON b.projection_id = right_id
UNION ALL SELECT 'SELF_ADJACENCY', taxon, path, block_id, projection_id || ',' || nid FROM nb WHERE fit AND nfit AND block_id = nblock""")
_LEAVES = _FIT + """, ev AS (SELECT DISTINCT x, y FROM ob), lf AS (SELECT unnest(['x0', 'x1', 'x2']) AS taxon),
st AS (SELECT ev.x, ev.y, lf.taxon, CASE WHEN NOT EXISTS (SELECT 1 FROM fit f WHERE f.fit AND f.taxon = lf.taxon AND f.block_id = string_split(ev.x, ':')[1]) OR NOT EXISTS (SELECT 1 FROM fit f WHERE f.fit AND f.taxon = lf.taxon AND f.block_id = string_split(ev.y, ':')[1]) THEN 'MISSING'
 WHEN EXISTS (SELECT 1 FROM ob WHERE ob.taxon = lf.taxon AND ob.x = ev.x AND ob.y = ev.y) THEN 'PRESENT' ELSE 'ABSENT' END AS state FROM ev, lf)"""
on("j15_adjacency_leaf_states", "v_projection", lambda d: adjacency.leaf_states(d, ["x0", "x1", "x2"]).select(F.concat_ws(":", "block1", "end1").alias("x"), F.concat_ws(":", "block2", "end2").alias("y"), "taxon", "state"), _LEAVES + " SELECT * FROM st")
_INFER = _LEAVES + """, c AS (SELECT x, y, sum(CASE WHEN state = 'PRESENT' THEN 1 ELSE 0 END) AS zero, sum(CASE WHEN state = 'ABSENT' THEN 1 ELSE 0 END) AS one FROM st GROUP BY ALL),
pr AS (SELECT x, y, CASE WHEN zero = one THEN 'AMBIGUOUS' WHEN one < zero THEN 'PRESENT' ELSE 'ABSENT' END AS presence FROM c),
ori AS (SELECT string_split(x, ':')[1] AS bx, string_split(y, ':')[1] AS by_, count(*) AS n FROM pr GROUP BY ALL), act AS (SELECT e, count(*) AS n FROM (SELECT x AS e FROM pr WHERE presence <> 'ABSENT' UNION ALL SELECT y FROM pr WHERE presence <> 'ABSENT') GROUP BY 1 HAVING count(*) > 1),
fl AS (SELECT pr.*, (SELECT n FROM ori WHERE bx = string_split(x, ':')[1] AND by_ = string_split(y, ':')[1]) > 1 AS turned, presence <> 'ABSENT' AND (EXISTS (SELECT 1 FROM act WHERE e = x) OR EXISTS (SELECT 1 FROM act WHERE e = y)) AS clash FROM pr)"""
on("a17_conflict_flags", "v_projection", lambda d: adjacency.infer(d, newick.parse("((x0,x1)anc,x2)root;"), "anc").select("adjacency", "orientation_conflict", "endpoint_conflict"),
   _INFER + " SELECT x || '--' || y AS adjacency, turned AS orientation_conflict, clash AS endpoint_conflict FROM fl")
on("g17_adjacency_calls", "v_projection", lambda d: adjacency.infer(d, newick.parse("((x0,x1)anc,x2)root;"), "anc").select("adjacency", "presence", "decision"),
   _INFER + """ SELECT x || '--' || y AS adjacency, presence, CASE WHEN presence = 'AMBIGUOUS' AND clash THEN 'PRESENCE_AMBIGUOUS_ENDPOINT_CONFLICT' WHEN presence = 'AMBIGUOUS' THEN 'PRESENCE_AMBIGUOUS' WHEN presence = 'ABSENT' THEN 'ANCESTRAL_ADJACENCY_ABSENT'
 WHEN clash THEN 'SUPPORTED_ENDPOINT_CONFLICT' WHEN turned THEN 'SUPPORTED_ORIENTATION_CONFLICT' ELSE 'SUPPORTED_CANDIDATE_ADJACENCY' END AS decision FROM fl""")
on("v9_overlapping_projections", "v_block", lambda d: anchors.overlap_join(
    d.select("taxon", "path", F.col("start0").alias("s1"), (F.col("end0") - 1).alias("e1"), F.col("block_id").alias("b1")), d.select("taxon", "path", (F.col("start0") - 60).alias("s2"), (F.col("end0") - 1).alias("e2"), F.col("block_id").alias("b2")), ["taxon", "path"], "s1", "e1", "s2", "e2", 256).where("b1 < b2").select("taxon", "path", "b1", "b2", "s1", "s2"),
   "SELECT a.taxon, a.path, a.block_id AS b1, b.block_id AS b2, a.start0 AS s1, b.start0 - 60 AS s2 FROM v_block a JOIN v_block b ON a.taxon = b.taxon AND a.path = b.path AND a.block_id < b.block_id AND a.start0 <= b.end0 - 1 AND b.start0 - 60 <= a.end0 - 1")
on("v11_graph_edges", "v_residue", lambda d: anchors.next_on_path(d, ["taxon", "path"], ["pos0"], "site_id").groupBy("site_id", "next").agg(F.count(F.lit(1)).alias("n")),
   "SELECT site_id, next, count(*) AS n FROM (SELECT site_id, lead(site_id) OVER (PARTITION BY taxon, path ORDER BY pos0) AS next FROM v_residue) WHERE next IS NOT NULL GROUP BY ALL")

# ---------------------------------------------------------------- joins

on("j3_gene_blacklist", "v_copies", lambda d: anchors.without_genes(d, anchors.copy_blacklist(d)).select("line_no"),
   """WITH t AS (SELECT gene, query_chr, score, row_number() OVER (PARTITION BY gene, query_chr ORDER BY score DESC, line_no) AS k FROM v_copies),
b AS (SELECT DISTINCT gene FROM (SELECT gene, query_chr, count(*) AS n, min(score) AS lo, max(score) AS hi FROM t WHERE k <= 2 GROUP BY ALL) WHERE n > 1 AND lo / hi > 0.9)
SELECT line_no FROM v_copies WHERE gene NOT IN (SELECT gene FROM b)""")


@query("SELECT s.line_no, t.transcript, t.n_exons FROM v_sam s JOIN (SELECT transcript, count(*) AS n_exons FROM v_feature GROUP BY 1) t ON s.qname = t.transcript")
def j1_hit_transcript(spark, sf_dir):
    tx = anchors.transcripts(view(spark, sf_dir, "v_feature")).select("transcript", "n_exons")
    return view(spark, sf_dir, "v_sam").join(tx, F.col("qname") == F.col("transcript")).select("line_no", "transcript", "n_exons")


@query("SELECT g.gene, count(DISTINCT f.transcript) AS n FROM v_feature f JOIN (SELECT DISTINCT transcript, gene FROM v_feature) g USING (transcript) GROUP BY 1")
def j2_transcript_gene(spark, sf_dir):
    f = view(spark, sf_dir, "v_feature")
    return f.select("transcript").join(f.select("transcript", "gene").distinct(), "transcript").groupBy("gene").agg(F.countDistinct("transcript").alias("n"))


_SEGMENTS = """s AS (SELECT transcript, seqid, strand, start1, end1, CAST(sum(end1 - start1 + 1) OVER (PARTITION BY transcript ORDER BY CASE WHEN strand = '-' THEN -start1 ELSE start1 END, CASE WHEN strand = '-' THEN -end1 ELSE end1 END, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, end1 - start1 + 1 AS n FROM v_feature)"""


@query(f"""WITH {_SEGMENTS}, p AS (SELECT DISTINCT qname AS transcript, line_no % 400 + 1 AS off FROM v_sam)
SELECT p.transcript, p.off, s.seqid, CASE WHEN s.strand = '-' THEN s.end1 - (p.off - (s.hi - s.n + 1)) ELSE s.start1 + p.off - (s.hi - s.n + 1) END AS pos1 FROM p JOIN s ON p.transcript = s.transcript AND p.off BETWEEN s.hi - s.n + 1 AND s.hi""")
def j5_lift_over(spark, sf_dir):
    p = view(spark, sf_dir, "v_sam").select(F.col("qname").alias("transcript"), (F.col("line_no") % 400 + 1).alias("off")).distinct()
    return anchors.lift_positions(p, anchors.cds_segments(view(spark, sf_dir, "v_feature")))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = exprs.cigar_summary(F.col("cigar"))
    return view(spark, sf_dir, "v_sam").select("line_no", "qname", "flag", "rname", "pos1", exprs.is_reverse(F.col("flag")).alias("reverse"), c["head"].alias("head"), c["tail"].alias("tail"), c["aligned"].alias("aligned"), c["span"].alias("span"))


_HITS = f"""WITH {_SEGMENTS}, t AS (SELECT transcript, CAST(sum(end1 - start1 + 1) AS BIGINT) AS cds_len FROM v_feature GROUP BY 1),
h AS (SELECT line_no, qname AS transcript, flag % 32 <> 0 AS reverse, cds_len, CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS BIGINT) AS head, CASE WHEN cigar LIKE '%2H' THEN 2 ELSE 0 END AS tail FROM v_sam JOIN t ON qname = transcript),
o AS (SELECT line_no, transcript, unnest([CASE WHEN reverse THEN cds_len - head ELSE 1 + head END, CASE WHEN reverse THEN 1 + tail ELSE cds_len - tail END]) AS off FROM h),
q AS (SELECT line_no, o.transcript, seqid, CASE WHEN strand = '-' THEN end1 - (off - (hi - n + 1)) ELSE start1 + off - (hi - n + 1) END AS pos1 FROM o JOIN s ON o.transcript = s.transcript AND off BETWEEN hi - n + 1 AND hi)"""


@query(_HITS + " SELECT line_no, transcript, seqid, min(pos1) AS ref_start, max(pos1) AS ref_end FROM q GROUP BY ALL HAVING count(*) = 2")
def j5_lifted_alignments(spark, sf_dir):
    f = view(spark, sf_dir, "v_feature")
    tx = anchors.transcripts(f).select("transcript", "cds_len")
    return anchors.lifted(_hits(spark, sf_dir).withColumnRenamed("qname", "transcript").join(tx, "transcript"), anchors.cds_segments(f))


@query("SELECT line_no FROM v_sam WHERE qname IN (SELECT transcript FROM v_feature) AND rname IN (SELECT seqid FROM v_feature WHERE seqid < 'c5')")
def p3_mapped_records(spark, sf_dir):
    f = view(spark, sf_dir, "v_feature")
    return anchors.mapped(view(spark, sf_dir, "v_sam"), f, f.where("seqid < 'c5'").select(F.col("seqid").alias("name"))).select("line_no")


@query("""SELECT s.line_no, t.seqid AS ref_chr, t.p_start AS ref_start, s.rname AS query_chr, s.pos1 AS query_start, CASE WHEN (flag % 32 = 0 AND t.strand = '+') OR (flag % 32 = 16 AND t.strand = '-') THEN '+' ELSE '-' END AS strand
FROM v_sam s JOIN (SELECT transcript, arg_min(seqid, line_no) AS seqid, arg_min(strand, line_no) AS strand, min(start1) AS p_start FROM v_feature GROUP BY 1) t ON s.qname = t.transcript""")
def h1_dotplot(spark, sf_dir):
    return anchors.dotplot(view(spark, sf_dir, "v_sam"), anchors.transcripts(view(spark, sf_dir, "v_feature")))


@query()
def j1_matches_from_records(spark, sf_dir):
    f = view(spark, sf_dir, "v_feature")
    near = f.withColumn("end1", F.col("start1") % 300 + 1 + F.col("end1") - F.col("start1")).withColumn("start1", F.col("start1") % 300 + 1)
    return anchors.matches(_hits(spark, sf_dir), near, f.select("transcript", F.col("transcript").alias("gene")).distinct(), 0.01, expected=1000)


@query("""WITH b AS (SELECT ref_chr, gene, min(ref_start) AS bs, min(ref_start) + 2000 AS be FROM v_match GROUP BY ALL)
SELECT b.ref_chr, count(*) AS n, CAST(sum(m.line_no % 1000) AS BIGINT) AS "check" FROM b JOIN v_match m ON b.ref_chr = m.ref_chr AND m.ref_start <= b.be AND b.bs <= m.ref_end GROUP BY 1""")
def j6_overlap_join(spark, sf_dir):
    m = view(spark, sf_dir, "v_match")
    boxes = m.groupBy("ref_chr", "gene").agg(F.min("ref_start").alias("bs")).withColumn("be", F.col("bs") + 2000).drop("gene")
    hit = anchors.overlap_join(boxes, m.select("ref_chr", "ref_start", "ref_end", "line_no"), ["ref_chr"], "bs", "be", "ref_start", "ref_end", 4096)
    return hit.groupBy("ref_chr").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("line_no") % 1000).alias("check"))


on("j12_self_identity", "v_match", anchors.moved_genes, "SELECT DISTINCT gene FROM v_match WHERE ref_start <> query_start OR ref_end <> query_end")


@query("""WITH o AS (SELECT DISTINCT s_suppkey % 40 AS a, s_nationkey AS b FROM supplier),
have AS (SELECT DISTINCT least('t' || a, 't' || b) AS a, greatest('t' || a, 't' || b) AS b FROM o WHERE a <> b), t AS (SELECT 't' || CAST(k AS VARCHAR) AS t FROM (SELECT unnest(range(40)) AS k))
SELECT x.t AS a, y.t AS b FROM t x JOIN t y ON x.t < y.t WHERE (x.t IN ('t0', 't1') OR y.t IN ('t0', 't1')) AND NOT EXISTS (SELECT 1 FROM have WHERE have.a = x.t AND have.b = y.t)""")
def j14_required_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), (F.col("s_suppkey") % 40).cast("string")).alias("a"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("b")).where("a <> b").distinct()
    return sources.missing_pairs(rows, {f"t{k}": "ingroup" if k < 2 else "outgroup" for k in range(40)})


# ---------------------------------------------------------------- aggregates and sets

_TX = "SELECT transcript, any_value(gene) AS gene, CAST(sum(end1 - start1 + 1) AS BIGINT) AS cds_len FROM v_feature GROUP BY 1"


def _tx(d: DataFrame) -> DataFrame:
    return d.groupBy("transcript").agg(F.any_value("gene").alias("gene"), F.sum(F.col("end1") - F.col("start1") + 1).alias("cds_len"))


on("s5_transcripts", "v_feature", anchors.transcripts,
   "SELECT transcript, arg_min(seqid, line_no) AS seqid, arg_min(strand, line_no) AS strand, min(start1) AS p_start, max(end1) AS p_end, CAST(sum(end1 - start1 + 1) AS BIGINT) AS cds_len, count(*) AS n_exons FROM v_feature GROUP BY 1")
on("s7_gene_map", "v_feature", lambda d: d.groupBy("transcript").agg(F.max_by("gene", "line_no").alias("gene")), "SELECT transcript, arg_max(gene, line_no) AS gene FROM v_feature GROUP BY 1")
on("a1_longest_isoform", "v_feature", lambda d: anchors.longest_per_gene(_tx(d)),
   f"SELECT gene, transcript, cds_len FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY cds_len DESC, transcript DESC) AS k FROM ({_TX})) WHERE k = 1")
on("a2_duplicate_genes", "v_tx", anchors.duplicate_genes, "SELECT DISTINCT gene FROM v_tx WHERE seq IN (SELECT seq FROM v_tx GROUP BY 1 HAVING count(*) > 1)")
on("j4_genes_without_duplicates", "v_tx", lambda d: anchors.without_genes(d, anchors.duplicate_genes(d)).select("transcript"),
   "SELECT transcript FROM v_tx WHERE gene NOT IN (SELECT gene FROM v_tx WHERE seq IN (SELECT seq FROM v_tx GROUP BY 1 HAVING count(*) > 1))")
on("a4_copy_ratio", "v_copies", anchors.copy_blacklist,
   """SELECT DISTINCT gene FROM (SELECT gene, query_chr, count(*) AS n, min(score) AS lo, max(score) AS hi FROM (SELECT gene, query_chr, score, row_number() OVER (PARTITION BY gene, query_chr ORDER BY score DESC, line_no) AS k FROM v_copies) WHERE k <= 2 GROUP BY ALL) WHERE n > 1 AND lo / hi > 0.9""")
on("a5_usage_counters", "v_ranked", lambda d: anchors.usage(d.withColumn("block", F.col("line_no") % 50)),
   """SELECT 'ref' AS side, gene AS name, count(DISTINCT line_no % 50) AS times FROM v_ranked GROUP BY ALL UNION ALL SELECT 'query', query_chr || ':' || CAST(query_id AS VARCHAR), count(*) FROM v_ranked GROUP BY ALL""")
on("a6_block_summary", "v_ranked", lambda d: anchors.block_summary(d.withColumn("pos", F.col("ref_id") - 1), ["ref_chr", "query_chr"]),
   """SELECT ref_chr, query_chr, count(*) AS n, round(sum(score), 6) AS score, min(ref_start) AS ref_start, max(ref_end) AS ref_end, min(query_start) AS query_start, max(query_end) AS query_end,
 CASE WHEN coalesce(max(CASE WHEN ref_id = 1 THEN query_id END) < max(CASE WHEN ref_id = 2 THEN query_id END), max(CASE WHEN ref_id = 1 THEN strand END) = '+') THEN 'POSITIVE' ELSE 'NEGATIVE' END AS direction FROM v_ranked GROUP BY ALL""")
on("a8_base_profile", "v_seq", lambda d: profiles.base_profile(d.select(F.col("seq_id").alias("id"), "seq")).select("id", "length", F.round("ambiguous_fraction", 9).alias("ambiguous"), F.round("low_complexity_fraction", 9).alias("tails"), F.round("normalized_entropy", 6).alias("entropy")),
   """WITH b AS (SELECT seq_id, unnest(string_split(seq, '')) AS base, unnest(range(length(seq))) AS i FROM v_seq), k AS (SELECT seq_id, i // 64 AS blk, base, count(*) AS k FROM b WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL),
e AS (SELECT seq_id, sum(-k * log2(k / n)) / 2 AS w FROM (SELECT *, sum(k) OVER (PARTITION BY seq_id, blk) AS n FROM k) GROUP BY 1),
r AS (SELECT seq_id, sum(length(x) - 3) AS tails FROM (SELECT seq_id, unnest(regexp_extract_all(seq, 'A{4,}|C{4,}|G{4,}|T{4,}')) AS x FROM v_seq) GROUP BY 1)
SELECT s.seq_id AS id, length(seq) AS length, round(length(regexp_replace(seq, '[ACGT]', '', 'g')) / length(seq), 9) AS ambiguous, round(coalesce(tails, 0) / length(seq), 9) AS tails, round(coalesce(w, 0) / length(seq), 6) AS entropy
FROM v_seq s LEFT JOIN e USING (seq_id) LEFT JOIN r USING (seq_id)""")


def _neighbours(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = profiles.sketch(d.select(F.col("seq_id").alias("id"), "seq"), 9, most=1 << 30)
    return a, a.withColumn("id", F.col("id") - 1)


on("a9_sketch_similarity", "v_seq", lambda d: profiles.sketch_similarity(*_neighbours(d), 9).where("jaccard is not null").select("id", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("mismatch", 9).alias("mismatch")),
   """WITH k AS (SELECT DISTINCT seq_id, unnest([seq[i:i + 8] for i in range(1, length(seq) - 7)]) AS kmer FROM v_seq), g AS (SELECT * FROM k WHERE NOT contains(kmer, 'N')), n AS (SELECT seq_id, count(*) AS n FROM g GROUP BY 1),
ids AS (SELECT seq_id AS id FROM n UNION SELECT seq_id - 1 FROM n), s AS (SELECT a.seq_id AS id, count(*) AS shared FROM g a JOIN g b ON a.kmer = b.kmer AND b.seq_id = a.seq_id + 1 GROUP BY 1),
j AS (SELECT ids.id, coalesce(shared, 0) AS shared, coalesce(shared, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(shared, 0)) AS j FROM ids LEFT JOIN n x ON x.seq_id = ids.id LEFT JOIN n y ON y.seq_id = ids.id + 1 LEFT JOIN s ON s.id = ids.id)
SELECT id, shared, round(j, 9) AS jaccard, round(CASE WHEN j <= 0 THEN 1.0 ELSE 1 - pow(2 * j / (1 + j), 1.0::DOUBLE / 9) END, 9) AS mismatch FROM j""")


@query("""WITH k AS (SELECT seq_id AS id, unnest([seq[i:i + 14] for i in range(1, length(seq) - 13)]) AS kmer, unnest(range(greatest(length(seq) - 14, 0))) AS pos FROM v_seq),
c AS (SELECT id, pos, list_reduce([CAST(strpos('ACGT', x) - 1 AS HUGEINT) for x in string_split(kmer, '')], lambda a, b: a * 4 + b) AS code FROM k WHERE regexp_full_match(kmer, '[ACGT]{15}')),
m AS (SELECT id, pos, CAST((code * 11507291218515648293) % 18446744073709551616 AS UBIGINT) AS m FROM c), h AS (SELECT id, pos, xor(m, m >> 28) AS h FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY id, h ORDER BY pos) AS k FROM h WHERE h % 4 = 0)
SELECT id, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE h END AS BIGINT) AS hash, pos FROM r WHERE k <= 4""")
def j8_kmer_sketch(spark, sf_dir):
    return profiles.sketch(view(spark, sf_dir, "v_seq").select(F.col("seq_id").alias("id"), "seq"), 15, 4)


@query()
def l15_pair_profile(spark, sf_dir):
    s = view(spark, sf_dir, "v_seq")
    other = s.select((F.col("seq_id") - 1).alias("id"), F.concat(F.col("seq"), F.lit("ACGTAGGT")).alias("b"))
    return profiles.pair_profile(s.select(F.col("seq_id").alias("id"), F.concat(F.lit("GGATTACA"), F.col("seq")).alias("a")).join(other, "id"), 9)


on("f10_mash_mismatch", "v_match", lambda d: d.select("line_no", F.round(exprs.mash_mismatch(F.col("score"), 15), 9).alias("rate")), "SELECT line_no, round(CASE WHEN score <= 0 THEN 1.0 ELSE 1 - pow(2 * score / (1 + score), 1.0::DOUBLE / 15) END, 9) AS rate FROM v_match")
on("a10_floor_quantiles", "v_match", lambda d: profiles.floor_quantiles(d, ["gene"], "ref_start", p90=0.9, p99=0.99), "SELECT gene, list_sort(list(ref_start))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p90, list_sort(list(ref_start))[CAST(floor(0.99::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p99 FROM v_match GROUP BY 1")
on("a10_median_deviation", "v_match", lambda d: profiles.deviations(d, ["ref_chr"], "query_start"),
   "WITH m AS (SELECT ref_chr, median(query_start) AS median FROM v_match GROUP BY 1) SELECT ref_chr, m.median, median(abs(query_start - m.median)) AS mad FROM v_match JOIN m USING (ref_chr) GROUP BY ALL")
on("a11_union_length", "v_match", lambda d: anchors.merged_length(d, ["ref_chr"], "ref_start", "ref_end"),
   """WITH m AS (SELECT ref_chr, ref_start, ref_end, max(ref_end) OVER (PARTITION BY ref_chr ORDER BY ref_start, ref_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM v_match),
i AS (SELECT *, sum(CASE WHEN high IS NULL OR ref_start > high THEN 1 ELSE 0 END) OVER (PARTITION BY ref_chr ORDER BY ref_start, ref_end) AS island FROM m)
SELECT ref_chr, CAST(sum(len) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS n, count(*) AS islands FROM (SELECT ref_chr, island, max(ref_end) - min(ref_start) + 1 AS len, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1""")


@query("""WITH m AS (SELECT DISTINCT 'x' || CAST(c_nationkey % 4 AS VARCHAR) AS taxon, 'f' || CAST(c_custkey % 40 AS VARCHAR) AS family, c_custkey % 200 AS member FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT taxon, family, count(*) AS n FROM m GROUP BY ALL),
c AS (SELECT *, CASE WHEN family IN ('f1', 'f2', 'f3') AND taxon = 'x1' THEN 2 WHEN taxon = 'x2' THEN 3 ELSE 1 END AS capacity FROM n) SELECT taxon, family, n, CAST(capacity AS BIGINT) AS capacity FROM c WHERE n > capacity""")
def a13_over_capacity(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    members = c.select(F.concat(F.lit("x"), (F.col("c_nationkey") % 4).cast("string")).alias("taxon"), F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string")).alias("family"), (F.col("c_custkey") % 200).alias("member"), F.when(F.col("c_custkey") % 3 == 0, "soft").otherwise("hard").alias("constraint"))
    return copies.over_capacity(members, sources.capacities(spark, ["f1:x1=2", "f2:x1=2", "f3:x1=2", "x2=3"]))


on("a14_consistency_class", "v_graph", lambda d: ancestry.consistency(d.select("site_id", "taxon"), d.where("pos0 % 5 <> 0").select("site_id", F.when(F.col("taxon") == "x0", "x1").when(F.col("taxon") == "x1", "x2").otherwise("x0").alias("a"), F.col("taxon").alias("b")), "x0", "x1", "x2"),
   """WITH t AS (SELECT site_id, count(DISTINCT taxon) AS taxa FROM v_graph GROUP BY 1), p AS (SELECT site_id, count(DISTINCT taxon) AS pairs FROM v_graph WHERE pos0 % 5 <> 0 GROUP BY 1)
SELECT site_id, CASE WHEN taxa < 3 THEN 'MISSING_EVIDENCE' WHEN pairs = 3 THEN 'CONSISTENT' WHEN pairs = 2 THEN 'SUPPORTED_BY_TWO_EDGES' ELSE 'MISSING_EVIDENCE' END AS consistency FROM t LEFT JOIN p USING (site_id)""")
on("a15_iupac_mask_or", "v_residue", graph.leaf_masks, "SELECT site_id, taxon, CAST(bit_or(strpos('-ACMGRSVTWYHKDBN', base) - 1) AS INT) AS mask FROM v_residue GROUP BY ALL")
on("a16_consensus_base", "v_residue", graph.consensus, "SELECT site_id, base, n FROM (SELECT site_id, base, count(*) AS n, row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, base) AS k FROM v_residue GROUP BY site_id, base) WHERE k = 1")
_SITES = "SELECT site_id, CASE WHEN count(DISTINCT taxon) = 3 THEN 'CONSISTENT' ELSE 'MISSING_EVIDENCE' END AS consistency, site_id % 9 <> 0 AS copy_resolved FROM v_graph GROUP BY site_id"


def _sites(d: DataFrame) -> DataFrame:
    return d.groupBy("site_id").agg(F.when(F.countDistinct("taxon") == 3, "CONSISTENT").otherwise("MISSING_EVIDENCE").alias("consistency")).withColumn("copy_resolved", F.col("site_id") % 9 != 0)


on("p12_boundary_predicate", "v_graph", lambda d: (lambda x: x.select("site_id", ancestry.boundary(x).alias("boundary")))(_sites(d)), f"SELECT site_id, consistency = 'CONSISTENT' AND copy_resolved AS boundary FROM ({_SITES})")


@query(f"""WITH s AS ({_SITES}), r AS (SELECT count(*) AS residues, count(DISTINCT site_id) AS sites, count(DISTINCT path) AS paths, count(DISTINCT taxon) AS taxa FROM v_graph), c AS (SELECT count(*) FILTER (WHERE consistency = 'CONSISTENT') AS consistent, count(*) FILTER (WHERE consistency = 'MISSING_EVIDENCE') AS missing_evidence, count(*) FILTER (WHERE copy_resolved) AS copy_resolved FROM s)
SELECT 'residues' AS metric, residues AS value FROM r UNION ALL SELECT 'sites', sites FROM r UNION ALL SELECT 'paths', paths FROM r UNION ALL SELECT 'taxa', taxa FROM r UNION ALL SELECT 'aligned_absences', count(*) FROM v_absent
UNION ALL SELECT 'consistent', consistent FROM c UNION ALL SELECT 'supported_by_two_edges', 0 UNION ALL SELECT 'missing_evidence', missing_evidence FROM c UNION ALL SELECT 'copy_resolved', copy_resolved FROM c""")
def a19_qc_counters(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph")
    return ancestry.qc(g, view(spark, sf_dir, "v_absent"), _sites(g))


on("a20_sorted_unique_ids", "v_residue", lambda d: d.groupBy("taxon").agg(F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("site_id").cast("string"), 3, "0"))), ",").alias("ids")),
   "SELECT taxon, list_aggregate(list_sort(list_distinct(list(lpad(CAST(site_id AS VARCHAR), 3, '0')))), 'string_agg', ',') AS ids FROM v_residue GROUP BY 1")
_ALL_ORDER = "ref_chr, ref_start, ref_end, query_start, query_end, line_no"
on("u1_union_anchors", "v_match", lambda d: anchors.with_novel(anchors.similar(d, 0.95), d.where("score < 0.92")).select("line_no", "rank"), f"SELECT line_no, row_number() OVER (ORDER BY {_ALL_ORDER}) - 1 AS rank FROM v_match WHERE score > 0.95 OR score < 0.92")
on("u2_names_apart", "v_match", lambda d: (lambda x: anchors.names_apart(x.where("strand = '-'").select("name"), x.where("strand = '+'").select("name")))(d.select("strand", F.concat_ws("_", "gene", "ref_chr", "query_chr").alias("name"))),
   """WITH a AS (SELECT DISTINCT gene || '_' || ref_chr || '_' || query_chr AS name FROM v_match WHERE strand = '-'), b AS (SELECT DISTINCT gene || '_' || ref_chr || '_' || query_chr AS name FROM v_match WHERE strand = '+') SELECT name, 'a' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'b' FROM b WHERE name NOT IN (SELECT name FROM a)""")
on("u3_variants_apart", "v_variant", lambda d: anchors.variants_apart(d.where("pos % 3 <> 0"), d.where("pos % 2 = 0")),
   """WITH a AS (SELECT DISTINCT chrom, pos, ref, alt FROM v_variant WHERE pos % 3 <> 0), b AS (SELECT DISTINCT chrom, pos, ref, alt FROM v_variant WHERE pos % 2 = 0), u AS (SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT *, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, side, ref, alt) AS lag FROM u""")
on("u5_touched_pairs", "v_match", lambda d: anchors.touched(d, d.where("gene = 'g7' and query_chr = 'Q1'")).groupBy("ref_chr", "query_chr").agg(F.count(F.lit(1)).alias("n")),
   "WITH c AS (SELECT * FROM v_match WHERE gene = 'g7' AND query_chr = 'Q1') SELECT ref_chr, query_chr, count(*) AS n FROM v_match WHERE ref_chr IN (SELECT ref_chr FROM c) OR query_chr IN (SELECT query_chr FROM c) GROUP BY ALL")
_SDI = """t AS (SELECT *, left(ref, 1) = left(alt, 1) AS h, left(ref, 1) <> left(alt, 1) AND NOT (length(ref) = 1 AND length(alt) = 1) AND right(ref, 1) = right(alt, 1) AS t FROM v),
c AS (SELECT chrom, CASE WHEN h THEN pos - 1 ELSE pos END AS pos, length(alt) - length(ref) AS diff, CASE WHEN h THEN substr(ref, 2) WHEN t THEN substr(ref, 1, length(ref) - 1) ELSE ref END AS r, CASE WHEN h THEN substr(alt, 2) WHEN t THEN substr(alt, 1, length(alt) - 1) ELSE alt END AS a FROM t)
SELECT chrom, pos, CAST(diff AS INT) AS diff, CASE WHEN r = '' THEN '-' ELSE r END AS ref, CASE WHEN a = '' THEN '-' ELSE a END AS alt FROM c"""
on("h4_variant_to_sdi", "v_variant", lambda d: anchors.variant_to_sdi(d.withColumn("chrom", F.concat(F.lit("chr"), "chrom"))), "WITH v AS (SELECT * FROM v_variant), " + _SDI)
on("h5_gvcf_to_sdi", "v_variant", lambda d: anchors.gvcf_to_sdi(d.withColumn("alt", F.when(F.col("pos") % 3 == 0, "<NON_REF>").otherwise(F.concat("alt", F.lit(",<NON_REF>"))))), "WITH v AS (SELECT * FROM v_variant WHERE pos % 3 <> 0), " + _SDI)

# ---------------------------------------------------------------- files: written by a sink or by Spark, read by a source


def _written(lines: DataFrame, label: str, hide_gzip: bool = False) -> str:
    """The folder that ``lines`` (one column) were written to; with ``hide_gzip`` as gzip files whose names don't tell."""
    spark = lines.sparkSession
    path = f"{shared_folder(spark)}/locusframe-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    lines.write.option("compression", "gzip" if hide_gzip else "none").text(path)
    if hide_gzip:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.endswith(".gz"):
                fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(where, name[:-3]))
    return path


def _wrapped(c: str, width: int) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


@query("SELECT 's' || CAST(seq_id AS VARCHAR) AS name, length(seq) AS length, seq FROM v_seq")
def s1_fasta(spark, sf_dir):
    lines = view(spark, sf_dir, "v_seq").select(F.concat(F.lit(">s"), F.col("seq_id").cast("string"), F.lit(" of the benchmark\n"), _wrapped("seq", 37)))
    return sources.read_fasta(spark, _written(lines, "fasta", True))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM benchmark) GROUP BY 1")
def s2_gzip_by_magic(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select("text")
    return sources.read_lines(spark, _written(lines, "lines", True)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT seqid, start1, end1, strand, transcript, count(*) AS n FROM v_feature WHERE end1 - start1 + 1 >= 10 GROUP BY ALL")
def s5_gff(spark, sf_dir):
    f = view(spark, sf_dir, "v_feature")
    row = lambda kind: F.concat_ws("\t", "seqid", F.lit("."), F.lit(kind), F.col("end1").cast("string"), F.col("start1").cast("string"), F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID=x;Parent="), "transcript", F.lit(",other")))
    path = _written(f.select(F.explode(F.array(row("CDS"), row("exon"), F.lit("# a remark"))).alias("line")), "gff")
    return sources.read_gff(spark, path, least=10).groupBy("seqid", F.col("start1").cast("long").alias("start1"), F.col("end1").cast("long").alias("end1"), "strand", "transcript").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT transcript, CASE substr(transcript, length(transcript)) WHEN '0' THEN 'p' WHEN '1' THEN 'i' ELSE 'g' END || transcript AS gene FROM v_feature")
def s7_gene_map_by_precedence(spark, sf_dir):
    t, last = F.col("transcript"), F.right("transcript", F.lit(1))
    attrs = F.when(last == "0", F.concat(F.lit("ID="), t, F.lit(";Parent=p"), t, F.lit(";geneID=i"), t)).when(last == "1", F.concat(F.lit("ID="), t, F.lit(";geneID=i"), t, F.lit(";gene_id g"), t)).otherwise(F.concat(F.lit('gene_id "g'), t, F.lit('"; transcript_id "'), t, F.lit('"')))
    lines = view(spark, sf_dir, "v_feature").select("transcript").distinct().select(F.concat_ws("\t", F.lit("c"), F.lit("."), F.lit("mRNA"), F.lit("1"), F.lit("2"), F.lit("."), F.lit("+"), F.lit("."), attrs))
    return sources.read_gene_map(spark, _written(lines, "genes"))


@query("""WITH o AS (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS p FROM v_sam WHERE line_no % 6 <> 5)
SELECT qname, CAST(flag AS INT) AS flag, rname, CAST(pos1 AS INT) AS pos1, flag % 32 <> 0 AS reverse, CASE WHEN p[1][-1:] IN ('S', 'H') THEN CAST(p[1][:-2] AS BIGINT) ELSE 0 END AS head, CASE WHEN p[-1][-1:] IN ('S', 'H') AND len(p) > 1 THEN CAST(p[-1][:-2] AS BIGINT) ELSE 0 END AS tail,
 CAST(list_sum([CASE WHEN x[-1:] IN ('M', '=', 'X') THEN CAST(x[:-2] AS BIGINT) ELSE 0 END for x in p]) AS BIGINT) AS aligned, CAST(list_sum([CASE WHEN x[-1:] IN ('M', '=', 'X', 'D', 'N') THEN CAST(x[:-2] AS BIGINT) ELSE 0 END for x in p]) AS BIGINT) AS span FROM o""")
def s9_sam(spark, sf_dir):
    broken = F.when(F.col("line_no") % 12 == 5, "*").otherwise("7Q")
    row = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos1").cast("string"), F.lit("60"), F.when(F.col("line_no") % 6 == 5, broken).otherwise(F.col("cigar")), F.lit("rest"))
    lines = view(spark, sf_dir, "v_sam").select(row.alias("line")).union(spark.range(1).select(F.lit("@PG\tID:minimap2\tCL:minimap2 -k 12 -A 3")))
    return sources.read_sam(spark, _written(lines, "sam")).select("qname", "flag", "rname", "pos1", "reverse", "head", "tail", "aligned", "span")


@query("""SELECT ref_gene, ref_chr, ref_id, ref_start, ref_end, query_gene, query_chr, query_id, query_start, query_end, strand, round(round(score * 100) / 100, 9) AS score FROM v_pairs""")
def s11_pairs(spark, sf_dir):
    p = view(spark, sf_dir, "v_pairs")
    own = "ref_gene ref_chr ref_id ref_start ref_end + query_gene query_chr query_id query_start query_end".split()
    cells = [F.lit("+") if c == "+" else F.col(c).cast("string") for c in own]
    lines = p.select(F.concat_ws("\t", *cells, "strand", F.round(F.col("score") * 100).cast("string")))
    got = sources.read_pairs(spark, _written(lines, "pairs"))
    return got.select(*[c for c in own if c != "+"], "strand", F.round("score", 9).alias("score"))


@query("SELECT source, start0, length(replace(text, '-', '')) AS size, strand, source_size, text FROM v_rows")
def s13_maf(spark, sf_dir):
    n = F.char_length(F.replace(F.col("text"), F.lit("-"), F.lit(""))).cast("string")
    row = F.concat_ws(" ", F.lit("s"), "source", F.col("start0").cast("string"), n, "strand", F.col("source_size").cast("string"), "text")
    blocks = view(spark, sf_dir, "v_rows").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", row.alias("l")))).alias("ls"))
    lines = blocks.select(F.concat(F.lit("##maf version=1\na score=1\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")))
    return sources.read_maf(spark, _written(lines, "maf")).select("source", "start0", "size", "strand", "source_size", "text")


_GFA_SITES = "SELECT site_id, CASE WHEN count(DISTINCT taxon) = 3 THEN 'CONSISTENT' ELSE 'MISSING_EVIDENCE' END AS consistency, CASE WHEN site_id % 9 <> 0 THEN 'k' || CAST(site_id % 4 AS VARCHAR) END AS copy_group FROM v_graph GROUP BY site_id"


def _gfa_sites(g: DataFrame) -> DataFrame:
    return _sites(g).select("site_id", "consistency", F.when(F.col("copy_resolved"), F.concat(F.lit("k"), (F.col("site_id") % 4).cast("string"))).alias("copy_group"))


@query(f"""WITH s AS ({_GFA_SITES}), n AS (SELECT *, CAST(site_id AS VARCHAR) || '_' || base AS node FROM v_graph), l AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b ON a.path = b.path AND b.pos0 = a.pos0 + 1),
r AS (SELECT *, pos0 - row_number() OVER (PARTITION BY path ORDER BY pos0) AS run FROM n)
SELECT DISTINCT 'S' || chr(9) || node || chr(9) || base || chr(9) || 'SI:Z:' || CAST(n.site_id AS VARCHAR) || chr(9) || 'CL:Z:' || consistency || coalesce(chr(9) || 'CG:Z:' || copy_group, '') AS line FROM n JOIN s USING (site_id)
UNION ALL SELECT 'L' || chr(9) || x || chr(9) || '+' || chr(9) || y || chr(9) || '+' || chr(9) || '0M' FROM l
UNION ALL SELECT 'P' || chr(9) || path || ':' || CAST(min(pos0) AS VARCHAR) || chr(9) || string_agg(node || '+', ',' ORDER BY pos0) || chr(9) || '*' || chr(9) || 'TX:Z:' || any_value(taxon) || chr(9) || 'SN:Z:' || any_value(sequence) || chr(9) || 'SO:i:' || CAST(min(pos0) AS VARCHAR) || chr(9) || 'EO:i:' || CAST(max(pos0) + 1 AS VARCHAR) FROM r GROUP BY path, run""")
def w9_gfa(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph")
    return sinks.gfa_lines(g, _gfa_sites(g), "core").where("part > 0").select("line")


@query(f"""WITH s AS ({_GFA_SITES}) SELECT concat_ws(chr(9), CAST(site_id AS VARCHAR), CAST(site_id AS VARCHAR) || '_' || base, taxon, path, sequence, CAST(pos0 AS VARCHAR), CAST(source_size AS VARCHAR), 'OBSERVED_BASE', base, coalesce(copy_group, '.'), consistency) AS line FROM v_graph JOIN s USING (site_id)
UNION ALL SELECT concat_ws(chr(9), CAST(site_id AS VARCHAR), '.', '.', path, '.', '.', '.', 'ALIGNED_ABSENCE', '-', coalesce(copy_group, '.'), consistency) FROM v_absent JOIN s USING (site_id)""")
def w10_graph_metadata(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph")
    return sinks.metadata_lines(g, view(spark, sf_dir, "v_absent"), _gfa_sites(g)).select("line")


# ---------------------------------------------------------------- orders

for _id, _key in {
    "o1": "ref_start", "o2": "ref_start, ref_end, query_start, query_end", "o3": "query_start, query_end, ref_start, ref_end", "o4": "ref_chr, query_chr, ref_start, ref_end, query_start, query_end",
    "o5": "query_chr, ref_chr, query_start, gene, ref_start", "o6": "query_chr, ref_chr, ref_start, gene, query_start", "o7": "pair, ref_start, ref_end DESC, gene, query_start, query_end DESC", "o8": "score DESC",
}.items():
    on(f"{_id}_order", "v_match", lambda d, k=_key: ranked(d.withColumn("pair", F.concat_ws("_", "ref_chr", "query_chr")), [*[F.desc(c[:-5]) if c.endswith(" DESC") else F.col(c) for c in k.split(", ")], "line_no"]).select("line_no", "rank"),
       f"SELECT line_no, row_number() OVER (ORDER BY {_key.replace('pair', chr(40) + 'ref_chr || ' + repr('_') + ' || query_chr' + chr(41))}, line_no) - 1 AS rank FROM v_match")
on("o12_top_copies", "v_match", lambda d: anchors.top_copies(d, 2).select("gene", "query_chr", "line_no"),
   "SELECT gene, query_chr, line_no FROM (SELECT *, row_number() OVER (PARTITION BY gene, query_chr ORDER BY score DESC, line_no) AS k FROM v_match) WHERE k <= 2")

# ---------------------------------------------------------------- graph and ancestry

_TREE = "((a,b)anc,c)root;"


def _calls(d: DataFrame) -> DataFrame:
    leaves = {x: F.when(F.col(x).isNotNull(), exprs.mask_of(F.col(x)).cast("int")) for x in "abc"}
    return d.select("site_id", "c", graph.sankoff(newick.parse(_TREE), "anc", leaves).alias("costs"))


_M = {x: f"(strpos('-ACMGRSVTWYHKDBN', {x}) - 1)" for x in "abc"}
_COST = ", ".join(f"({' + '.join(f'CASE WHEN {x} IS NULL OR {_M[x]} & {1 << k} <> 0 THEN 0.0 ELSE 1.0 END' for x in 'abc')}) AS k{k}" for k in range(4))
_CALLS = f"WITH s AS (SELECT site_id, c, {_COST} FROM v_site), t AS (SELECT *, least(k0, k1, k2, k3) AS low FROM s)"
_MASK = " + ".join(f"CASE WHEN k{k} <= low + 1e-9 THEN {1 << k} ELSE 0 END" for k in range(4))
on("g11_sankoff", "v_site", lambda d: _calls(d).select("site_id", F.array_min("costs").alias("best"), graph.best_states(F.col("costs")).cast("int").alias("mask"), graph.margin(F.col("costs")).alias("margin")),
   _CALLS + f" SELECT site_id, CAST(low AS DOUBLE) AS best, CAST({_MASK} AS INT) AS mask, CAST(list_sort([k0, k1, k2, k3])[2] - low AS DOUBLE) AS margin FROM t")
on("g13_decision", "v_site", lambda d: _calls(d).select("site_id", graph.decide(F.when(F.col("c").isNull(), "AMBIGUOUS").otherwise("PRESENT"), F.col("site_id") % 11 != 0, graph.best_states(F.col("costs"))).alias("decision")),
   _CALLS + f" SELECT site_id, CASE WHEN site_id % 11 = 0 THEN 'COPY_UNRESOLVED' WHEN c IS NULL THEN 'PRESENCE_AMBIGUOUS' WHEN ({_MASK}) NOT IN (1, 2, 4, 8) THEN 'BASE_AMBIGUOUS' ELSE 'EMITTED' END AS decision FROM t")


@query("SELECT site_id, taxon, CAST(max(p) AS INT) AS presence FROM (SELECT site_id, taxon, 2 AS p FROM v_graph UNION ALL SELECT site_id, taxon, 1 FROM v_absent) GROUP BY ALL")
def g12_leaf_presence(spark, sf_dir):
    return ancestry.leaf_presence(view(spark, sf_dir, "v_graph"), view(spark, sf_dir, "v_absent"))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "v_graph")
    return ancestry.calls(g, view(spark, sf_dir, "v_absent"), _sites(g), newick.parse("((x0,x1)anc,x2)root;"), "anc", emit_ambiguous=True)


_CALLED = f"""s AS ({_SITES}), p AS (SELECT site_id, taxon, max(p) AS p FROM (SELECT site_id, taxon, 2 AS p FROM v_graph UNION ALL SELECT site_id, taxon, 1 FROM v_absent) GROUP BY ALL),
n AS (SELECT site_id, count(*) FILTER (WHERE p = 2) AS yes, count(*) FILTER (WHERE p = 1) AS no FROM p GROUP BY 1), b AS (SELECT site_id, base, count(*) AS k FROM v_graph GROUP BY ALL), m AS (SELECT site_id, max(k) AS top FROM b GROUP BY 1),
w AS (SELECT site_id, CAST(sum(1 << (strpos('ACGT', base) - 1)) AS INT) AS mask FROM b JOIN m USING (site_id) WHERE k = top GROUP BY 1),
calls AS (SELECT s.site_id, CASE WHEN NOT copy_resolved THEN 'COPY_UNRESOLVED' WHEN yes = no THEN 'PRESENCE_AMBIGUOUS_EMITTED' WHEN no > yes THEN 'ANCESTRAL_ABSENT' WHEN mask NOT IN (1, 2, 4, 8) THEN 'BASE_AMBIGUOUS' ELSE 'EMITTED' END AS decision,
 CASE WHEN copy_resolved AND no <= yes THEN substr('-ACMGRSVTWYHKDBN', mask + 1, 1) END AS base FROM s JOIN n USING (site_id) JOIN w USING (site_id))"""


@query(f"WITH {_CALLED} SELECT * FROM calls")
def g13_site_calls(spark, sf_dir):
    return _called(spark, sf_dir).select("site_id", "decision", "base")


@query("""WITH e AS (SELECT DISTINCT site_id AS a, nx AS b FROM (SELECT site_id, lead(site_id) OVER (PARTITION BY path ORDER BY pos0) AS nx FROM v_graph) WHERE nx IS NOT NULL),
s AS (SELECT *, lead(site_id) OVER (PARTITION BY c ORDER BY site_id) AS nx FROM (SELECT DISTINCT site_id, site_id // 500 AS c FROM v_graph)), u AS (SELECT s.*, nx IS NULL OR EXISTS (SELECT 1 FROM e WHERE a = site_id AND b = nx) AS linked FROM s)
SELECT site_id, min(site_id) OVER w AS comp, CASE WHEN bool_and(linked) OVER w THEN row_number() OVER (PARTITION BY c ORDER BY site_id) - 1 END AS place FROM u WINDOW w AS (PARTITION BY c)""")
def g7_site_orders(spark, sf_dir):
    return ancestry.orders(view(spark, sf_dir, "v_graph"))


@query(f"""WITH {_CALLED}, o AS (SELECT site_id, base, site_id // 500 AS c, site_id - min(site_id) OVER (PARTITION BY site_id // 500) AS place, min(site_id) OVER (PARTITION BY site_id // 500) AS comp FROM calls), r AS (SELECT *, place - row_number() OVER (PARTITION BY c ORDER BY place) AS run FROM o WHERE base IS NOT NULL)
SELECT CAST(comp AS VARCHAR) || ':' || CAST(min(place) AS VARCHAR) AS block, count(*) AS length, string_agg(base, '' ORDER BY place) AS sequence FROM r GROUP BY comp, run""")
def g14_ancestral_blocks(spark, sf_dir):
    return ancestry.block_sequences(ancestry.blocks(_called(spark, sf_dir), ancestry.orders(view(spark, sf_dir, "v_graph"))))


_STRETCHES = """ob AS (SELECT site_id, path, pos0, base FROM v_graph WHERE taxon IN ({taxa})), kn AS (SELECT * FROM ob UNION ALL SELECT DISTINCT a.site_id, a.path, CAST(NULL AS BIGINT), '-' FROM v_absent a WHERE taxon IN ({taxa}) AND NOT EXISTS (SELECT 1 FROM ob WHERE ob.site_id = a.site_id AND ob.path = a.path)),
sh AS (SELECT site_id, string_agg(path, ',' ORDER BY path) AS shape FROM kn GROUP BY 1), mk AS (SELECT bs.*, shape, CASE WHEN lag(idx) OVER w = idx - 1 AND lag(shape) OVER w IS NOT DISTINCT FROM shape THEN 0 ELSE 1 END AS new FROM bs LEFT JOIN sh USING (site_id) WINDOW w AS (PARTITION BY block ORDER BY idx)),
rk AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY idx) AS k FROM mk), rn AS (SELECT *, min(idx) OVER (PARTITION BY block, k) AS run FROM rk), me AS (SELECT path, any_value(taxon) AS taxon, any_value(sequence) AS sequence, any_value(source_size) AS source_size FROM v_graph GROUP BY 1),
cl AS (SELECT block, run, kn.path, string_agg(kn.base, '' ORDER BY idx) AS row, min(pos0) AS lo, count(pos0) AS n, max(pos0) - min(pos0) + 1 = count(pos0) AS follows FROM rn JOIN kn USING (site_id) GROUP BY ALL)"""


@query(f"WITH {_CALLED}, " + """o AS (SELECT site_id, base, site_id // 500 AS c, site_id - min(site_id) OVER (PARTITION BY site_id // 500) AS place, min(site_id) OVER (PARTITION BY site_id // 500) AS comp FROM calls), r AS (SELECT *, place - row_number() OVER (PARTITION BY c ORDER BY place) AS run FROM o WHERE base IS NOT NULL),
bs AS (SELECT CAST(comp AS VARCHAR) || ':' || CAST(min(place) OVER w AS VARCHAR) AS block, place - min(place) OVER w AS idx, site_id, base FROM r WINDOW w AS (PARTITION BY comp, run)), """ + _STRETCHES.format(taxa="'x0', 'x1'") + """,
an AS (SELECT block, run, count(*) AS size, string_agg(base, '' ORDER BY idx) AS text FROM rn GROUP BY ALL)
SELECT block, run AS start0, size, text, path, taxon, sequence, source_size, coalesce(lo, 0) AS child_start0, n AS child_size, row AS child_text FROM cl JOIN an USING (block, run) JOIN me USING (path) WHERE n = 0 OR follows""")
def g15_child_projection(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph")
    return ancestry.children(ancestry.blocks(_called(spark, sf_dir), ancestry.orders(g)), g, view(spark, sf_dir, "v_absent"), ["x0", "x1"])


@query("""WITH bs AS (SELECT min(site_id) OVER (PARTITION BY site_id // 500) AS block, site_id - min(site_id) OVER (PARTITION BY site_id // 500) AS idx, site_id FROM (SELECT DISTINCT site_id FROM v_graph)), """ + _STRETCHES.format(taxa="'x0', 'x1', 'x2'") + """,
ok AS (SELECT block, run FROM cl LEFT JOIN me USING (path) GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT taxon) >= 2 AND bool_and(taxon IS NOT NULL AND n > 0 AND follows))
SELECT block AS comp, run, path, taxon, sequence, source_size, lo AS start0, n AS size, row AS text FROM cl JOIN ok USING (block, run) JOIN me USING (path)""")
def w11_maf_projection(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph")
    return ancestry.projections(g, view(spark, sf_dir, "v_absent"), ancestry.orders(g))[0]


@query()
def g10_local_repair(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph").withColumn("site_id", F.when((F.col("taxon") == "x1") & (F.col("site_id") % 50).between(20, 22), F.col("site_id") + 1_000_000).otherwise(F.col("site_id"))).select("site_id", "path", "pos0", "base")
    seeds = g.where("site_id % 50 = 21 and path not like 'x2%'").select(F.concat(F.lit("c"), (F.col("site_id") % 1_000_000).cast("string")).alias("conflict_id"), "path", "pos0")
    sites = g.groupBy("site_id").agg((F.count(F.lit(1)) == 3).alias("boundary"))
    return repair.repair(seeds, g, view(spark, sf_dir, "v_absent").select("site_id", "path"), sites)[2]


on("g6_core_hash", "v_graph", ancestry.core_hash, None)
on("g6_invariants", "v_graph", lambda d: ancestry.violations(d.unionByName(d.where("site_id % 40 = 0").withColumn("pos0", F.col("pos0") + 595)).unionByName(d.where("site_id % 41 = 0").withColumn("site_id", F.col("site_id") + 1))),
   """WITH r AS (SELECT site_id, path, pos0, source_size FROM v_graph UNION ALL SELECT site_id, path, pos0 + 595, source_size FROM v_graph WHERE site_id % 40 = 0 UNION ALL SELECT site_id + 1, path, pos0, source_size FROM v_graph WHERE site_id % 41 = 0)
SELECT 'residue in several sites' AS what, path || ':' || CAST(pos0 AS VARCHAR) AS id, count(DISTINCT site_id) AS n FROM r GROUP BY ALL HAVING count(DISTINCT site_id) > 1
UNION ALL SELECT 'two residues of a path in a site', CAST(site_id AS VARCHAR) || ':' || path, count(DISTINCT pos0) FROM r GROUP BY ALL HAVING count(DISTINCT pos0) > 1 UNION ALL SELECT 'residue outside its source', path || ':' || CAST(pos0 AS VARCHAR), 1 FROM r WHERE pos0 >= source_size""")


@query()
def g2_copy_resolution(spark, sf_dir):
    g = view(spark, sf_dir, "v_graph").withColumn("node", F.col("site_id") * 10 + F.substring("taxon", 2, 1).cast("long"))
    nodes = g.select("node", "path", F.when(F.col("node") % 7 == 0, F.concat(F.lit("grp"), (F.col("site_id") % 5).cast("string"))).alias("grp"), (F.col("node") % 14 == 0).alias("hard"), F.lit(0.9).alias("confidence"), F.when(F.col("node") % 11 == 0, F.array(F.lit("grp1"))).alias("excluded"))
    near = g.select((F.col("site_id") + F.when(F.col("site_id") % 23 == 0, 1).otherwise(0)).alias("s"), F.col("node").alias("b"), F.col("taxon").alias("t"))
    edges = g.join(near, (F.col("site_id") == F.col("s")) & (F.col("taxon") < F.col("t"))).select(F.xxhash64("node", "b").alias("edge_id"), F.col("node").alias("a"), "b", (F.col("node") % 3).cast("double").alias("score"))
    return copies.resolve(nodes, edges)[0]


@query()
def g3_sites(spark, sf_dir):
    r = view(spark, sf_dir, "v_residue")
    nodes = r.select(F.col("pos0").alias("node"), "path")
    edges = r.select(F.col("pos0").alias("edge_id"), F.col("pos0").alias("a"), (F.col("pos0") + 97).alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    return graph.sites(nodes, edges)


# ---------------------------------------------------------------- chains and alignments


@query()
def c1_global_chain(spark, sf_dir):
    same = view(spark, sf_dir, "v_anchor").where("ref_chr = query_chr")
    return commands.genome_chain(same)


@query()
def c3_quota_chains(spark, sf_dir):
    return quota.chain_quota(anchors.row_ids(view(spark, sf_dir, "v_anchor")))


@query()
def c4_synteny_all_pairs(spark, sf_dir):
    return commands.synteny_blocks(view(spark, sf_dir, "v_pairs"), p=quota.Synteny(all_pairs=True))


@query()
def c5_synteny_quota(spark, sf_dir):
    return commands.synteny_blocks(view(spark, sf_dir, "v_pairs"))


@query()
def c6_synteny_nonstrand_all_pairs(spark, sf_dir):
    return commands.synteny_blocks(view(spark, sf_dir, "v_pairs"), p=quota.Synteny(all_pairs=True, strict=False))


@query()
def c7_synteny_nonstrand_quota(spark, sf_dir):
    return commands.synteny_blocks(view(spark, sf_dir, "v_pairs"), p=quota.Synteny(strict=False, count_members=False, remove_overlap=True))


_NAMES = "SELECT n_nationkey AS k, translate(upper(replace(n_name, ' ', '')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM nation"


@query(f"""WITH RECURSIVE nm AS ({_NAMES}), pr AS (SELECT DISTINCT c_nationkey AS x, c_custkey % 25 AS y FROM customer),
r AS (SELECT x * 100 + y AS id, a.s AS a, b.s AS b, 0 AS i, [CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE greatest(-8 - 2 * j, -75 - j) END for j in range(0, length(b.s) + 1)] AS h, [-1e9::DOUBLE for j in range(0, length(b.s) + 1)] AS f1, [-1e9::DOUBLE for j in range(0, length(b.s) + 1)] AS f2
 FROM pr JOIN nm a ON a.k = x JOIN nm b ON b.k = y
 UNION ALL SELECT id, a, b, i + 1, [greatest(base[j], coalesce(list_max([base[k] + greatest(-8 - 2 * (j - k), -75 - (j - k)) for k in range(1, j)]), -1e9)) for j in range(1, length(b) + 2)], g1, g2 FROM (
  SELECT *, [greatest(CASE WHEN j > 1 THEN h[j - 1] + CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j - 1 AS INT), 1) THEN 0 ELSE -6 END ELSE -1e9 END, g1[j], g2[j]) for j in range(1, length(b) + 2)] AS base FROM (
   SELECT *, [greatest(h[j] - 10, f1[j] - 2) for j in range(1, length(b) + 2)] AS g1, [greatest(h[j] - 76, f2[j] - 1) for j in range(1, length(b) + 2)] AS g2 FROM r WHERE i < length(a))))
SELECT id, h[len(h)] AS score, true AS intact FROM r WHERE i = length(a)""")
def l1_alignment_scores(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.translate(F.upper(F.replace(F.col("n_name"), F.lit(" "), F.lit(""))), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC").alias("s"))
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("x"), (F.col("c_custkey") % 25).alias("y")).distinct()
    pairs = p.join(n.toDF("x", "a"), "x").join(n.toDF("y", "b"), "y").select((F.col("x") * 100 + F.col("y")).alias("id"), "a", "b")
    got = affine.align_pairs(pairs).join(pairs, "id")
    return got.select("id", "score", (affine.intact(F.col("row_a"), F.col("a")) & affine.intact(F.col("row_b"), F.col("b"))).alias("intact"))


@query()
def l1_align_pairs(spark, sf_dir):
    s = view(spark, sf_dir, "v_seq")
    other = s.select((F.col("seq_id") - 1).alias("id"), F.col("seq").alias("b"))
    return affine.align_pairs(s.select(F.col("seq_id").alias("id"), F.col("seq").alias("a")).join(other, "id"))


_CHROMS = "SELECT 'c' || CAST(g AS VARCHAR) AS name, string_agg(seq, '' ORDER BY seq_id) AS seq FROM (SELECT seq_id % 7 AS g, * FROM v_seq) GROUP BY 1"


def _chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts in a row make a chromosome; its chunks are short, so that exons cross their edges."""
    s = view(spark, sf_dir, "v_seq").withColumn("name", F.concat(F.lit("c"), (F.col("seq_id") % 7).cast("string")))
    whole = s.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return sequences.chunked(whole)


def _exons(d: DataFrame) -> DataFrame:
    """Exons brought into the length of those chromosomes."""
    return d.withColumn("end1", F.col("start1") % 2000 + 1 + F.col("end1") - F.col("start1")).withColumn("start1", F.col("start1") % 2000 + 1)


@query(f"""WITH c AS ({_CHROMS}), e AS (SELECT transcript, gene, seqid, strand, line_no, start1 % 2000 + 1 AS start1, start1 % 2000 + 1 + end1 - start1 AS end1 FROM v_feature),
p AS (SELECT e.*, substr(translate(upper(seq), 'RYSWKMBDHVU', 'NNNNNNNNNNT'), CAST(least(greatest(start1, 1), length(seq)) AS INT), CAST(least(greatest(end1, 1), length(seq)) - least(greatest(start1, 1), length(seq)) + 1 AS INT)) AS p FROM e JOIN c ON seqid = name),
t AS (SELECT transcript, any_value(gene) AS gene, string_agg(CASE WHEN strand = '-' THEN translate(reverse(p), 'ATUCGRYKMBVDH', 'TAAGCYRMKVBHD') ELSE p END, '' ORDER BY CASE WHEN strand = '-' THEN -start1 ELSE start1 END, CASE WHEN strand = '-' THEN NULL ELSE p END, CASE WHEN strand = '-' THEN p END DESC) AS seq FROM p GROUP BY 1),
d AS (SELECT gene FROM t WHERE seq IN (SELECT seq FROM t GROUP BY 1 HAVING count(*) > 1))
SELECT gene, transcript, seq FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY length(seq) DESC, seq DESC, transcript DESC) AS k FROM t WHERE gene NOT IN (SELECT gene FROM d)) WHERE k = 1""")
def w1_gff2seq(spark, sf_dir):
    f = view(spark, sf_dir, "v_feature")
    return commands.gff2seq(_chromosomes(spark, sf_dir), _exons(f), f.select("transcript", "gene").distinct())


def _told(frags: DataFrame) -> DataFrame:
    """Where fragments lie, what they spell without gaps, and of those without an alignment the score."""
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    return frags.select("block", "kind", "ref_start", "ref_end", "query_start", "query_end", bare("ref_row").alias("ref"), bare("query_row").alias("query"), (F.char_length("ref_row") == F.char_length("query_row")).alias("even"), F.when((F.col("method") == "FILLING") | (F.col("kind") == "ANCHOR"), F.col("score")).alias("score"))


_FRAGMENTS = """WITH g AS (SELECT 's' || CAST(seq_id AS VARCHAR) AS block, seq AS r, substr(seq, 1, 50) || 'ACGT' || substr(seq, 71) AS q FROM v_seq WHERE length(seq) >= 120),
f AS (SELECT block, r, q, unnest(['GAP', 'ANCHOR', 'GAP', 'ANCHOR', 'TAIL']) AS kind, unnest([1, 11, 41, 81, 111]) AS ref_start, unnest([10, 40, 80, 110, length(r)]) AS ref_end, unnest([1, 11, 41, 65, 95]) AS query_start, unnest([10, 40, 64, 94, length(q)]) AS query_end, unnest([1, 2, 3, 4, 5]) AS k FROM g)
SELECT {0} AS block, kind, CAST(ref_start AS BIGINT) AS ref_start, CAST(ref_end AS BIGINT) AS ref_end, CAST(query_start AS BIGINT) AS query_start, CAST(query_end AS BIGINT) AS query_end, substr(r, CAST(ref_start AS INT), CAST(ref_end - ref_start + 1 AS INT)) AS ref, substr(q, CAST(query_start AS INT), CAST(query_end - query_start + 1 AS INT)) AS query, true AS even, CASE WHEN kind = 'ANCHOR' THEN 0.0::DOUBLE END AS score FROM f WHERE {1}"""


@query(_FRAGMENTS.format("block", "true"))
def l18_chromosome_alignment(spark, sf_dir):
    chain, ref, query_ = _genomes(spark, sf_dir)
    return _told(commands.chromosome_alignment(chain, ref, query_))


@query(_FRAGMENTS.format("block || '_+'", "k BETWEEN 2 AND 4"))
def l17_block_alignment(spark, sf_dir):
    chain, ref, query_ = _genomes(spark, sf_dir)
    return _told(commands.block_alignment(chain.withColumn("block", F.concat_ws("_", "ref_chr", "strand")), ref, query_))


@query("""WITH c AS (SELECT block, unnest(string_split(max(CASE WHEN row = 0 THEN text END), '')) AS x, unnest(string_split(max(CASE WHEN row = 1 THEN text END), '')) AS y, unnest(range(length(max(text)))) AS col FROM v_rows GROUP BY block),
k AS (SELECT *, CASE WHEN x = '-' THEN 1 WHEN y = '-' THEN 2 ELSE 0 END AS side FROM c WHERE NOT (x = '-' AND y = '-')), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY col) - row_number() OVER (PARTITION BY block, side ORDER BY col) AS run FROM k),
g AS (SELECT block, side, run, count(*) AS n, sum(CASE WHEN side = 0 AND x <> y THEN -6 ELSE 0 END) AS pairs FROM r GROUP BY ALL)
SELECT block AS id, CAST(sum(CASE WHEN side = 0 THEN pairs ELSE greatest(-8 - 2 * n, -75 - n) END) AS DOUBLE) AS score FROM g GROUP BY 1""")
def l2_score_of_rows(spark, sf_dir):
    v = view(spark, sf_dir, "v_rows")
    of = lambda k, c: v.where(F.col("row") == k).select(F.col("block").alias("id"), F.col("text").alias(c))
    return affine.score_pairs(of(0, "a").join(of(1, "b"), "id"))


_TOP = """WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS k FROM ({rows})),
f AS (SELECT g, 0 AS k, []::STRUCT(a BIGINT, b BIGINT, c BIGINT, d BIGINT, f DOUBLE)[] AS l FROM (SELECT DISTINCT g FROM m)
 UNION ALL SELECT f.g, m.k, list_append(f.l, {{'a': m.a, 'b': m.b, 'c': m.c, 'd': m.d, 'f': m.score + greatest(0.0::DOUBLE, coalesce(list_max([{gain} for j in f.l if {before}]), 0.0::DOUBLE))}}) FROM f JOIN m ON m.g = f.g AND m.k = f.k + 1)
SELECT g AS name, round(max(list_max([x.f for x in l])), 6) AS score FROM f GROUP BY 1"""


@query(_TOP.format(rows="SELECT 'w' || CAST(line_no // 60 AS VARCHAR) AS g, ref_start AS a, ref_end AS b, query_start AS c, query_end AS d, score, line_no FROM v_anchor WHERE strand = '+'", order="a, b, c, d, line_no", gain="j.f", before="j.b < m.a AND j.d < m.c"))
def c1_best_scores(spark, sf_dir):
    m = view(spark, sf_dir, "v_anchor").where("strand = '+'").withColumn("ref_chr", F.concat(F.lit("w"), F.floor(F.col("line_no") / 60).cast("string")))
    return chains.chain_global(m, 0.0).groupBy(F.col("ref_chr").alias("name")).agg(F.round(F.sum("score"), 6).alias("score"))


@query("""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ref_start, ref_end, query_start, line_no) AS k FROM (SELECT line_no // 60 AS g, * FROM v_anchor)),
f AS (SELECT g, k, line_no, true AS kept, ref_end AS r, query_start AS a, query_end AS b FROM m WHERE k = 1 UNION ALL
 SELECT g, k, line_no, kept, CASE WHEN kept THEN ref_end ELSE r END, CASE WHEN kept THEN query_start ELSE a END, CASE WHEN kept THEN query_end ELSE b END FROM (
  SELECT m.g, m.k, m.line_no, m.ref_start > f.r AND CASE WHEN m.strand = '+' THEN m.query_start > f.b ELSE m.query_end < f.a END AS kept, m.ref_end, m.query_start, m.query_end, f.r, f.a, f.b FROM f JOIN m ON m.g = f.g AND m.k = f.k + 1))
SELECT line_no FROM f WHERE kept""")
def c8_rising_blocks(spark, sf_dir):
    m = view(spark, sf_dir, "v_anchor").withColumn("block", F.floor(F.col("line_no") / 60))
    return commands.rising_blocks(m, ["ref_start", "ref_end", "query_start", "line_no"]).select("line_no")


@query(_TOP.format(rows="SELECT line_no // 60 AS g, ref_start AS a, 0 AS b, query_start AS c, 0 AS d, 1.0 AS score, line_no FROM v_anchor", order="a, c, line_no", gain="j.f", before="j.a < m.a AND j.c < m.c"))
def c10_longest_increasing(spark, sf_dir):
    m = view(spark, sf_dir, "v_anchor").select(F.floor(F.col("line_no") / 60).alias("id"), F.col("ref_start").alias("a"), F.col("query_start").alias("b"))
    return chains.longest_increasing(m).groupBy(F.col("id").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("score"))


@query("""WITH p AS (SELECT a.seq_id AS id, length(a.seq) AS n, length(b.seq) AS m FROM v_seq a JOIN v_seq b ON b.seq_id = a.seq_id + 1 WHERE length(a.seq) > 0 AND length(b.seq) > 0)
SELECT id, CASE WHEN (n + 1) * (m + 1) <= 30000 THEN 'EXACT' ELSE 'BEYOND' END AS tier, true AS intact FROM p""")
def l13_two_tiers(spark, sf_dir):
    s = view(spark, sf_dir, "v_seq").where("seq <> ''")
    pairs = s.select(F.col("seq_id").alias("id"), F.col("seq").alias("a")).join(s.select((F.col("seq_id") - 1).alias("id"), F.col("seq").alias("b")), "id")
    got = affine.align_pairs(pairs, cells=30_000).join(pairs, "id")
    return got.select("id", F.when(F.col("method").isin("EXACT", "FILLING"), "EXACT").otherwise("BEYOND").alias("tier"), (affine.intact(F.col("row_a"), F.col("a")) & affine.intact(F.col("row_b"), F.col("b"))).alias("intact"))


_PLUS = "SELECT 'w' || CAST(line_no // 40 AS VARCHAR) AS g, ref_id AS a, query_id AS b, 0 AS c, 0 AS d, score, ref_start, ref_end, query_start, query_end, line_no FROM v_pairs WHERE strand = '+'"
_STEP = "j.f + CASE WHEN m.a - j.a + m.b - j.b > 2 THEN -0.02 - 0.005 * ((m.a - j.a - 1 + m.b - j.b - 1) / 2) ELSE 0 END"


@query(_TOP.format(rows=_PLUS, order="ref_start, ref_end DESC, query_start, query_end DESC, line_no", gain=_STEP, before="j.a < m.a AND j.b < m.b AND m.a - j.a - 1 <= 25 AND m.b - j.b - 1 <= 25") + " HAVING max(list_max([x.f for x in l])) > 3")
def c4_best_scores(spark, sf_dir):
    p = view(spark, sf_dir, "v_pairs").where("strand = '+'").withColumns({"ref_chr": F.concat(F.lit("w"), F.floor(F.col("line_no") / 40).cast("string")), "query_chr": F.lit("q")})
    return quota.synteny(p, quota.Synteny(all_pairs=True)).where("block = 0").groupBy(F.col("ref_chr").alias("name")).agg(F.round(F.max("block_score"), 6).alias("score"))


def _genomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts as chromosomes, those of two genomes alike but for a piece that is missing in one of them; two anchors each."""
    s = view(spark, sf_dir, "v_seq").where(F.char_length("seq") >= 120).withColumn("name", F.concat(F.lit("s"), F.col("seq_id").cast("string")))
    ref = s.select("name", "seq")
    query_ = s.select("name", F.concat(F.substring("seq", 1, 50), F.lit("ACGT"), F.expr("substring(seq, 71)")).alias("seq"))
    at = [(0, 11, 40, 11, 40), (1, 81, 110, 65, 94)]
    rows = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("pos", "ref_start", "ref_end", "query_start", "query_end"), a)]) for a in at]))
    chain = s.select(F.col("name").alias("ref_chr"), F.col("name").alias("query_chr"), F.lit("+").alias("strand"), rows.alias("r")).select("ref_chr", "query_chr", "strand", "r.*")
    return chain, sequences.chunked(ref), sequences.chunked(query_)


# ---------------------------------------------------------------- alignment evidence and adjacencies

_CELLS = """WITH c AS (SELECT block, row, strand, start0, source_size, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS col FROM v_rows),
n AS (SELECT *, sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block, row ORDER BY col) - 1 AS nth FROM c),
p AS (SELECT block, row, col, ch <> '-' AS present, CAST(CASE WHEN ch <> '-' THEN CASE WHEN strand = '-' THEN source_size - 1 - (start0 + nth) ELSE start0 + nth END END AS BIGINT) AS pos0,
 CASE WHEN ch <> '-' THEN CASE WHEN strand = '-' THEN translate(upper(ch), 'ATUCGRYKMBVDH', 'TAAGCYRMKVBHD') ELSE upper(ch) END END AS base FROM n)"""
_SIZED = "length(replace(text, '-', '')) + CASE WHEN block % 7 = 0 THEN 1 ELSE 0 END"
on("p11_malformed_rows", "v_rows", lambda d: evidence.malformed_rows(d.withColumns({
    "size": F.char_length(F.replace(F.col("text"), F.lit("-"), F.lit(""))) + (F.col("block") % 7 == 0).cast("int"), "strand": F.when(F.col("block") % 5 == 0, "*").otherwise(F.col("strand")),
    "source_size": F.when(F.col("block") % 3 == 0, F.col("start0")).otherwise(F.col("source_size")), "text": F.when(F.col("block") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")),
})),
   f"""SELECT block, row, problem FROM (SELECT block, row, CASE WHEN block % 11 = 0 THEN 'alphabet' WHEN block % 5 = 0 THEN 'strand' WHEN start0 + {_SIZED} > CASE WHEN block % 3 = 0 THEN start0 ELSE source_size END THEN 'interval' WHEN block % 7 = 0 THEN 'size' END AS problem FROM v_rows) WHERE problem IS NOT NULL""")
on("v10_ungapped_coordinate", "v_rows", lambda d: evidence.alignment_columns(d).where("present").groupBy("block", "row").agg(F.sum(F.col("pos0") * (F.col("col") + 1)).alias("check"), F.count(F.lit(1)).alias("n")), _CELLS + ' SELECT block, row, CAST(sum(pos0 * (col + 1)) AS BIGINT) AS "check", count(*) AS n FROM p WHERE present GROUP BY ALL')
on("g1_residues", "v_rows", lambda d: evidence.alignment_columns(d).where("present").select("block", "row", "col", "pos0", "base"), _CELLS + " SELECT block, row, col, pos0, base FROM p WHERE present")
on("g1_homologies", "v_rows", lambda d: evidence.homologies(evidence.alignment_columns(d)),
   _CELLS + " SELECT a.block, a.col, a.pos0 AS left_pos0, b.pos0 AS right_pos0, a.base = b.base AS same FROM p a JOIN p b ON a.block = b.block AND a.col = b.col AND a.row = 0 AND b.row = 1 AND a.present AND b.present")
on("g1_base_conflicts", "v_rows", lambda d: evidence.base_conflicts(evidence.alignment_columns(d)).select("source", "pos0", F.array_join("bases", "").alias("bases")),
   _CELLS + ", s AS (SELECT source, pos0, base FROM p JOIN (SELECT DISTINCT block, row, source FROM v_rows) USING (block, row) WHERE present AND base <> 'N') SELECT source, pos0, string_agg(DISTINCT base, '' ORDER BY base) AS bases FROM s GROUP BY ALL HAVING count(DISTINCT base) > 1")
on("g4_absences", "v_rows", lambda d: evidence.absences(evidence.alignment_columns(d)),
   _CELLS + """, f AS (SELECT *, last_value(pos0 IGNORE NULLS) OVER (PARTITION BY block, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_flank0,
 first_value(pos0 IGNORE NULLS) OVER (PARTITION BY block, row ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_flank0 FROM p)
SELECT block, row, col, left_flank0, right_flank0 FROM f WHERE NOT present AND left_flank0 IS NOT NULL AND right_flank0 IS NOT NULL""")
on("h3_swap_rows", "v_rows", lambda d: evidence.swap_rows(d, 1).select("block", "row", "source", "strand", "text"),
   "SELECT block, CASE WHEN row = 1 THEN 0 ELSE 1 END AS row, source, CASE WHEN strand = '-' THEN '+' ELSE '-' END AS strand, translate(reverse(text), 'ATUCGRYKMBVDH', 'TAAGCYRMKVBHD') AS text FROM v_rows")

def _placed(d: DataFrame) -> DataFrame:
    pairs = anchors.next_on_path(d, ["path"], ["pos0", "site_id"], "site_id").select("site_id", "next").distinct()
    name = F.concat_ws("-", "site_id", "next").alias("block_id")
    blocks = pairs.select(name, F.lit(0).alias("idx"), "site_id").union(pairs.select(name, F.lit(1), F.col("next")))
    return evidence.place_blocks(blocks, d.select("path", F.col("pos0").alias("pos"), "site_id"))


on("g16_block_projection", "v_residue", _placed,
   """WITH p AS (SELECT taxon, path, site_id, lead(site_id) OVER (PARTITION BY path ORDER BY pos0, site_id) AS nx, row_number() OVER (PARTITION BY path ORDER BY pos0, site_id) - 1 AS first FROM v_residue),
b AS (SELECT DISTINCT site_id AS x, nx AS y FROM p WHERE nx IS NOT NULL)
SELECT b.x || '-' || b.y AS block_id, p.path, p.first, CAST(2 AS BIGINT) AS n, CASE WHEN x = y THEN '?' WHEN p.site_id = x THEN '+' ELSE '-' END AS orientation
FROM b JOIN p ON (p.site_id = x AND p.nx = y) OR (p.site_id = y AND p.nx = x)""")


@query("""WITH t AS (SELECT gene AS item, 'grp' || CAST(line_no % 3 AS VARCHAR) AS grp, line_no % 50 = 0 AS hard, CAST(sum(CAST(floor(score * 100) AS BIGINT)) AS DOUBLE) AS s FROM v_match GROUP BY ALL), h AS (SELECT *, bool_or(hard) OVER (PARTITION BY item) AS any_hard FROM t),
k AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nx FROM h WHERE hard = any_hard WINDOW w AS (PARTITION BY item ORDER BY s DESC, grp)), f AS (SELECT *, nx IS NOT NULL AND (hard OR s - nx <= 50 + 1e-12) AS tie FROM k WHERE k = 1)
SELECT item, CASE WHEN NOT tie THEN grp END AS grp, hard, CASE WHEN NOT tie THEN s END AS confidence, CASE WHEN tie AND hard THEN 'INCOMPATIBLE' WHEN tie THEN 'ALTERNATIVES' WHEN hard THEN 'HARD' ELSE 'SOFT' END AS status FROM f""")
def a12_copy_groups(spark, sf_dir):
    m = view(spark, sf_dir, "v_match")
    return copies.choose(m.select(F.col("gene").alias("item"), F.concat(F.lit("grp"), (F.col("line_no") % 3).cast("string")).alias("grp"), F.when(F.col("line_no") % 50 == 0, "hard").otherwise("soft").alias("constraint"), F.floor(F.col("score") * 100).cast("double").alias("confidence")), 50)


on("g7_components", "v_graph", lambda d: components(anchors.next_on_path(d, ["path"], ["pos0"], "site_id"), "site_id", "next"),
   """WITH e AS (SELECT DISTINCT site_id AS a, nx AS b FROM (SELECT site_id, lead(site_id) OVER (PARTITION BY path ORDER BY pos0) AS nx FROM v_graph) WHERE nx IS NOT NULL), n AS (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e),
s AS (SELECT DISTINCT node, node // 500 AS c FROM n) SELECT node, min(node) OVER (PARTITION BY c) AS label FROM s""")
on("j10_path_neighbour", "v_graph", evidence.path_observations,
   "SELECT path, site_id, pos0, base, lead(site_id) OVER w AS next_site, lead(base) OVER w AS next_base FROM v_graph WINDOW w AS (PARTITION BY path ORDER BY pos0)")
on("u4_set_union", "v_residue", lambda d: d.groupBy("site_id").agg(F.size(F.array_union(F.collect_set(F.when(F.col("base") == "A", F.col("taxon"))), F.collect_set(F.when(F.col("base") == "C", F.col("taxon"))))).cast("long").alias("n")),
   "SELECT site_id, count(DISTINCT taxon) FILTER (WHERE base IN ('A', 'C')) AS n FROM v_residue GROUP BY 1")


@query("""WITH r AS (SELECT 'x' || CAST(c_custkey % 5 AS VARCHAR) AS taxon, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 's' || CAST(c_custkey % 50 AS VARCHAR) END AS seq, c_custkey % 130 AS pos0, substr('ACGTRYNX', CAST(c_custkey % 8 AS INT) + 1, 1) AS base, CASE WHEN c_custkey % 50 = 3 THEN c_custkey % 7 ELSE CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE -1 END END AS odd FROM customer),
c AS (SELECT 'x' || CAST(seq_id % 4 AS VARCHAR) AS taxon, 's' || CAST(seq_id AS VARCHAR) AS seq, seq AS bases, length(seq) AS n FROM v_seq WHERE length(seq) > 0),
z AS (SELECT r.*, c.bases, c.n, CASE WHEN odd >= 0 THEN odd ELSE coalesce(c.n, 100) END AS source_size FROM r LEFT JOIN c USING (taxon, seq)), d AS (SELECT taxon, seq, min(source_size) <> max(source_size) AS differ FROM z GROUP BY ALL),
k AS (SELECT z.*, d.differ, greatest(strpos('-ACMGRSVTWYHKDBN', base) - 1, 0) AS mb, substr(bases, CAST(pos0 + 1 AS INT), 1) AS there FROM z JOIN d USING (taxon, seq))
SELECT taxon, seq, pos0, base, CASE WHEN seq = '' THEN 'EVIDENCE_EMPTY_SOURCE_ID' WHEN source_size <= 0 THEN 'EVIDENCE_INVALID_SOURCE_SIZE' WHEN differ THEN 'EVIDENCE_SOURCE_SIZE_CONFLICT' WHEN pos0 >= source_size THEN 'EVIDENCE_POSITION_OUT_OF_RANGE' WHEN mb = 0 THEN 'EVIDENCE_INVALID_BASE'
 WHEN taxon NOT IN (SELECT taxon FROM c) THEN 'MISSING_TAXON_FASTA' WHEN n IS NULL THEN 'FASTA_MISSING_SEQUENCE_ID' WHEN n <> source_size THEN 'FASTA_SOURCE_SIZE_MISMATCH' WHEN greatest(strpos('-ACMGRSVTWYHKDBN', there) - 1, 0) = 0 THEN 'FASTA_INVALID_BASE' WHEN mb & (strpos('-ACMGRSVTWYHKDBN', there) - 1) = 0 THEN 'FASTA_EVIDENCE_BASE_MISMATCH' ELSE 'OK' END AS code FROM k""")
def j11_base_check(spark, sf_dir):
    s = view(spark, sf_dir, "v_seq").where("seq <> ''").select(F.concat(F.lit("x"), (F.col("seq_id") % 4).cast("string")).alias("taxon"), F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("name"), "seq")
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("x"), (k % 5).cast("string")).alias("taxon"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("s"), (k % 50).cast("string"))).alias("seq"), (k % 130).alias("pos0"), F.substring(F.lit("ACGTRYNX"), (k % 8 + 1).cast("int"), F.lit(1)).alias("base"),
        F.when(k % 50 == 3, k % 7).when(k % 23 == 0, 0).alias("odd"),
    )
    sizes = s.select("taxon", F.col("name").alias("seq"), F.char_length("seq").alias("n"))
    residues = r.join(sizes, ["taxon", "seq"], "left").select("taxon", "seq", "pos0", "base", F.coalesce("odd", "n", F.lit(100)).cast("long").alias("source_size"))
    chunks = sequences.chunked(s.select(F.concat_ws("/", "taxon", "name").alias("name"), "seq")).select(F.split_part("name", F.lit("/"), F.lit(1)).alias("taxon"), F.split_part("name", F.lit("/"), F.lit(2)).alias("name"), "chunk", "bases")
    return evidence.check_bases(residues, chunks)


@query("SELECT b.block_id, b.path, r.pos0 FROM v_block b JOIN (SELECT DISTINCT 'x' || CAST(site_id % 4 AS VARCHAR) AS taxon, pos0 * 10 AS pos0 FROM v_residue) r ON b.taxon = r.taxon AND r.pos0 >= b.start0 AND r.pos0 < b.end0")
def j9_interval_residues(spark, sf_dir):
    r = view(spark, sf_dir, "v_residue").select(F.concat(F.lit("x"), (F.col("site_id") % 4).cast("string")).alias("taxon"), (F.col("pos0") * 10).alias("pos0")).distinct()
    return evidence.in_intervals(r, view(spark, sf_dir, "v_block").select("taxon", "path", "block_id", "start0", "end0"), ["taxon"]).select("block_id", "path", "pos0")


@query("""WITH t AS (SELECT pos0, 'locusframe-v1|' || length(taxon) || ':' || taxon || '|' || length(path) || ':' || path || '|' || length(CAST(pos0 AS VARCHAR)) || ':' || CAST(pos0 AS VARCHAR) AS x FROM v_residue),
h AS (SELECT pos0, list_reduce(list_prepend(14695981039346656037::HUGEINT, [CAST(ord(c) AS HUGEINT) for c in string_split(x, '')]), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h FROM t)
SELECT pos0, 'site_' || lpad(lower(printf('%x', CAST(h AS UBIGINT))), 16, '0') AS id FROM h""")
def f7_stable_id(spark, sf_dir):
    return view(spark, sf_dir, "v_residue").select("pos0", evidence.stable_id("site", F.col("taxon"), F.col("path"), F.col("pos0")).alias("id"))


@query()
def h6_cigar_segments(spark, sf_dir):
    return evidence.cigar_segments(view(spark, sf_dir, "v_sam").select(F.col("line_no").alias("id"), F.translate("cigar", "M", "=").alias("cigar")))


@query()
def j7_local_map(spark, sf_dir):
    s = view(spark, sf_dir, "v_seq")
    return mapping.local_map(s.select(F.col("seq_id").alias("id"), F.col("seq").alias("ref"), F.concat(F.repeat(F.lit("ACGGT"), F.lit(6)), F.substring("seq", F.lit(21), F.lit(90))).alias("query")))
