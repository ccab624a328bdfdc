"""Genomic views over the star-schema tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.orders import dense_ids

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # Anchors; keys give coordinates
    "v_match": """SELECT 'R' || CAST(l_suppkey % 5 AS VARCHAR(9)) AS ref_chr, 'Q' || CAST(l_linenumber % 3 AS VARCHAR(9)) AS query_chr,
 l_orderkey * 50 AS ref_start, l_orderkey * 50 + CAST(floor(l_quantity) AS BIGINT) AS ref_end,
 l_partkey * 50 + l_linenumber AS query_start, l_partkey * 50 + l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS query_end,
 CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, 1 - l_discount AS score,
 'g' || CAST(l_partkey AS VARCHAR(19)) AS gene, l_orderkey * 10 + l_linenumber AS line_no FROM lineitem""",
    # T6 with the ids that an input would bring
    "v_ranked": """SELECT *, CAST(dense_rank() OVER (PARTITION BY ref_chr ORDER BY ref_start) AS INT) AS ref_id, CAST(dense_rank() OVER (PARTITION BY query_chr ORDER BY query_start) AS INT) AS query_id FROM v_match""",
    # T6 of fewer copies: some genes have one copy a chromosome, some two that score alike, some two that don't
    "v_copies": """SELECT 'Q' || CAST(o_custkey % 3 AS VARCHAR(9)) AS query_chr, 'R' || CAST(o_orderkey % 5 AS VARCHAR(9)) AS ref_chr, o_orderkey * 100 AS ref_start, o_orderkey * 100 + 60 AS ref_end,
 o_custkey * 900 + o_orderkey % 7 AS query_start, o_custkey * 900 + o_orderkey % 7 + 40 AS query_end, o_orderkey * 100 AS p_start, o_orderkey * 100 + 30 + (o_orderkey % 5) * 900 AS p_end, '+' AS strand,
 CASE WHEN o_orderkey % 4 = 0 THEN 0.99E0 ELSE 1 - (o_custkey % 30) / 40.0E0 END AS score, 'g' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS VARCHAR(19)) AS gene, o_orderkey AS line_no FROM orders""",
    # Transcripts with the content of their spliced sequence, which some share
    "v_tx": """SELECT 't' || CAST(c_custkey AS VARCHAR(19)) AS transcript, 'g' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(19)) AS gene,
 's' || CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 35 ELSE c_custkey + 1000 END AS VARCHAR(19)) AS seq FROM customer""",
    # T6 again: anchors of two genomes that are collinear but for inverted stretches and scattered genes
    "v_anchor": """SELECT 'R' || CAST(CAST(floor(o_orderkey / 2000) AS BIGINT) % 5 AS VARCHAR(9)) AS ref_chr,
 'R' || CAST(CAST(floor((CASE WHEN o_custkey % 7 = 0 THEN o_custkey * 13 ELSE o_orderkey END) / 2000) AS BIGINT) % 5 AS VARCHAR(9)) AS query_chr,
 o_orderkey * 100 AS ref_start, o_orderkey * 100 + 60 AS ref_end,
 CASE WHEN o_custkey % 7 = 0 THEN o_custkey * 1300 WHEN CAST(floor(o_orderkey / 200) AS BIGINT) % 4 = 1 THEN (o_orderkey - o_orderkey % 200 + 199 - o_orderkey % 200) * 100 ELSE o_orderkey * 100 END AS query_start,
 CASE WHEN o_custkey % 7 = 0 THEN o_custkey * 1300 WHEN CAST(floor(o_orderkey / 200) AS BIGINT) % 4 = 1 THEN (o_orderkey - o_orderkey % 200 + 199 - o_orderkey % 200) * 100 ELSE o_orderkey * 100 END + 60 AS query_end,
 CASE WHEN CAST(floor(o_orderkey / 200) AS BIGINT) % 4 = 1 THEN '-' ELSE '+' END AS strand, 1 - (o_custkey % 20) / 100.0E0 AS score,
 'g' || CAST(o_orderkey AS VARCHAR(19)) AS gene, o_orderkey AS line_no FROM orders""",
    # Homologous pairs with gene order ids on both sides
    "v_pairs": """SELECT gene AS ref_gene, ref_chr, CAST(dense_rank() OVER (PARTITION BY ref_chr ORDER BY ref_start) AS INT) AS ref_id, ref_start, ref_end,
 'h' || CAST(query_start AS VARCHAR(19)) AS query_gene, query_chr, CAST(dense_rank() OVER (PARTITION BY query_chr ORDER BY query_start) AS INT) AS query_id, query_start, query_end,
 strand, score, line_no FROM v_anchor""",
    # Exons; a part is a transcript, a brand a gene
    "v_feature": """SELECT 'c' || CAST(p_size % 7 AS VARCHAR(9)) AS seqid, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
 l_orderkey * 40 + l_linenumber AS start1, l_orderkey * 40 + l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS end1,
 't' || CAST(p_partkey AS VARCHAR(19)) AS transcript, p_brand AS gene, l_orderkey * 10 + l_linenumber AS line_no
 FROM part JOIN lineitem ON p_partkey = l_partkey""",
    # Alignments of reads, events as records
    "v_sam": """SELECT event_id AS line_no, 't' || CAST(user_id AS VARCHAR(19)) AS qname,
 CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 16 ELSE 32 END + CAST(event_id % 2 AS INT) * 2048 AS flag,
 'c' || CAST(event_id % 7 AS VARCHAR(9)) AS rname, event_id * 100 + 1 AS pos1,
 CAST(event_id % 4 AS VARCHAR(9)) || 'S' || CAST(20 + event_id % 13 AS VARCHAR(9)) || 'M' || CAST(1 + event_id % 5 AS VARCHAR(9)) || 'D'
 || CAST(7 + event_id % 3 AS VARCHAR(9)) || 'M' || CASE WHEN event_id % 3 = 0 THEN '2H' ELSE '' END AS cigar FROM events""",
    # Texts as bases
    "v_seq": """SELECT item_id AS seq_id, translate(upper(regexp_replace(text, '[^A-Za-z]', ''{g})),
 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAN') AS seq FROM benchmark""",
    # Two rows of an alignment, the second on the minus strand
    "v_rows": """SELECT item_id AS block, 0 AS row, 'r' AS source, CAST(item_id * 10 AS BIGINT) AS start0, '+' AS strand, CAST(5000 AS BIGINT) AS source_size,
 replace(translate(upper(regexp_replace(text, '[^A-Za-z]', ''{g})), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC'), 'AC', '--') AS text FROM benchmark
 UNION ALL SELECT item_id, 1, 'q', CAST(item_id * 7 AS BIGINT), '-', CAST(9000 AS BIGINT),
 replace(translate(upper(regexp_replace(text, '[^A-Za-z]', ''{g})), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC'), 'GT', '--') FROM benchmark""",
    # projections of structural blocks: three taxa, the same order of blocks but for stretches turned around, left out or doubled
    "v_projection": """SELECT 'j' || CAST(k AS VARCHAR(9)) || '_' || CAST(c_custkey AS VARCHAR(19)) AS projection_id, 'x' || CAST(k AS VARCHAR(9)) AS taxon, 'p' || CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS VARCHAR(9)) AS path,
 'b' || CAST(CASE WHEN c_custkey % 37 = 5 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR(19)) AS block_id, CASE WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 5 = k THEN c_custkey - c_custkey % 10 + 9 - c_custkey % 10 ELSE c_custkey END * 100 AS start0,
 CASE WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 5 = k THEN c_custkey - c_custkey % 10 + 9 - c_custkey % 10 ELSE c_custkey END * 100 + CASE WHEN c_custkey % 53 = 7 THEN 130 ELSE 80 END AS end0,
 CASE WHEN c_custkey % 29 = 3 THEN '?' WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 5 = k THEN '-' ELSE '+' END AS orientation
 FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks WHERE c_custkey % 13 <> k""",
    # variants
    "v_variant": """SELECT o_orderkey AS pos, substr('ACGTTGCA', CAST(o_orderkey % 5 AS INT) + 1, CAST(o_custkey % 3 AS INT) + 1) AS ref,
 substr('ACGTTGCA', CAST(o_orderkey % 5 AS INT) + 1, 1) || substr('GATTACA', CAST(o_custkey % 4 AS INT) + 1, CAST(o_orderkey % 3 AS INT)) AS alt,
 'c' || CAST(o_custkey % 3 AS VARCHAR(9)) AS chrom FROM orders""",
    # What three leaves show at a site
    "v_site": """SELECT c_custkey AS site_id, substr('ACGTMRWN', CAST(c_custkey % 8 AS INT) + 1, 1) AS a, substr('ACGT', CAST(c_nationkey % 4 AS INT) + 1, 1) AS b,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS VARCHAR(1)) ELSE substr('TGCA', CAST(c_custkey % 4 AS INT) + 1, 1) END AS c FROM customer""",
    # Residues of taxa on paths
    "v_residue": """SELECT 'x' || CAST(n_regionkey AS VARCHAR(9)) AS taxon, n_name AS path, c_custkey AS pos0, c_custkey % 97 AS site_id,
 substr('ACGT', CAST(c_custkey % 4 AS INT) + 1, 1) AS base FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # the sites of a graph: three taxa with two paths each, most on one diagonal; and the paths that alignments show to lack a site
    "v_graph": """SELECT c_custkey AS site_id, 'x' || CAST(k AS VARCHAR(9)) AS taxon, 'x' || CAST(k AS VARCHAR(9)) || '|c' || CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS VARCHAR(9)) AS path, 'c' || CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS VARCHAR(9)) AS sequence,
 c_custkey % 500 + k AS pos0, CAST(600 AS BIGINT) AS source_size, substr('ACGT', CAST((c_custkey + CASE WHEN c_custkey % 17 = k THEN 1 ELSE 0 END) % 4 AS INT) + 1, 1) AS base
 FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks WHERE c_custkey % 11 <> k + 3""",
    "v_absent": """SELECT c_custkey AS site_id, 'x' || CAST(k AS VARCHAR(9)) AS taxon, 'x' || CAST(k AS VARCHAR(9)) || '|c' || CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS VARCHAR(9)) AS path
 FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS ks WHERE c_custkey % 11 = k + 3 AND c_custkey % 2 = 0""",
    # placed blocks, each with an id of its own
    "v_block": """SELECT 'x' || CAST(c_nationkey % 4 AS VARCHAR(9)) AS taxon, 'p' || CAST(c_nationkey % 3 AS VARCHAR(9)) AS path, 'b' || CAST(c_custkey % 60 AS VARCHAR(9)) AS block_id,
 c_custkey * 10 AS start0, c_custkey * 10 + 5 + c_custkey % 9 AS end0, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS orientation, 'j' || CAST(c_custkey AS VARCHAR(19)) AS projection_id FROM customer""",
}


def _needed(sql: str) -> list[str]:
    """The views that ``sql`` names and those that they name, each after what it needs."""
    found: list[str] = []
    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            found += [x for x in (*_needed(VIEWS[v]), v) if x not in found]
    return found


def duck(sql: str) -> str:
    """``sql`` with the views it names, for DuckDB."""
    head = ", ".join(f"{v} AS ({VIEWS[v].replace('{g}', ", 'g'")})" for v in _needed(sql))
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the parquet tables of ``sf_dir``. Ids that SQL finds in a window over a chromosome are found in ranges."""
    if name in ("v_ranked", "v_pairs"):
        ids = dense_ids(view(spark, sf_dir, "v_match" if name == "v_ranked" else "v_anchor"), {"ref_id": ("ref_chr", "ref_start"), "query_id": ("query_chr", "query_start")})
        if name == "v_ranked":
            return ids
        return ids.select(F.col("gene").alias("ref_gene"), "ref_chr", "ref_id", "ref_start", "ref_end", F.concat(F.lit("h"), F.col("query_start").cast("string")).alias("query_gene"), "query_chr", "query_id", "query_start", "query_end", "strand", "score", "line_no")
    needed = _needed(VIEWS[name])
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    sql = (f"WITH {head} " if head else "") + VIEWS[name]
    sql = sql.replace("{g}", "")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql))
