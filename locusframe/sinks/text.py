"""Writers: tables as lines of text, ordered by a key; Spark's commit protocol makes each write all or nothing.

Each function gives rows with a column ``line`` and the columns that put them in order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.exprs import method_label, tsv_clean
from locusframe.operators.anchors import block_summary
from locusframe.operators.quota import LOCAL


def _tsv(*cols: Column, null: str = "NA") -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(null)) for c in cols])


def _all(*names: str, null: str = "NA") -> Column:
    return _tsv(*map(F.col, names), null=null)


def write_lines(lines: DataFrame, path: str, order: list[str], head: Iterable[str] = ()) -> None:
    """Lines in range partitions of ``order``, so the parts in turn are the whole file; ``head`` lines come first."""
    first = list(head)
    rows = lines.orderBy(*order).select("line")
    if first:
        top = lines.sparkSession.range(1).select(F.lit("\n".join(first)).alias("line"))
        rows = top.coalesce(1).union(rows)
    rows.write.mode("errorifexists").text(path)


def at_least_one(lines: DataFrame, what: str) -> DataFrame:
    """``lines``, or an error if there are none."""
    if lines.isEmpty():
        raise ValueError(f"no {what} to write")
    return lines


def fasta_lines(seqs: DataFrame, width: int | None = None) -> DataFrame:
    """(gene, transcript, seq) -> records by gene, a sequence on one line or wrapped at ``width``."""
    body = F.col("seq") if width is None else F.array_join(F.regexp_extract_all("seq", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    return seqs.select("gene", F.concat(F.lit(">"), "transcript", F.lit(" "), "gene", F.lit("\n"), body).alias("line"))


def record_lines(rows: DataFrame) -> DataFrame:
    """(ord, name, row) -> gapped records."""
    return rows.select("ord", F.concat(F.lit(">"), "name", F.lit("\n"), "row").alias("line"))


ANCHOR_HEAD = "\t".join("refChr referenceStart referenceEnd queryChr queryStart queryEnd strand gene blockIndex score".split())


def anchor_lines(chain: DataFrame, gaps: DataFrame, ref_length: DataFrame | None = None, query_length: DataFrame | None = None) -> DataFrame:
    """Anchors and what lies between them (``interanchor``, score NA), by block and reference start.

    chain: block, match columns; gaps: block and what inter_anchor_gaps gives, with ref_chr and query_chr. With lengths (name,
    length) a block without a minus anchor also tells of what lies behind its last one (W2).
    """
    score = F.when(F.col("gene").contains(LOCAL), "NA").otherwise(F.col("score").cast("string"))
    a = chain.select("block", F.col("ref_start").alias("at"), _tsv(*map(F.col, ("ref_chr", "ref_start", "ref_end", "query_chr", "query_start", "query_end", "strand", "gene", "block")), score).alias("line"))
    between = lambda rows: rows.select("block", F.col("gap_ref_start").alias("at"), _tsv(*map(F.col, ("ref_chr", "gap_ref_start", "gap_ref_end", "query_chr", "gap_query_start", "gap_query_end", "strand")), F.lit("interanchor"), F.col("block"), F.lit("NA")).alias("line"))
    lines = a.unionByName(between(gaps))
    marks = chain.groupBy("block").agg(F.min("ref_start").alias("lo"), F.max("ref_end").alias("hi"), F.max_by(F.struct("ref_chr", "query_chr", "query_end"), "ref_end").alias("last"), F.max((F.col("strand") == "-").cast("int")).alias("minus"))
    if ref_length is not None:
        r, q = ref_length.select(F.col("name").alias("ref_chr"), F.col("length").alias("rl")), query_length.select(F.col("name").alias("query_chr"), F.col("length").alias("ql"))
        tail = marks.where("minus = 0").select("block", "hi", "last.*").join(r, "ref_chr").join(q, "query_chr")
        tail = tail.select("block", "ref_chr", "query_chr", F.lit("+").alias("strand"), (F.col("hi") + 1).alias("gap_ref_start"), F.col("rl").alias("gap_ref_end"), (F.col("query_end") + 1).alias("gap_query_start"), F.col("ql").alias("gap_query_end"))
        lines = lines.unionByName(between(tail))
    begin = marks.select("block", (F.col("lo") - 1).alias("at"), F.lit("#block begin").alias("line"))
    end = marks.select("block", F.lit(2**62).alias("at"), F.lit("#block end").alias("line"))
    return lines.unionByName(begin).unionByName(end)


SYNTENY_HEAD = "\t".join("refGene refChr refId referenceStart referenceEnd queryGene queryChr queryId queryStart queryEnd strand score".split())


def synteny_lines(blocks: DataFrame) -> DataFrame:
    """Blocks of :func:`locusframe.operators.quota.synteny`: a line that tells of each block, numbered from 1, then its members."""
    top = block_summary(blocks, ["block", "block_score", "ref_chr", "query_chr"])
    head = top.select("block", F.lit(-1).cast("long").alias("pos"), F.concat_ws("\t", F.lit("##Alignment"), (F.col("block") + 1).cast("string"), F.concat(F.lit("N="), F.col("n").cast("string")), F.concat(F.lit("score="), F.format_string("%s", "block_score")), F.concat("ref_chr", F.lit("&"), "query_chr"), "direction").alias("line"))
    names = "ref_gene ref_chr ref_id ref_start ref_end query_gene query_chr query_id query_start query_end strand score".split()
    return head.unionByName(blocks.select("block", "pos", _all(*names).alias("line")))


def maf_lines(rows: DataFrame, order: list[str], width: int = 20) -> DataFrame:
    """Aligned fragments or whole blocks (ref_chr, query_chr, strand, ends, rows, score, ref_size, query_size) -> a block of lines each.

    Starts count from 0; on the minus strand the query's counts from the other end of its sequence.
    """
    n = lambda s: F.greatest(F.col(f"{s}_end") - F.col(f"{s}_start") + 1, F.lit(0))
    start = F.when(F.col("strand") == "-", F.col("query_size") - n("query") - (F.col("query_start") - 1)).otherwise(F.col("query_start") - 1)
    pad = lambda c: F.rpad(c, F.greatest(F.lit(width), F.char_length(c)), F.lit(" "))
    nine = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(9), F.char_length(c.cast("string"))), F.lit(" "))
    row = lambda name, at, size, strand, total, text: F.concat_ws("\t", F.lit("s"), pad(F.col(name)), nine(at), nine(size), strand, total.cast("string"), text)
    return rows.select(
        *order,
        F.concat(
            F.lit("a\tscore="), F.col("score").cast("long").cast("string"), F.lit("\n"),
            row("ref_chr", F.col("ref_start") - 1, n("ref"), F.lit("+"), F.col("ref_size"), F.col("ref_row")), F.lit("\n"),
            row("query_chr", start, n("query"), F.col("strand"), F.col("query_size"), F.col("query_row")), F.lit("\n"),
        ).alias("line"),
    )


def bed_lines(fragments: DataFrame) -> DataFrame:
    """Where each aligned fragment lies and by which method; a fill between anchors has score 0."""
    score = F.when(F.col("method") == "FILLING", F.lit(0)).otherwise(F.col("score").cast("long"))
    return fragments.select("ref_chr", "ref_start", _tsv(F.col("ref_chr"), F.col("ref_start") - 1, F.col("ref_end"), method_label(F.col("method")), score, F.col("strand"), F.col("query_chr"), F.col("query_start") - 1, F.col("query_end")).alias("line"))


def bed_head(scores: object, command: str) -> list[str]:
    """The lines before the methods of whole chromosomes."""
    return [f"#command: {command}", f"#scores: {scores}", "#start0, end0: half-open, forward", "#FILLING: one side has no bases, or nothing but N", "#columns:", "#" + "\t".join("refChr start0 end0 method score strand queryChr queryStart0 queryEnd0".split())]


def _allele(site: Column, base: Column) -> Column:
    return F.concat_ws("_", site.cast("string"), base)


def gfa_lines(residues: DataFrame, sites: DataFrame, core_hash: str) -> DataFrame:
    """GFA 1.1: an S line for each base of a site, a P line for each run of consecutive positions of a path, an L line for each pair of neighbours.

    residues as in :mod:`locusframe.operators.ancestry`; sites: site_id, consistency, copy_group (null if not resolved).
    """
    from locusframe.operators.ancestry import path_segments

    head = residues.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(f"H\tVN:Z:1.1\tCH:Z:{core_hash}").alias("line"))
    alleles = residues.select("site_id", "base").distinct().join(sites, "site_id")
    node = _allele(F.col("site_id"), F.col("base"))
    tags = F.concat(F.lit("\tSI:Z:"), F.col("site_id").cast("string"), F.lit("\tCL:Z:"), "consistency", F.coalesce(F.concat(F.lit("\tCG:Z:"), tsv_clean(F.col("copy_group"))), F.lit("")))
    s = alleles.select(F.lit(1).alias("part"), node.alias("key"), F.concat(_tsv(F.lit("S"), node, F.col("base")), tags).alias("line"))
    seg = path_segments(residues)
    on = residues.join(seg, "path").where("pos0 between first and last").select("path", "first", "last", "taxon", "sequence", "pos0", node.alias("node"))
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos0", "node"))), lambda x: F.concat(x["node"], F.lit("+"))), ",")
    name = F.concat_ws(":", "path", "first")
    p = on.groupBy("path", "first", "last").agg(F.first("taxon").alias("taxon"), F.first("sequence").alias("sequence"), steps.alias("steps")).select(
        F.lit(2).alias("part"), name.alias("key"), F.concat(_tsv(F.lit("P"), name, F.col("steps"), F.lit("*")), F.lit("\tTX:Z:"), "taxon", F.lit("\tSN:Z:"), "sequence", F.lit("\tSO:i:"), F.col("first").cast("string"), F.lit("\tEO:i:"), (F.col("last") + 1).cast("string")).alias("line")
    )
    after = on.select("path", (F.col("pos0") - 1).alias("pos0"), F.col("node").alias("next"))
    links = on.join(after, ["path", "pos0"]).select("node", "next").distinct()
    edges = links.select(F.lit(3).alias("part"), F.concat_ws(">", "node", "next").alias("key"), _tsv(F.lit("L"), F.col("node"), F.lit("+"), F.col("next"), F.lit("+"), F.lit("0M")).alias("line"))
    return head.union(s).union(p).union(edges)


METADATA_HEAD = "\t".join("site_id allele_node_id taxon occurrence_path sequence position0 source_size state base copy_group consistency".split())


def metadata_lines(residues: DataFrame, absent: DataFrame, sites: DataFrame) -> DataFrame:
    """A row for each base and each aligned absence of a site."""
    a = residues.join(sites, "site_id").select("site_id", "path", _tsv(F.col("site_id"), _allele(F.col("site_id"), F.col("base")), *map(F.col, ("taxon", "path", "sequence", "pos0", "source_size")), F.lit("OBSERVED_BASE"), F.col("base"), F.col("copy_group"), F.col("consistency"), null=".").alias("line"))
    dot = F.lit(".")
    b = absent.select("site_id", "path").distinct().join(sites, "site_id").select("site_id", "path", _tsv(F.col("site_id"), dot, dot, F.col("path"), dot, dot, dot, F.lit("ALIGNED_ABSENCE"), F.lit("-"), F.col("copy_group"), F.col("consistency"), null=".").alias("line"))
    return a.union(b)


def projection_lines(rows: DataFrame) -> DataFrame:
    """Rows of :func:`locusframe.operators.ancestry.projections`, a block of lines for each run."""
    one = F.concat_ws("\t", F.lit("s"), "sequence", F.col("start0").cast("string"), F.col("size").cast("string"), F.lit("+"), F.col("source_size").cast("string"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("path"), one.alias("l")))), lambda x: x["l"])
    return rows.groupBy("comp", "run").agg(parts.alias("ps")).select("comp", "run", F.concat(F.lit("a graph_component="), F.col("comp").cast("string"), F.lit("\n"), F.array_join("ps", "\n"), F.lit("\n")).alias("line"))


def omission_lines(left_out: DataFrame) -> DataFrame:
    """What was left out and why."""
    return left_out.select("comp", "run", _all("comp", "run", "reason", "sites", null=".").alias("line"))


def table_lines(rows: DataFrame, key: list[str]) -> DataFrame:
    """Any table as cleaned columns in their order; arrays joined by commas, null as a dot."""
    cell = lambda c, t: F.array_join(F.col(c), ",") if t.startswith("array") else tsv_clean(F.col(c).cast("string"))
    return rows.select(*key, _tsv(*[cell(c, t) for c, t in rows.dtypes], null=".").alias("line"))


def ancestor_lines(sequences: DataFrame, width: int = 80) -> DataFrame:
    """(block, length, sequence) as records wrapped at ``width``."""
    body = F.array_join(F.regexp_extract_all("sequence", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    return sequences.select("block", F.concat(F.lit(">"), "block", F.lit(" length="), F.col("length").cast("string"), F.lit("\n"), body).alias("line"))


def child_lines(rows: DataFrame) -> DataFrame:
    """Rows of :func:`locusframe.operators.ancestry.children`: the ancestor's row, then each child's; one without bases is an ``e`` row."""
    s = F.concat_ws("\t", F.lit("s"), "sequence", F.col("child_start0").cast("string"), F.col("child_size").cast("string"), F.lit("+"), F.col("source_size").cast("string"), "child_text")
    e = F.concat_ws("\t", F.lit("e"), "sequence", F.col("child_start0").cast("string"), F.lit("0"), F.lit("+"), F.col("source_size").cast("string"), F.lit("I"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("path"), F.when(F.col("child_size") > 0, s).otherwise(e).alias("l")))), lambda x: x["l"])
    top = F.concat_ws("\t", F.lit("s"), F.concat(F.lit("ancestor."), "block"), F.col("start0").cast("string"), F.col("size").cast("string"), F.lit("+"), F.col("size").cast("string"), "text")
    return rows.groupBy("block", "start0", "size", "text").agg(parts.alias("ps")).select("block", "start0", F.concat(F.lit("a\n"), top, F.lit("\n"), F.array_join("ps", "\n"), F.lit("\n")).alias("line"))


def trace_lines(fragments: DataFrame) -> DataFrame:
    """One row for each alignment that was made: where, how large, by which method, to what score."""
    n = lambda s: F.greatest(F.col(f"{s}_end") - F.col(f"{s}_start") + 1, F.lit(0))
    rows = fragments.select("block", "sub", "ord", "kind", "ref_chr", "ref_start", "ref_end", "query_chr", "query_start", "query_end", "strand", n("ref").alias("ref_bases"), n("query").alias("query_bases"), (n("ref") * n("query")).alias("cells"), "method", method_label(F.col("method")).alias("label"), "score", F.char_length("ref_row").alias("columns"))
    return table_lines(rows, ["block", "sub", "ord"])


def block_sizes(rows: DataFrame, ref_length: DataFrame, query_length: DataFrame) -> DataFrame:
    """``rows`` with the sizes of their sequences, for :func:`maf_lines`."""
    r, q = ref_length.select(F.col("name").alias("ref_chr"), F.col("length").alias("ref_size")), query_length.select(F.col("name").alias("query_chr"), F.col("length").alias("query_size"))
    return rows.join(r, "ref_chr").join(q, "query_chr")


def numbered_blocks(chain: DataFrame) -> DataFrame:
    """``chain`` with blocks numbered from 1 in the order of their names."""
    names = chain.select("block").distinct()
    return chain.join(names.select("block", F.dense_rank().over(Window.orderBy("block")).alias("n")), "block").drop("block").withColumnRenamed("n", "block")
