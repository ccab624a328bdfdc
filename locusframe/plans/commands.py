"""The reference's commands as builders of DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.exprs import normalise_bases, reverse_complement
from locusframe.operators import affine, anchors, assembly, chains, mapping, quota
from locusframe.operators.sequences import fetch, lengths, oriented
from locusframe.plans.runtime import cut, ship


def spliced(features: DataFrame, chunks: DataFrame) -> DataFrame:
    """A3: (transcript, seq): exons joined, ascending on plus, each turned around and descending on minus. chunks: (name, chunk, bases)."""
    rows = features.select("seqid", "transcript", "strand", "start1", "end1", "line_no")
    numbered = cut(rows.withColumn("id", F.monotonically_increasing_id()), "exons")
    pieces = fetch(numbered.select("id", F.col("seqid").alias("name"), "start1", "end1"), chunks)
    return joined(numbered.join(pieces, "id").select("transcript", "strand", "start1", "line_no", F.col("bases").alias("piece")))


def joined(pieces: DataFrame) -> DataFrame:
    """(transcript, seq) from (transcript, strand, start1, line_no, piece): one transcript's pieces, some dozens, in order."""
    parts = pieces.groupBy("transcript").agg(F.min_by("strand", "line_no").alias("strand"), F.array_sort(F.collect_list(F.struct("start1", "piece"))).alias("ps"))
    seq = F.array_join(F.transform("ps", lambda p: p["piece"]), "")
    return parts.select("transcript", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"))


def longest_unique(tx: DataFrame) -> DataFrame:
    """(gene, transcript, seq) of the longest transcript, genes with a repeated sequence aside; of equals the larger sequence, then name."""
    kept = anchors.without_genes(tx, anchors.duplicate_genes(tx))
    best = F.max(F.struct(F.char_length("seq").alias("n"), F.col("seq").alias("seq"), F.col("transcript").alias("transcript")))
    return kept.groupBy("gene").agg(best.alias("m")).select("gene", "m.transcript", "m.seq")


def gff2seq(chunks: DataFrame, features: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, transcript, seq): the longest transcript of each gene; genes with a sequence that two transcripts have are left out."""
    return longest_unique(spliced(features, chunks).join(genes, "transcript"))


def synteny_blocks(pairs: DataFrame, tandem: int = 0, width: int = 1, p: quota.Synteny = quota.Synteny(), run: str | None = None) -> DataFrame:
    """Synteny blocks of homologous pairs: tandem filter, near pairs collapsed, blocks chained under the quotas (or, with ``p.all_pairs``, each pair of chromosomes for itself)."""
    rows = anchors.tandem_filter(pairs, tandem) if tandem else pairs
    return quota.synteny(anchors.collapse_near_pairs(rows, width) if width else rows, p, run)


def rising_blocks(chained: DataFrame, order: list[str]) -> DataFrame:
    """C8 for each block: matches that come strictly after the last kept one, with their place ``pos``."""
    ship(chained.sparkSession)
    columns = [c for c in chained.columns if c != "pos"]
    rows = chained.select(*columns, *([] if "pos" not in chained.columns else ["pos"]))
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*columns).dtypes) + ", pos long"

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(chains.monotone(pdf.sort_values(order).to_dict("records")), columns=pdf.columns)
        return got[columns].assign(pos=range(len(got)))

    return rows.groupBy(*[c for c in ("run", "block") if c in columns]).applyInPandas(clean, schema)


def quota_chain(match: DataFrame, p: quota.Chaining = quota.Chaining(), run: str | None = None) -> DataFrame:
    """Quota anchors of two genomes: admitted pairs of chromosomes, ids on both sides, chains under the quotas, each cleaned up to rise."""
    return rising_blocks(quota.chain_quota(anchors.row_ids(anchors.admitted(match)), p, run), ["pos"])


def genome_chain(match: DataFrame, least: float = 2.0, penalty: float = 1.0) -> DataFrame:
    """The anchors of whole chromosomes: chromosome pairs of three matches and more, chained end to end."""
    return chains.chain_global(anchors.admitted(match), least, penalty)


def genome_anchors(match: DataFrame, ref: DataFrame, query: DataFrame, inversions: bool = True, least: float = 2.0, penalty: float = 1.0, side: int = 50_000) -> DataFrame:
    """The anchors of whole chromosomes, with new ones: matches within chromosomes of one name chained end to end, new ones found in their large gaps (C9), and all
    chained again. ref, query: (name, chunk, bases)."""
    first = genome_chain(anchors.same_chromosome(match, inversions), least, penalty)
    more = novel_anchors(first.withColumn("block", F.col("ref_chr")), ref, query, side)
    return chains.chain_global(more, least, penalty)


def quota_anchors(match: DataFrame, ref: DataFrame, query: DataFrame, p: quota.Chaining = quota.Chaining(), side: int = 50_000) -> DataFrame:
    """Quota anchors of two genomes, with new ones: blocks under the quotas, new anchors found in their large gaps (C9), and each block cleaned up to rise again."""
    more = novel_anchors(quota_chain(match, p), ref, query, side)
    return rising_blocks(more, ["ref_start", "ref_end", "query_start", "line_no"])


def block_alignment(chain: DataFrame, ref: DataFrame, query: DataFrame, scores: affine.Scores = affine.Scores(0, -4, -4, -2, -80, -1), cells: int = 4_000_000) -> DataFrame:
    """From anchors of blocks (``block``, ``pos``) on: the aligned fragments of each block (L17). ref, query: (name, chunk, bases)."""
    return assembly.aligned(assembly.fragments(chain), ref, query, scores, cells)


def chromosome_alignment(chain: DataFrame, ref: DataFrame, query: DataFrame, scores: affine.Scores = affine.Scores(), cells: int = 4_000_000) -> DataFrame:
    """From anchors of whole chromosomes (``ref_chr``, ``pos``) on: the aligned fragments of each chromosome, from end to end."""
    frags = assembly.fragments(chain.withColumn("block", F.col("ref_chr")), lengths(ref), lengths(query))
    return assembly.aligned(frags, ref, query, scores, cells)


def align_sequences(ref: DataFrame, query: DataFrame, scores: affine.Scores = affine.Scores(), cells: int = 4_000_000) -> DataFrame:
    """The one sequence of ``ref`` against that of ``query``, as (name, row, score, method) with a row for each."""
    pair = ref.select(F.lit(0).cast("long").alias("id"), normalise_bases(F.col("seq")).alias("a"), F.col("name").alias("an"))
    other = query.select(F.lit(0).cast("long").alias("id"), normalise_bases(F.col("seq")).alias("b"), F.col("name").alias("bn"))
    both = pair.join(other, "id")
    got = affine.align_pairs(both, scores, cells).join(both.select("id", "an", "bn"), "id")
    return got.select(F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.col("an").alias("name"), F.col("row_a").alias("row")), F.struct(F.lit(1).alias("ord"), F.col("bn").alias("name"), F.col("row_b").alias("row")))).alias("r"), "score", "method").select("r.*", "score", "method")


def novel_anchors(chain: DataFrame, ref: DataFrame, query: DataFrame, side: int = 50_000, k: int = 15, w: int = 9, similarity: float = 0.0) -> DataFrame:
    """Matches with column ``block``, and the local matches found in their large gaps, in those that are left then, and so on.

    ref, query: (name, chunk, bases). Each round maps all gaps beyond ``side`` squared that were not tried; a gap is tried once,
    by its block and start, and what a find leaves is smaller, so the rounds end. Only whether any is left comes to the driver.
    """
    cols = [*chains.COLUMNS, "block"]
    now, tried = cut(chain.select(*cols), "anchors"), None
    while True:
        gaps = anchors.novel_anchor_gaps(anchors.inter_anchor_gaps(now, ["block", "ref_chr", "query_chr"], ["ref_start", "query_start"]).drop("ref_start", "query_start"), side)
        gaps = gaps.where((F.col("gap_ref_end") - F.col("gap_ref_start") >= k) & (F.col("gap_query_end") - F.col("gap_query_start") >= k))
        if tried is not None:
            gaps = gaps.join(tried, ["block", "gap_ref_start"], "left_anti")
        todo = cut(gaps.withColumn("id", F.xxhash64("block", "gap_ref_start")), "gaps")
        if todo.isEmpty():
            return now
        part = lambda s: todo.select("id", F.col(f"{s}_chr").alias("name"), F.col(f"gap_{s}_start").alias("start1"), F.col(f"gap_{s}_end").alias("end1"))
        a, b = fetch(part("ref"), ref).withColumnRenamed("bases", "ref"), fetch(part("query"), query)
        pairs = todo.select("id", "strand").join(a, "id").join(b, "id").select("id", "ref", oriented(F.col("bases"), F.col("strand")).alias("query"))
        found = mapping.local_map(pairs, k, w).withColumnsRenamed({"ref_start": "r0", "ref_end": "r1", "query_start": "q0", "query_end": "q1"}).join(todo, "id")
        share = F.col("score") / (F.col("r1") - F.col("r0") + 1)
        plus = F.col("strand") == "+"
        r0, r1 = F.col("gap_ref_start") + F.col("r0") - 1, F.col("gap_ref_start") + F.col("r1") - 1
        new = found.where(share > similarity).select(
            "ref_chr", "query_chr", r0.alias("ref_start"), r1.alias("ref_end"),
            F.when(plus, F.col("gap_query_start") + F.col("q0") - 1).otherwise(F.col("gap_query_end") - F.col("q1") + 1).alias("query_start"),
            F.when(plus, F.col("gap_query_start") + F.col("q1") - 1).otherwise(F.col("gap_query_end") - F.col("q0") + 1).alias("query_end"),
            "strand", share.alias("score"), F.concat_ws("_", F.lit(quota.LOCAL), "ref_chr", r0.cast("string"), r1.cast("string")).alias("gene"), F.col("id").alias("line_no"), "block",
        )
        done = todo.select("block", "gap_ref_start")
        tried = cut(done if tried is None else tried.union(done), "tried")
        now = cut(now.union(new.select(*cols)), "anchors")
