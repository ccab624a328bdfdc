"""Relational operators on matches and transcripts: ids, gaps, filters, copies, collapsing, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.orders import ranked

#: Width of the bins that turn an overlap join into an equality join.
BIN = 1 << 16
#: Intervals that a task merges, about.
MERGED = 1 << 20


def row_ids(match: DataFrame) -> DataFrame:
    """V1: 0-based order of each match on its reference and on its query chromosome. Sorted in ranges, so no chromosome is one task's."""
    by_ref = ranked(match, ["ref_start", "ref_end", "query_start", "query_end", "line_no"], "ref_id", ["ref_chr"])
    both = ranked(by_ref, ["query_start", "query_end", "ref_start", "ref_end", "line_no"], "query_id", ["query_chr"])
    return both.withColumns({c: F.col(c).cast("int") for c in ("ref_id", "query_id")})


def common_names(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Names (one column each) that all have; null is none."""
    out = first.where(F.col(first.columns[0]).isNotNull())
    for d in others:
        out = out.intersect(d)
    return out


def names_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, side) of names that only one of two tables has."""
    only = lambda x, y, side: x.toDF("name").distinct().join(y.toDF("name"), "name", "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "a").union(only(b, a, "b"))


def long_enough(features: DataFrame, least: int) -> DataFrame:
    """P2"""
    return features.where(F.col("end1") - F.col("start1") + 1 >= least)


def mapped(sam: DataFrame, transcripts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Records on a chromosome, of known transcripts and, if ``names`` (name) are given, on one of them."""
    kept = sam.where("rname <> '*'").join(transcripts.select(F.col("transcript").alias("qname")).distinct(), "qname", "left_semi")
    return kept if names is None else kept.join(names.select(F.col("name").alias("rname")).distinct(), "rname", "left_semi")


def similar(match: DataFrame, least: float) -> DataFrame:
    """P4"""
    return match.where(F.col("score") > least)


def same_chromosome(match: DataFrame, inversions: bool) -> DataFrame:
    """P5: matches within chromosomes of one name; without ``inversions`` only those on the plus strand."""
    same = match.where("ref_chr = query_chr")
    return same if inversions else same.where("strand = '+'")


def own_task(gaps: DataFrame, least: int = 100_000_000) -> DataFrame:
    """Gaps with bases on both sides, and whether their area asks for a task of their own."""
    return gaps.where("area > 0").withColumn("own_task", F.col("area") >= least)


def moved_genes(match: DataFrame) -> DataFrame:
    """Genes of a genome mapped to itself that lie elsewhere than where they come from."""
    return match.where("ref_start <> query_start or ref_end <> query_end").select("gene").distinct()


def top_copies(match: DataFrame, most: int) -> DataFrame:
    """The ``most`` best matches of a gene on a chromosome, of equals the first, with their place ``k``."""
    w = Window.partitionBy("gene", "query_chr").orderBy(F.desc("score"), "line_no")
    return match.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def usage(chained: DataFrame) -> DataFrame:
    """A5: (side, name, times): in how many blocks a reference gene is, and how often a query id was used. chained: block, gene, query_chr, query_id."""
    ref = chained.groupBy(F.col("gene").alias("name")).agg(F.countDistinct("block").alias("times")).select(F.lit("ref").alias("side"), "name", "times")
    query = chained.groupBy(F.concat_ws(":", "query_chr", F.col("query_id").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("times"))
    return ref.union(query.select(F.lit("query"), "name", "times"))


def with_novel(match: DataFrame, novel: DataFrame) -> DataFrame:
    """Matches and novel ones together, in reference order again (``rank``)."""
    return ranked(match.unionByName(novel), ["ref_chr", "ref_start", "ref_end", "query_start", "query_end", "line_no"])


def touched(match: DataFrame, chain: DataFrame) -> DataFrame:
    """Matches of pairs of chromosomes that share one with a chain: those that must be computed again."""
    on = lambda c: match.join(chain.select(c).distinct(), c, "left_semi")
    ref = on("ref_chr")
    return ref.unionByName(on("query_chr").join(chain.select("ref_chr").distinct(), "ref_chr", "left_anti"))


def inter_anchor_gaps(chain: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """V2: what lies between neighbours of one strand in a block; none where they overlap or the strand changes."""
    w = Window.partitionBy(*block).orderBy(*order)
    kept = dict.fromkeys([*block, *order, "strand", "ref_start", "ref_end", "query_start", "query_end"])
    before = chain.select(*kept, *[F.lag(c).over(w).alias(f"p_{c}") for c in ("strand", "ref_end", "query_start", "query_end")])
    plus = F.col("strand") == "+"
    gap = before.where("p_strand = strand").select(
        *block, "strand", (F.col("p_ref_end") + 1).alias("gap_ref_start"), (F.col("ref_start") - 1).alias("gap_ref_end"),
        F.when(plus, F.col("p_query_end") + 1).otherwise(F.col("query_end") + 1).alias("gap_query_start"),
        F.when(plus, F.col("query_start") - 1).otherwise(F.col("p_query_start") - 1).alias("gap_query_end"),
    )
    r, q = F.col("gap_ref_end") - F.col("gap_ref_start") + 1, F.col("gap_query_end") - F.col("gap_query_start") + 1
    return gap.where((r >= 0) & (q >= 0)).withColumn("area", r * q)


def novel_anchor_gaps(gaps: DataFrame, side: int = 50_000) -> DataFrame:
    """Gaps whose area is beyond a square of ``side`` bases."""
    return gaps.where(F.col("area") > side * side)


def suspicious_repeats(hits: DataFrame) -> DataFrame:
    """V3: genes with a record nearer to the end of their previous one, on the same chromosome, than their transcript (p_start, p_end) is long."""
    w = Window.partitionBy("gene").orderBy("line_no")
    seen = hits.select("gene", "query_chr", "query_start", "query_end", "p_start", "p_end", F.lag("query_chr").over(w).alias("p_chr"), F.lag("query_end").over(w).alias("last_end"))
    near = F.least(F.abs(F.col("last_end") - F.col("query_end")), F.abs(F.col("last_end") - F.col("query_start"))) < F.abs(F.col("p_start") - F.col("p_end"))
    return seen.where((F.col("p_chr") == F.col("query_chr")) & near).select("gene").distinct()


def copy_blacklist(match: DataFrame, expected: int = 1, ratio: float = 0.9) -> DataFrame:
    """A4: genes with more than ``expected`` copies on a chromosome, the best of which score alike."""
    top = top_copies(match.select("gene", "query_chr", "score", "line_no"), expected + 1)
    groups = top.groupBy("gene", "query_chr").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    return groups.where((F.col("n") > expected) & (F.col("lo") / F.col("hi") > ratio)).select("gene").distinct()


def without_genes(match: DataFrame, blacklist: DataFrame) -> DataFrame:
    """J3"""
    return match.join(blacklist, "gene", "left_anti")


def admitted(match: DataFrame, least: int = 3) -> DataFrame:
    """Matches of chromosome pairs that have ``least`` or more. A grouped count and a join, so no group meets in one task."""
    enough = match.groupBy("ref_chr", "query_chr").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return match.join(enough, ["ref_chr", "query_chr"], "left_semi")


def tandem_filter(pairs: DataFrame, m: int) -> DataFrame:
    """Once a self pair was seen in line order, pairs of one chromosome within m + 1 ids are dropped.

    The first self pair's line is one number, joined back, so no sort of all lines is needed.
    """
    first = pairs.where("ref_gene = query_gene").agg(F.min("line_no").alias("first_self"))
    near = (F.col("ref_chr") == F.col("query_chr")) & (F.abs(F.col("ref_id") - F.col("query_id")) - 1 <= m)
    after = F.coalesce(F.col("line_no") >= F.col("first_self"), F.lit(False))
    return pairs.join(F.broadcast(first)).where(~(after & near)).drop("first_self")  # one row


def _collapse(pairs: DataFrame, fixed: str, moving: str, width: int) -> DataFrame:
    group = ["ref_chr", "query_chr", f"{fixed}_id"]
    w = Window.partitionBy(*group).orderBy(f"{moving}_id", "line_no")
    step = F.col(f"{moving}_id") - F.lag(f"{moving}_id").over(w)
    bins = pairs.withColumn("bin", F.sum(F.when(step.isNull() | (step > width), 1).otherwise(0)).over(w))
    best = Window.partitionBy(*group, "bin").orderBy(F.desc("score"), f"{moving}_id", "line_no")
    return bins.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "bin")


def collapse_near_pairs(pairs: DataFrame, width: int = 1) -> DataFrame:
    """V4: of pairs that share one id and are within ``width`` ids on the other side, the best; first per query, then per reference."""
    return _collapse(_collapse(pairs, "query", "ref", width), "ref", "query", width)


def block_summary(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Size, score, box and direction of each block (members with pos from 0): by the query ids of its first two members, or its only one's strand."""
    at = lambda k: F.max(F.when(F.col("pos") == k, F.col("query_id")))
    rising = F.coalesce(at(0) < at(1), F.max(F.when(F.col("pos") == 0, F.col("strand"))) == "+")
    return chain.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"), F.min("ref_start").alias("ref_start"), F.max("ref_end").alias("ref_end"), F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end"),
        F.when(rising, "POSITIVE").otherwise("NEGATIVE").alias("direction"),
    )


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], sa: str, ea: str, sb: str, eb: str, bin_size: int = BIN) -> DataFrame:
    """Pairs of closed intervals that overlap, with equal ``keys``.

    Both sides go to the bins that they touch; a pair is taken in the first bin that they
    share, so the join is one of equality, with no duplicates to remove. Column names must differ.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size)))
    left, right = a.withColumn("bin", bins(sa, ea)), b.withColumn("bin", bins(sb, eb))
    hit = left.join(right, [*keys, "bin"])
    first = F.greatest(F.floor(F.col(sa) / bin_size), F.floor(F.col(sb) / bin_size))
    return hit.where((F.col(sa) <= F.col(eb)) & (F.col(sb) <= F.col(ea)) & (F.col("bin") == first)).drop("bin")


def cds_segments(features: DataFrame) -> DataFrame:
    """Exons of each transcript with the range of spliced positions (1-based, lo to hi) that they hold: from the first exon on plus, from the last on minus."""
    minus = F.when(F.col("strand") == "-", -1).otherwise(1)
    w = Window.partitionBy("transcript").orderBy(F.col("start1") * minus, F.col("end1") * minus, "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("end1") - F.col("start1") + 1
    return features.withColumn("hi", F.sum(size).over(w)).withColumn("lo", F.col("hi") - size + 1)


def lift_positions(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """Spliced offset (``off``, 1-based) of a transcript to genomic position: equality on the transcript, range on the offset; falling on minus."""
    s = segments.select("transcript", "seqid", F.col("strand").alias("s_strand"), "start1", "end1", "lo", "hi")
    step = F.col("off") - F.col("lo")
    pos = F.when(F.col("s_strand") == "-", F.col("end1") - step).otherwise(F.col("start1") + step)
    return positions.join(s, "transcript").where("off BETWEEN lo AND hi").withColumn("pos1", pos).drop("s_strand", "start1", "end1", "lo", "hi")


def lifted(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """(line_no, transcript, seqid, ref_start, ref_end): where the aligned part of a transcript lies in its genome.

    hits: line_no, transcript, reverse, head, tail (clipped bases), cds_len. A part outside the transcript is dropped.
    """
    first = F.when(F.col("reverse"), F.col("cds_len") - F.col("head")).otherwise(1 + F.col("head"))
    last = F.when(F.col("reverse"), 1 + F.col("tail")).otherwise(F.col("cds_len") - F.col("tail"))
    ends = hits.select("line_no", "transcript", F.explode(F.array(first, last)).alias("off"))
    return lift_positions(ends, segments).groupBy("line_no", "transcript", "seqid").agg(F.min("pos1").alias("ref_start"), F.max("pos1").alias("ref_end"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def matches(sam: DataFrame, features: DataFrame, genes: DataFrame, least: float = 0.5, expected: int = 1, ratio: float = 0.9) -> DataFrame:
    """From mapped transcripts to matches (J1, J2, J3, J5, P3, P4, V3, A4): genes that map suspiciously or in too many equal copies are left out.

    sam: what the reader gives; features: exons; genes: (transcript, gene).
    """
    tx = transcripts(features).join(genes, "transcript").select("transcript", "gene", F.col("strand").alias("t_strand"), "p_start", "p_end", "cds_len")
    hits = mapped(sam, tx).withColumnRenamed("qname", "transcript").join(tx, "transcript")
    placed = hits.join(lifted(hits, cds_segments(features)).drop("transcript"), "line_no")
    strand = F.when(F.col("reverse") == (F.col("t_strand") == "-"), "+").otherwise("-")
    rows = placed.select(
        F.col("seqid").alias("ref_chr"), F.col("rname").alias("query_chr"), F.col("ref_start").cast("long").alias("ref_start"), F.col("ref_end").cast("long").alias("ref_end"), F.col("pos1").cast("long").alias("query_start"),
        (F.col("pos1") + F.col("span") - 1).cast("long").alias("query_end"), strand.alias("strand"), (F.col("aligned") / F.col("cds_len")).alias("score"), "gene", "line_no", "p_start", "p_end",
    )
    good = similar(rows, least)
    bad = suspicious_repeats(rows).union(copy_blacklist(good, expected, ratio)).distinct()
    return without_genes(good, bad).drop("p_start", "p_end")


def transcripts(features: DataFrame) -> DataFrame:
    """One row per transcript; chromosome and strand of its first line."""
    first = F.min_by(F.struct("seqid", "strand"), "line_no")
    return features.groupBy("transcript").agg(
        first["seqid"].alias("seqid"), first["strand"].alias("strand"), F.min("start1").alias("p_start"), F.max("end1").alias("p_end"),
        F.sum(F.col("end1") - F.col("start1") + 1).alias("cds_len"), F.count(F.lit(1)).alias("n_exons"),
    )


def longest_per_gene(tx: DataFrame, size: str = "cds_len") -> DataFrame:
    """A1: the longest transcript of each gene; of equals the one of largest name."""
    return tx.groupBy("gene").agg(F.max(F.struct(F.col(size).alias("size"), F.col("transcript").alias("transcript"))).alias("m")).select("gene", "m.transcript", F.col("m.size").alias(size))


def duplicate_genes(tx: DataFrame, content: str = "seq") -> DataFrame:
    """A2: genes of transcripts whose sequence another transcript has too, of the same gene or not."""
    twice = tx.groupBy(content).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return tx.join(twice, content, "left_semi").select("gene").distinct()


def runs(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """V5: maximal runs of consecutive positions."""
    w = Window.partitionBy(*keys).orderBy(pos)
    marked = rows.withColumn("run", F.col(pos) - F.row_number().over(w))
    return marked.groupBy(*keys, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def next_on_path(rows: DataFrame, keys: list[str], order: list[str], what: str) -> DataFrame:
    """Each element and the one after it on its path."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("next", F.lead(what).over(w)).where("next is not null").select(*keys, what, "next")


def merged_length(intervals: DataFrame, keys: list[str], s: str, e: str, bin_size: int = BIN) -> DataFrame:
    """Covered length, number and islands of closed intervals.

    Intervals are cut at the edges of bins and merged bin by bin, so a chromosome is many tasks'. What each adds to
    those before it is summed, so islands are not kept; one that begins where a cut interval goes on is the one before
    it. Tasks get MERGED intervals each, about, however many there are.
    """
    n = F.floor(F.col(s) / bin_size)
    cuts = intervals.agg(F.sum(F.floor(F.col(e) / bin_size) - n + 1)).first()[0] or 0
    tasks = max(int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cuts // MERGED))
    parts = intervals.select(*keys, F.col(s).alias("_s"), F.col(e).alias("_e"), n.alias("_first"), F.explode(F.sequence(n, F.floor(F.col(e) / bin_size))).alias("_bin"))
    parts = parts.select(*keys, "_bin", (F.col("_bin") > F.col("_first")).alias("_goes_on"), F.greatest("_s", F.col("_bin") * bin_size).alias("_s"), F.least("_e", (F.col("_bin") + 1) * bin_size - 1).alias("_e"))
    w = Window.partitionBy(*keys, "_bin").orderBy("_s", F.desc("_goes_on"), "_e")
    high = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.repartition(tasks, *keys, "_bin").withColumn("_high", high).withColumn("_new", F.col("_high").isNull() | (F.col("_s") > F.col("_high")))
    whole, new = ~F.col("_goes_on"), F.col("_new")
    return marked.groupBy(*keys).agg(
        F.sum(F.when(new, F.col("_e") - F.col("_s") + 1).otherwise(F.greatest(F.col("_e") - F.col("_high"), F.lit(0)))).alias("covered"),
        F.sum(whole.cast("long")).alias("n"), F.sum((new & whole).cast("long")).alias("islands"),
    )


def dotplot(sam: DataFrame, tx: DataFrame) -> DataFrame:
    """H1: (ref_chr, ref_start, query_chr, query_start, strand) of records of known transcripts: plus if mapped as the transcript lies."""
    t = tx.select("transcript", F.col("seqid").alias("ref_chr"), F.col("p_start").alias("ref_start"), F.col("strand").alias("t_strand"))
    low = F.col("flag") % 32
    same = ((low == 0) & (F.col("t_strand") == "+")) | ((low == 16) & (F.col("t_strand") == "-"))
    return sam.join(t, F.col("qname") == F.col("transcript")).select("line_no", "ref_chr", "ref_start", F.col("rname").alias("query_chr"), F.col("pos1").alias("query_start"), F.when(same, "+").otherwise("-").alias("strand"))


def variants_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, chrom, pos, ref, alt) of variants that only one of two sets has, and how far before it (``lag``) the last such one on its chromosome is."""
    key = ["chrom", "pos", "ref", "alt"]
    only = lambda x, y, side: x.select(*key).distinct().join(y.select(*key), key, "left_anti").select(F.lit(side).alias("side"), *key)
    both = only(a, b, "a").union(only(b, a, "b"))
    return both.withColumn("lag", F.col("pos") - F.lag("pos").over(Window.partitionBy("chrom").orderBy("pos", "side", "ref", "alt")))


def _to_sdi(rows: DataFrame) -> DataFrame:
    """(chrom, pos, diff, ref, alt): length difference; a first base in common goes and moves the position back by one, else a last one goes; nothing is ``-``."""
    ref, alt = F.col("ref"), F.col("alt")
    head = F.left(ref, F.lit(1)) == F.left(alt, F.lit(1))
    tail = ~head & ~((F.char_length(ref) == 1) & (F.char_length(alt) == 1)) & (F.right(ref, F.lit(1)) == F.right(alt, F.lit(1)))

    def cut_(x: Column) -> Column:
        y = F.when(head, F.substring(x, F.lit(2), F.char_length(x))).when(tail, F.substring(x, F.lit(1), F.char_length(x) - 1)).otherwise(x)
        return F.when(y == "", "-").otherwise(y)

    return rows.select("chrom", F.when(head, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), (F.char_length(alt) - F.char_length(ref)).alias("diff"), cut_(ref).alias("ref"), cut_(alt).alias("alt"))


def variant_to_sdi(v: DataFrame) -> DataFrame:
    """H4: a leading ``chr`` of the chromosome goes too."""
    return _to_sdi(v.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")))


def gvcf_to_sdi(v: DataFrame) -> DataFrame:
    """H5: ``<NON_REF>`` and commas are taken out of the alternative; a row without one is dropped."""
    return _to_sdi(v.withColumn("alt", F.regexp_replace("alt", "<NON_REF>|,", "")).where("alt <> ''"))
