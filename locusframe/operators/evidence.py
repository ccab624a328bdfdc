"""Pairwise alignment rows as residues, homologies and absences; checks against sequences; adjacencies of placed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.exprs import bases_fit, complement, mask_of, pair_id
from locusframe.operators.anchors import next_on_path
from locusframe.operators.sequences import CHUNK


def alignment_columns(rows: DataFrame) -> DataFrame:
    """(block, row, source, col, pos0, base, present): forward position and base of each column of each row.

    rows: block, row, source, start0, size, strand, source_size, text. A gap has the position of no base.
    """
    cells = rows.select("block", "row", "source", "start0", "strand", "source_size", F.posexplode(F.split("text", "")).alias("col", "char")).where("char <> ''").withColumn("col", F.col("col").cast("long"))
    w = Window.partitionBy("block", "row").orderBy("col")
    bases = (F.col("char") != "-").cast("long")
    seen = cells.withColumn("nth", F.sum(bases).over(w) - 1)
    on_row = F.col("start0") + F.col("nth")
    pos = F.when(F.col("strand") == "-", F.col("source_size") - 1 - on_row).otherwise(on_row)
    present = F.col("char") != "-"
    base = F.when(present, F.when(F.col("strand") == "-", complement(F.col("char"))).otherwise(F.upper("char")))
    return seen.select("block", "row", "source", "col", F.when(present, pos).alias("pos0"), base.alias("base"), present.alias("present"))


def malformed_rows(rows: DataFrame) -> DataFrame:
    """(block, row, problem) of alignment rows that no format allows: letters, strand, an interval outside the source, or a size that the bases are not."""
    bases = F.char_length(F.replace(F.col("text"), F.lit("-"), F.lit("")))
    problem = (
        F.when(~F.col("text").rlike("^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]+$"), "alphabet").when(~F.col("strand").isin("+", "-"), "strand")
        .when((F.col("start0") < 0) | (F.col("start0") + F.col("size") > F.col("source_size")), "interval").when(bases != F.col("size"), "size")
    )
    return rows.select("block", "row", problem.alias("problem")).where("problem is not null")


def homologies(columns: DataFrame) -> DataFrame:
    """G1: columns in which both rows have a base: (block, col, left_pos0, right_pos0, same)."""
    a = columns.where("row = 0 and present").select("block", "col", F.col("pos0").alias("left_pos0"), F.col("base").alias("lb"))
    b = columns.where("row = 1 and present").select("block", "col", F.col("pos0").alias("right_pos0"), F.col("base").alias("rb"))
    return a.join(b, ["block", "col"]).select("block", "col", "left_pos0", "right_pos0", (F.col("lb") == F.col("rb")).alias("same"))


def base_conflicts(columns: DataFrame) -> DataFrame:
    """G1: residues (source, pos0) that alignments give different bases, N aside: (source, pos0, bases). Rows here are an error of the input."""
    seen = columns.where("present and base <> 'N'").groupBy("source", "pos0").agg(F.array_sort(F.collect_set("base")).alias("bases"))  # letters: a handful at most
    return seen.where(F.size("bases") > 1)


def absences(columns: DataFrame) -> DataFrame:
    """Gaps with a base on both sides in their row, as (block, row, col, left_flank0, right_flank0); a terminal gap is missing data."""
    w = Window.partitionBy("block", "row").orderBy("col")
    left = F.last("pos0", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first("pos0", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seen = columns.withColumn("left_flank0", left).withColumn("right_flank0", right)
    return seen.where("not present and left_flank0 is not null and right_flank0 is not null").select("block", "row", "col", "left_flank0", "right_flank0")


def check_bases(residues: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``residues`` (taxon, seq, pos0, base, source_size) with a code: is what each says possible, and does it stand in its taxon's sequence?

    chunks: (taxon, name, chunk, bases). A base fits if both letters may be the same one. A residue meets
    the one chunk it lies in. Diagnostics of the files themselves (headers, duplicates) are the readers'.
    """
    sizes = residues.groupBy("taxon", "seq").agg((F.min("source_size") != F.max("source_size")).alias("sizes_differ"))
    have = chunks.groupBy("taxon", "name").agg(F.max(F.col("chunk") * size + F.char_length("bases")).alias("length"))
    rows = residues.join(sizes, (residues.taxon == sizes.taxon) & residues.seq.eqNullSafe(sizes.seq), "left").drop(sizes.taxon, sizes.seq)
    rows = rows.join(have.select("taxon").distinct().withColumn("known_taxon", F.lit(True)), "taxon", "left")
    rows = rows.join(have.withColumnRenamed("name", "seq"), ["taxon", "seq"], "left").withColumn("chunk", F.floor(F.col("pos0") / size).cast("long"))
    rows = rows.join(chunks.withColumnRenamed("name", "seq"), ["taxon", "seq", "chunk"], "left").withColumn("there", F.substring("bases", (F.col("pos0") - F.col("chunk") * size + 1).cast("int"), F.lit(1)))
    # The diagnostic codes.
    code = (
        F.when(F.coalesce("seq", F.lit("")) == "", "EVIDENCE_EMPTY_SOURCE_ID").when(F.col("source_size") <= 0, "EVIDENCE_INVALID_SOURCE_SIZE").when(F.col("sizes_differ"), "EVIDENCE_SOURCE_SIZE_CONFLICT")
        .when((F.col("pos0") < 0) | (F.col("pos0") >= F.col("source_size")), "EVIDENCE_POSITION_OUT_OF_RANGE").when(mask_of(F.col("base")) == 0, "EVIDENCE_INVALID_BASE")
        .when(F.col("known_taxon").isNull(), "MISSING_TAXON_FASTA").when(F.col("length").isNull(), "FASTA_MISSING_SEQUENCE_ID").when(F.col("length") != F.col("source_size"), "FASTA_SOURCE_SIZE_MISMATCH")
        .when(mask_of(F.col("there")) == 0, "FASTA_INVALID_BASE").when(~bases_fit(F.col("base"), F.col("there")), "FASTA_EVIDENCE_BASE_MISMATCH").otherwise("OK")
    )
    return rows.select("taxon", "seq", "pos0", "base", code.alias("code"))


def path_observations(residues: DataFrame) -> DataFrame:
    """(path, site_id, pos0, base, next_site, next_base): what a path shows at each site, and at the one after it."""
    w = Window.partitionBy("path").orderBy("pos0")
    return residues.select("path", "site_id", "pos0", "base", F.lead("site_id").over(w).alias("next_site"), F.lead("base").over(w).alias("next_base"))


def in_intervals(positions: DataFrame, intervals: DataFrame, keys: list[str], bin_size: int = 1 << 12) -> DataFrame:
    """Positions (keys, pos0) in half-open intervals (keys, start0, end0, id): equality on keys and bin, range within."""
    bins = F.explode(F.sequence(F.floor(F.col("start0") / bin_size), F.floor((F.col("end0") - 1) / bin_size)))
    b = intervals.where("end0 > start0").withColumn("bin", bins)
    return positions.withColumn("bin", F.floor(F.col("pos0") / bin_size)).join(b, [*keys, "bin"]).where("pos0 >= start0 and pos0 < end0").drop("bin")


def place_blocks(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(block_id, path, first, n, orientation) wherever all sites of a block follow each other on a path, forward or backward.

    blocks: block_id, idx (from 0, gapless), site_id; paths: path, pos, site_id. ``first`` counts the sites of the path
    before the place. ``?``: the block reads the same both ways there. Two neighbours of a block and of a path meet (a block
    of one site meets sites), as sites alone are on paths far more often; those that agree on where the block would begin
    are counted, so nothing is gathered for a path or block.
    """
    w = Window.partitionBy("path").orderBy("pos", "site_id")
    on_path = paths.select("path", F.col("site_id").alias("_a"), F.lead("site_id").over(w).alias("_b"), (F.row_number().over(w) - 1).cast("long").alias("at"))
    size = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    one = blocks.join(size.where("n = 1"), "block_id").select("block_id", "n", F.col("site_id").alias("_a"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("o"), F.lit(0).alias("_back"))
    after = blocks.select("block_id", (F.col("idx") - 1).alias("idx"), F.col("site_id").alias("_y"))
    two = blocks.join(after, ["block_id", "idx"]).join(size, "block_id")
    ways = F.explode(F.array(F.struct(F.lit("+").alias("o"), F.col("site_id").alias("_a"), F.col("_y").alias("_b"), F.col("idx").cast("long").alias("_back")), F.struct(F.lit("-").alias("o"), F.col("_y").alias("_a"), F.col("site_id").alias("_b"), (F.col("n") - 2 - F.col("idx")).cast("long").alias("_back"))))
    two = two.select("block_id", "n", ways.alias("w")).select("block_id", "n", "w.*")
    kept = ["block_id", "path", "n", "o", (F.col("at") - F.col("_back")).alias("first")]
    met = two.join(on_path, ["_a", "_b"]).select(*kept).unionByName(one.join(on_path, "_a").select(*kept))
    whole = met.groupBy("block_id", "path", "n", "o", "first").agg(F.count(F.lit(1)).alias("k")).where("k = greatest(n - 1, 1)")
    return whole.groupBy("block_id", "path", "first", "n").agg(F.when(F.count(F.lit(1)) == 2, "?").otherwise(F.min("o")).alias("orientation")).select("block_id", "path", "first", "n", "orientation")


def fnv1a(items: list[bytes]) -> list[int]:
    """FNV-1a of 64 bits of each item: all items' bytes at one place at a time, the longest first, so that a prefix of them is still at work."""
    order = sorted(range(len(items)), key=lambda k: -len(items[k]))
    sizes = np.array([len(items[k]) for k in order], np.int64)
    h = np.full(len(items), 0xCBF29CE484222325, np.uint64)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(items[k] for k in order), np.uint8)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, side="left"))  # items longer than ``place``
        h[:n] = (h[:n] ^ flat[starts[:n] + place]) * np.uint64(0x100000001B3)
    out = np.empty(len(items), np.uint64)
    out[order] = h
    return out.tolist()


def stable_id(prefix: str, *fields: Column, namespace: str = "locusframe-v1") -> Column:
    """``prefix_`` and 16 hex digits of FNV-1a (64 bits) over the fields with their lengths."""

    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series([f"{prefix}_{h:016x}" for h in fnv1a([s.encode() for s in text])], index=text.index)

    parts = [F.concat(F.lit("|"), F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    return digest(F.concat(F.lit(namespace), *parts))


def cigar_segments(rows: DataFrame, match: int = 37, least: int = 1) -> DataFrame:
    """H6: (id, first, last, score): the best runs of operations, ``=`` earning ``match`` a base and all others costing one; then, left and right of each, the same again."""

    def best(ops: list[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
        stack = [(0, len(ops))]
        while stack:
            lo, hi = stack.pop()
            top, at, total, start = 0, None, 0, lo
            for k in range(lo, hi):
                if total <= 0:
                    total, start = 0, k
                total += ops[k][0] * (match if ops[k][1] == "=" else -1)
                if total > top:
                    top, at = total, (start, k)
            if at and top >= least:
                yield at[0], at[1], top
                stack += [(lo, at[0]), (at[1] + 1, hi)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            got = [(i, *x) for i, c in zip(pdf.id, pdf.cigar, strict=True) for x in best([(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", c or "")])]
            yield pd.DataFrame(got, columns=["id", "first", "last", "score"])

    return rows.select("id", "cigar").mapInPandas(run, "id long, first long, last long, score long")


def swap_rows(rows: DataFrame, top: int) -> DataFrame:
    """H3: row ``top`` of each block first; all rows turned around if it lies on the minus strand."""
    flip = F.max(F.when(F.col("row") == top, F.col("strand") == "-")).over(Window.partitionBy("block"))
    turned = F.translate(F.reverse("text"), "ATUCGRYKMBVDH", "TAAGCYRMKVBHD")
    order = F.when(F.col("row") == top, 0).when(F.col("row") < top, F.col("row") + 1).otherwise(F.col("row"))
    return rows.withColumn("flip", flip).select("block", order.cast("int").alias("row"), "source", "start0", F.when(F.col("flip"), F.when(F.col("strand") == "-", "+").otherwise("-")).otherwise(F.col("strand")).alias("strand"), F.when(F.col("flip"), turned).otherwise(F.col("text")).alias("text"))
