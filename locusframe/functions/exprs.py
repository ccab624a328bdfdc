"""Scalar functions on sequences, alignments and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters by the bits of A, C, G and T.
IUPAC = "-ACMGRSVTWYHKDBN"


def normalise_bases(s: Column) -> Column:
    """upper case, ambiguity codes to N, U to T."""
    return F.translate(F.upper(s), "RYSWKMBDHVU", "NNNNNNNNNNT")


def complement(s: Column) -> Column:
    """complement, letter by letter, in upper case."""
    return F.translate(F.upper(s), "ATUCGRYKMBVDH", "TAAGCYRMKVBHD")


def reverse_complement(s: Column) -> Column:
    """of upper-case IUPAC letters; S, W and N stay."""
    return F.translate(F.reverse(s), "ATUCGRYKMBVDH", "TAAGCYRMKVBHD")


def subsequence(s: Column, start: Column, end: Column) -> Column:
    """1-based closed interval; ends swapped if reversed, clamped to the sequence."""
    n = F.greatest(F.char_length(s), F.lit(1))
    a = F.least(F.greatest(F.least(start, end), F.lit(1)), n).cast("int")
    b = F.least(F.greatest(F.greatest(start, end), F.lit(1)), n).cast("int")
    return F.substring(s, a, b - a + 1)


def attribute(attrs: Column, key: str) -> Column:
    """Value of ``key`` in a feature's attributes (``key=v;`` or ``key "v";``), null if absent."""
    return F.nullif(F.regexp_extract(attrs, rf'(?:^|;)\s*{key}(?:=|\s+)"?([^";]*)"?', 1), F.lit(""))


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op); null if the text is no alignment."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\d+", 0).cast("long").alias("n"), F.right(p, F.lit(1)).alias("op")))
    return F.when((F.array_join(parts, "") == cigar) & (cigar != ""), ops)


def cigar_summary(cigar: Column) -> Column:
    """struct head, tail (clipped), aligned (M, =, X), span (those and D, N); null if invalid."""
    ops = cigar_ops(cigar)

    def total(letters: str) -> Column:
        return F.aggregate(ops, F.lit(0).cast("long"), lambda a, o: a + F.when(o["op"].isin(*letters), o["n"]).otherwise(F.lit(0).cast("long")))

    def clip(o: Column) -> Column:
        return F.when(o["op"].isin("S", "H"), o["n"]).otherwise(F.lit(0).cast("long"))

    tail = F.when(F.size(ops) > 1, clip(F.element_at(ops, -1))).otherwise(F.lit(0).cast("long"))
    return F.when(ops.isNotNull(), F.struct(clip(F.element_at(ops, 1)).alias("head"), tail.alias("tail"), total("M=X").alias("aligned"), total("M=XDN").alias("span")))


def is_reverse(flag: Column) -> Column:
    """any flag that 32 does not divide counts as reverse."""
    return flag % 32 != 0


def mask_of(base: Column) -> Column:
    """4-bit mask of an IUPAC letter, 0 if it is none."""
    return F.greatest(F.instr(F.lit(IUPAC), F.upper(base)) - 1, F.lit(0))


def letter_of(mask: Column) -> Column:
    return F.substring(F.lit(IUPAC), mask.cast("int") + 1, F.lit(1))


def forward_start(start0: Column, size: Column, strand: Column, source_size: Column) -> Column:
    """F8: 0-based start on the forward strand of a row given on either."""
    return F.when(strand == "-", source_size - start0 - size).otherwise(start0)


def pair_id(a: Column, b: Column) -> Column:
    """F12"""
    return F.concat(F.least(a, b), F.lit("--"), F.greatest(a, b))


def saturating_multiply(a: Column, b: Column) -> Column:
    """of non-negative longs; the largest long instead of an overflow."""
    return F.coalesce(F.try_multiply(a, b), F.lit(2**63 - 1))


def saturating_add(a: Column, b: Column) -> Column:
    """of non-negative longs; the largest long instead of an overflow."""
    return F.coalesce(F.try_add(a, b), F.lit(2**63 - 1))


def close(a: Column, b: Column) -> Column:
    """equal within 1e-12, relative to the larger of both and 1."""
    return F.abs(a - b) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def tsv_clean(s: Column) -> Column:
    """F15"""
    return F.translate(s, "\t\n\r", "   ")


def strict_integer(s: Column) -> Column:
    """a trimmed whole token as a long; null for anything else."""
    t = F.trim(s)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))


def strict_double(s: Column) -> Column:
    """a trimmed whole token as a finite double; null for anything else."""
    t = F.trim(s)
    x = t.try_cast("double")
    return F.when(t.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(x) < float("inf")), x)


def interval_fits(start0: Column, end0: Column, size: Column | None = None) -> Column:
    """a half-open interval with something in it, within ``size`` if given."""
    fits = (start0 >= 0) & (end0 > start0)
    return fits if size is None else fits & (end0 <= size)


def beside(manifest: str, path: Column) -> Column:
    """a path of a manifest, relative ones from the manifest's folder."""
    folder = manifest.rsplit("/", 1)[0] + "/" if "/" in manifest else ""
    return F.when(path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(folder), path))


def method_label(method: Column) -> Column:
    """what a method's rows are called in tables."""
    # Labels of methods that are told apart inside only.
    labels = {
        "WAVEFRONT_SINGLETRACK": "WAVEFRONT", "WAVEFRONT_MEDIUM": "WAVEFRONT", "WAVEFRONT_LOW": "WAVEFRONT",
        "KSW2_SINGLETRACK": "KSW2", "MINIMAP2": "KSW2", "KSW2_SCORE_CERTIFIED": "KSW2", "BANDED_MINIMAP2": "BANDED_KSW2",
    }
    out = method
    for a, b in labels.items():
        out = F.when(method == a, b).otherwise(out)
    return out


def bases_fit(base: Column, other: Column) -> Column:
    """Two IUPAC letters that may be the same base."""
    return mask_of(base).cast("int").bitwiseAND(mask_of(other).cast("int")) > 0


def split_items(s: Column, delimiter: str) -> Column:
    """F16: items between delimiters, empty ones dropped."""
    return F.filter(F.split(s, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def gap_cost(length: Column, open1: float = -8, extend1: float = -2, open2: float = -75, extend2: float = -1) -> Column:
    """L4: the better of two affine pieces."""
    return F.greatest(open1 + extend1 * length, open2 + extend2 * length)


def mash_mismatch(jaccard: Column, k: int) -> Column:
    """Mismatch rate that a k-mer similarity stands for."""
    return F.when(jaccard <= 0, F.lit(1.0)).otherwise(1 - F.pow(2 * jaccard / (1 + jaccard), F.lit(1.0 / k)))


def floor_quantile(values: Column, p: float) -> Column:
    """A10: element floor(p * (n - 1)) of the sorted values."""
    return F.element_at(F.array_sort(values), (F.floor(p * (F.size(values) - 1)) + 1).cast("int"))
