"""Readers of sequence, annotation, alignment and manifest files into typed tables.

All read with explicit columns, keep line order only where it carries meaning, and raise
on rows that the format forbids.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.exprs import attribute, cigar_summary, is_reverse
from locusframe.operators.sequences import CHUNK
from locusframe.plans.runtime import cut, ship


def _gzipped(spark: SparkSession, path: str) -> tuple[list[str], list[str], list[str]]:
    """The files of ``path``: plain ones, gzip files that are named so, and those that only their first two bytes tell."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    plain, named, told = [], [], []
    todo = list(fs.globStatus(where) or ())
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        status = todo.pop()
        at = status.getPath()
        if status.isDirectory():
            todo += [x for x in fs.listStatus(at) if not x.getPath().getName().startswith(("_", "."))]
            continue
        stream = fs.open(at)
        try:
            magic = (stream.read(), stream.read())
        finally:
            stream.close()
        name = at.toString()
        if magic != (0x1F, 0x8B):
            plain.append(name)
        else:
            (named if name.endswith(".gz") else told).append(name)
    return sorted(plain), sorted(named), sorted(told)


_RAW = "file string, split long, at long, value string"


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value): lines with their place in their split of their file. Files are split, but for gzip, which is read as a stream."""
    plain, named, told = _gzipped(spark, path)
    kinds = []

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            at = []
            for key in keys:
                if key != now:
                    now, n = key, 0
                at.append(n)
                n += 1
            value = pc.utf8_rtrim(batch.column(2), characters="\r")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), value], ["file", "split", "at", "value"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, part = 0, []
                with gzip.open(io.BytesIO(data), "rt", newline="\n") as lines:
                    for line in lines:
                        part.append(line.rstrip("\n").rstrip("\r"))
                        if len(part) == 20_000:
                            yield _numbered(name, k, part)
                            k, part = k + len(part), []
                if part:
                    yield _numbered(name, k, part)

    if plain or named:
        rows = spark.read.option("lineSep", "\n").text(plain + named)
        kinds.append(rows.select("_metadata.file_path", "_metadata.file_block_start", "value").mapInArrow(number, _RAW))
    if told:
        kinds.append(spark.read.format("binaryFile").load(told).select("path", "content").mapInArrow(unpack, _RAW))
    return kinds[0] if len(kinds) == 1 else kinds[0].union(kinds[1])


def _numbered(name: str, k: int, part: list[str]) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([0] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array(part, pa.string())], ["file", "split", "at", "value"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``: line_no counts the lines of a file from 0; lines end at a line feed, with or without a carriage return.

    gzip is told by its first bytes (S2), not by its name. A large plain file is read in many tasks: lines are
    numbered in their splits, and the splits' counts, one number each, are added up.
    """
    ship(spark)
    rows = _raw_lines(spark, path)
    counts = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(counts.select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(before, F.lit(0)).alias("before")), "splits")
    return rows.join(starts, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select("file", (F.col("before") + F.col("at")).cast("long").alias("line_no"), "value")


def read_sequences(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """``(name, chunk, bases)``, chunks of ``size`` bases as they stand; the name ends at the first blank; of equal names the last wins.

    Lines go together to pieces within their splits; where a piece lies in its record follows from what earlier
    splits hold behind their last header, a row for each split. No task holds a whole sequence.
    """
    ship(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, record, name, at, held, parts, rows = None, 0, None, 0, 0, [], []

        def close() -> None:
            nonlocal at, held
            rows.append((*key, record, name, at, "".join(parts)))
            at, held = at + held, 0
            parts.clear()

        for batch in batches:
            for file, split, line in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (file, split) != key:
                    if key:
                        close()
                    key, record, name, at = (file, split), 0, None, 0
                if line.startswith(">"):
                    close()
                    record, name, at = record + 1, line[1:].split(" ")[0].split("\t")[0], 0
                else:
                    parts.append(line)
                    held += len(line)
                    if held >= size:
                        close()
            if rows:
                yield _pieces(rows)
                rows = []
        if key:
            close()
            yield _pieces(rows)

    found = cut(_raw_lines(spark, path).mapInArrow(pieces, "file string, split long, record long, name string, at long, bases string"), "fasta-pieces")
    last = found.groupBy("file", "split").agg(F.max("record").alias("n"), F.max_by("name", F.struct("record", "at")).alias("open"), F.max_by(F.col("at") + F.char_length("bases"), F.struct("record", "at", F.char_length("bases"))).alias("tail"))
    w = Window.partitionBy("file").orderBy("split")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("sum", F.sum("tail").over(w)).withColumn("mark", F.when(F.col("n") > 0, F.col("sum") - F.col("tail")))
    opened = cut(last.select(
        F.col("file").alias("f"), F.col("split").alias("s"), F.last("open", True).over(back).alias("o_name"), (F.lag("sum").over(w) - F.last("mark", True).over(back)).alias("o_at"),
        F.coalesce(F.sum("n").over(back), F.lit(0)).alias("o_n"),
    ), "fasta-splits")
    placed = found.join(opened, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select(
        "file", (F.col("o_n") + F.col("record")).alias("record"), F.when(F.col("record") == 0, F.col("o_name")).otherwise(F.col("name")).alias("name"),
        (F.col("at") + F.when(F.col("record") == 0, F.col("o_at")).otherwise(0)).alias("at"), "bases",
    ).where("name <> ''")
    winner = placed.groupBy("name").agg(F.max(F.struct("file", "record")).alias("w")).select("name", "w.*")
    kept = placed.join(winner, ["name", "file", "record"], "left_semi")
    parts = kept.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.greatest(F.char_length("bases"), F.lit(1)) - 1) / size))))
    lo = F.greatest(F.col("at"), F.col("chunk") * size)
    part = F.substring("bases", (lo - F.col("at") + 1).cast("int"), ((F.col("chunk") + 1) * size - lo).cast("int"))
    whole = parts.groupBy("name", F.col("chunk").cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), part.alias("part")))).alias("ps"))
    return whole.select("name", "chunk", F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("bases")).where("bases <> '' or chunk = 0")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["file", "split", "record", "name", "at", "bases"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, length, seq)`` of sequences short enough to be one value (genes, contigs); for chromosomes see :func:`read_sequences`."""
    chunks = read_sequences(spark, path)
    whole = chunks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("ps"))
    seq = F.array_join(F.transform("ps", lambda p: p["bases"]), "")
    return whole.select("name", F.char_length(seq).cast("long").alias("length"), seq.alias("seq"))


def _field(k: int) -> Column:
    return F.get(F.split("value", "\t"), F.lit(k))


def read_gff(spark: SparkSession, path: str, feature: str = "CDS", least: int = 1) -> DataFrame:
    """Features of one type: (seqid, type, start1, end1, strand, attrs, transcript, line_no); shorter ones and rows without integer coordinates are dropped."""
    rows = read_lines(spark, path).where("value not like '#%'").where(F.size(F.split("value", "\t")) >= 9)
    a, b = _field(3).try_cast("int"), _field(4).try_cast("int")
    parent = F.split(F.coalesce(attribute(_field(8), "Parent"), attribute(_field(8), "transcript_id")), ",")
    got = rows.select(
        _field(0).alias("seqid"), _field(2).alias("type"), F.least(a, b).alias("start1"), F.greatest(a, b).alias("end1"),
        F.when(_field(6) == "-", "-").otherwise("+").alias("strand"), _field(8).alias("attrs"), F.get(parent, F.lit(0)).alias("transcript"), "line_no",
    )
    return got.where((F.col("type") == feature) & (F.col("start1") >= 1) & (F.col("end1") - F.col("start1") + 1 >= least))


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """Transcript to gene: (ID, Parent), else (ID, geneID), else (transcript_id, gene_id); the last line wins."""
    at = lambda k: attribute(_field(8), k)
    rows = read_lines(spark, path).where("value not like '#%'").where(F.size(F.split("value", "\t")) >= 9)
    tx = F.when(at("ID").isNotNull() & F.coalesce(at("Parent"), at("geneID")).isNotNull(), at("ID")).otherwise(at("transcript_id"))
    gene = F.when(at("ID").isNotNull(), F.coalesce(at("Parent"), at("geneID"))).otherwise(at("gene_id"))
    return rows.select(tx.alias("transcript"), gene.alias("gene"), "line_no").where("transcript is not null and gene is not null").groupBy("transcript").agg(F.max_by("gene", "line_no").alias("gene"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped records (line_no, qname, flag, rname, pos1, cigar, reverse, head, tail, aligned, span); malformed lines are passed over."""
    rows = read_lines(spark, path).where("value not like '@%'").where(F.size(F.split("value", "\t")) >= 6)
    got = rows.select("line_no", _field(0).alias("qname"), _field(1).try_cast("int").alias("flag"), _field(2).alias("rname"), _field(3).try_cast("int").alias("pos1"), _field(5).alias("cigar"))
    got = got.where("flag >= 0 and pos1 >= 0 and rname <> '*' and cigar <> '*'").withColumn("c", cigar_summary(F.col("cigar"))).where("c is not null")
    return got.select("line_no", "qname", "flag", "rname", "pos1", "cigar", is_reverse(F.col("flag")).alias("reverse"), "c.*")


def mapper_settings(spark: SparkSession, path: str) -> dict[str, int]:
    """What the header tells of the mapper: k, w, and scores A, B, O, E (with -O and -E both given, E is the first of -O)."""
    found = {"k": 15, "A": 2, "B": 4, "O": 4, "E": 2, "H": 0}
    header = read_lines(spark, path).where("value like '@PG%ID:minimap2%'")  # a line for each program run that made the file
    for r in header.orderBy("line_no").collect():
        words = r.value.split()
        for a, b in zip(words, words[1:]):
            if a in ("-k", "-A", "-B", "-O", "-E"):
                found[a[1]] = int(b.split(",")[0])
        found["H"] |= "-H" in words
        if "-O" in words and "-E" in words:
            found["E"] = found["O"]
    return found | {"w": int(0.666 * found["k"])}


PAIR_COLUMNS = "ref_gene string, ref_chr string, ref_id int, ref_start long, ref_end long, ref_strand string, query_gene string, query_chr string, query_id int, query_start long, query_end long, query_strand string, percent double"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """13 columns without a header; a row of another shape is an error."""
    rows = read_lines(spark, path).where("value not like '#%' and value <> ''")
    bad = F.raise_error(F.concat(F.col("file"), F.lit(":"), (F.col("line_no") + 1).cast("string"), F.lit(": expected 13 columns")))
    rows = rows.withColumn("value", F.when(F.size(F.split("value", "\t")) == 13, F.col("value")).otherwise(bad.cast("string")))
    cols = [_field(k).cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(PAIR_COLUMNS.split(", "))]
    got = rows.select("line_no", *cols)
    return got.withColumn("score", F.col("percent") / 100).withColumn("strand", F.when(F.col("ref_strand") == F.col("query_strand"), "+").otherwise("-"))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """A saved anchor file: blocks by their begin marks; interanchor rows are passed over; a score "1" is 1, any other 0."""
    lines = read_lines(spark, path)
    block = F.sum((F.col("value") == "#block begin").cast("int")).over(Window.partitionBy("file").orderBy("line_no"))
    rows = lines.withColumn("block", block).where("value not like '#%' and value not like 'refChr%'").where(_field(7) != "interanchor")
    names = ["ref_chr", "ref_start", "ref_end", "query_chr", "query_start", "query_end", "strand", "gene"]
    cols = [(_field(k).cast("long") if "start" in n or "end" in n else _field(k)).alias(n) for k, n in enumerate(names)]
    return rows.select("block", *cols, F.when(_field(9) == "1", 1.0).otherwise(0.0).alias("score"), "line_no")


def resumed_anchors(spark: SparkSession, path: str, command: str) -> DataFrame | None:
    """The anchors of a file that ``command`` has written whole: its first line is ``#`` and the command, and each block ends. Else None."""
    try:
        lines = read_lines(spark, path)
    except FileNotFoundError:
        return None
    first = lines.where("line_no = 0").select("value").first()
    n = lines.agg(F.sum((F.col("value") == "#block begin").cast("int")), F.sum((F.col("value") == "#block end").cast("int"))).first()
    if first is None or first.value != f"#{command}" or not n[0] or n[0] != n[1]:
        return None
    return read_anchors(spark, path)


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise blocks: (file, block, row, source, start0, size, strand, source_size, text). A block without exactly
    two rows of one width, or a row whose bases aren't as many as it says, is an error."""
    lines = read_lines(spark, path)
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("block", F.sum(F.col("value").rlike(r"^a(\s|$)").cast("int")).over(w)).where("value like 's%'")
    part = lambda k: F.get(F.split("value", r"\s+"), F.lit(k))
    got = rows.select("file", "block", "line_no", part(1).alias("source"), part(2).cast("long").alias("start0"), part(3).cast("long").alias("size"), part(4).alias("strand"), part(5).cast("long").alias("source_size"), part(6).alias("text"))
    b = Window.partitionBy("file", "block")
    got = got.withColumn("row", F.row_number().over(b.orderBy("line_no")) - 1).withColumn("n", F.count(F.lit(1)).over(b)).withColumn("widths", F.size(F.collect_set(F.char_length("text")).over(b)))
    fine = (F.col("n") == 2) & (F.col("widths") == 1) & (F.char_length(F.replace(F.col("text"), F.lit("-"), F.lit(""))) == F.col("size")) & F.col("strand").isin("+", "-") & (F.col("start0") + F.col("size") <= F.col("source_size")) & F.col("text").rlike("^[A-Za-z-]+$")
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(":"), (F.col("line_no") + 1).cast("string"), F.lit(": malformed alignment block")))
    return got.withColumn("text", F.when(fine, F.col("text")).otherwise(wrong.cast("string"))).drop("n", "widths", "line_no")


def _manifest(spark: SparkSession, path: str, header: list[str], version: str | None = None) -> DataFrame:
    lines = read_lines(spark, path).where("value <> ''")
    top = [r.value for r in lines.where("line_no < 2").orderBy("line_no").collect()]
    want = ([version] if version else []) + ["\t".join(header)]
    if top[: len(want)] != want:
        raise ValueError(f"{path}:1: expected the header {want}")
    rows = lines.where(F.col("line_no") >= len(want)).where("value not like '#%'")
    shape = F.raise_error(F.concat(F.lit(path + ":"), (F.col("line_no") + 1).cast("string"), F.lit(f": expected {len(header)} columns")))
    rows = rows.withColumn("value", F.when(F.size(F.split("value", "\t")) == len(header), F.col("value")).otherwise(shape.cast("string")))
    return rows.select("line_no", *[F.when(_field(k).isin("", "."), None).otherwise(_field(k)).alias(n) for k, n in enumerate(header)])


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """The taxon manifest; two ingroups, at most one of them the reference, and one primary outgroup."""
    rows = _manifest(spark, path, "taxon_id role fasta gff anchor_sam anchor_fasta callability_bed quality_weight".split()).withColumn("quality_weight", F.col("quality_weight").cast("double"))
    got = rows.collect()  # a handful of taxa
    roles = [r.role for r in got]
    ids = [r.taxon_id for r in got]
    if set(roles) - {"ingroup_reference", "ingroup", "primary_outgroup", "outgroup"}:
        raise ValueError(f"{path}: unknown role")
    if len(set(ids)) != len(ids) or any(i is None or "|" in i or " " in i for i in ids):
        raise ValueError(f"{path}: taxon ids must be unique, without bars or blanks")
    if sum(r.startswith("ingroup") for r in roles) != 2 or roles.count("ingroup_reference") > 1 or roles.count("primary_outgroup") != 1:
        raise ValueError(f"{path}: two ingroups and one primary outgroup are needed")
    if any(r.quality_weight is not None and r.quality_weight < 0 for r in got):
        raise ValueError(f"{path}: negative weight")
    return rows


def missing_pairs(pairs: DataFrame, role: dict[str, str], mode: str = "triangles") -> DataFrame:
    """(a, b), a before b, of the pairs of taxa that ``mode`` (triangles or complete) needs and ``pairs`` (a, b) has in neither order. The taxa are a manifest's, so few."""
    names = sorted(role)
    needed = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if mode == "complete" or role[a].startswith("ingroup") or role[b].startswith("ingroup")]
    want = pairs.sparkSession.createDataFrame(needed, "a string, b string")
    return want.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def read_pairwise(spark: SparkSession, path: str, taxa: DataFrame, mode: str = "triangles") -> DataFrame:
    """The pairwise manifest; all pairs that ``mode`` (triangles or complete) needs must be there, each once."""
    rows = _manifest(spark, path, "taxon_a taxon_b maf anchor_map score_profile weight".split()).withColumn("weight", F.col("weight").cast("double"))
    pairs = [frozenset((r.taxon_a, r.taxon_b)) for r in rows.collect()]
    role = {r.taxon_id: r.role for r in taxa.collect()}
    if any(len(p) != 2 or p - set(role) for p in pairs) or len(set(pairs)) != len(pairs):
        raise ValueError(f"{path}: pairs must be of two declared taxa, each pair once")
    missing = missing_pairs(rows.select(F.col("taxon_a").alias("a"), F.col("taxon_b").alias("b")), role, mode).collect()
    if missing:
        raise ValueError(f"{path}: missing pairs {sorted(tuple(r) for r in missing)}")
    return rows


BLOCK_COLUMNS = "projection_id taxon_id sequence block_id start0 end0 orientation source".split()


def read_block_projections(spark: SparkSession, path: str, version: str, segments: DataFrame | None = None) -> DataFrame:
    """An id that is left out is made from the row; a bad orientation or interval, an id twice or, with ``segments`` (path, first, last;
    a path is taxon|sequence), a block that doesn't lie on one of them is an error."""
    from locusframe.operators.evidence import stable_id

    rows = _manifest(spark, path, BLOCK_COLUMNS, version)
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("start0", "end0")}).withColumn("orientation", F.coalesce("orientation", F.lit("?")))
    own = stable_id("projection", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in BLOCK_COLUMNS[1:7]])
    rows = rows.withColumn("projection_id", F.coalesce("projection_id", own)).withColumn("path", F.concat_ws("|", "taxon_id", "sequence"))
    bad = {"an orientation other than +, - and ?": rows.where("orientation not in ('+', '-', '?')"), "an empty or negative interval": rows.where("not coalesce(start0 >= 0 and end0 > start0, false)"), "an id twice": rows.groupBy("projection_id").count().where("count > 1")}
    if segments is not None:
        on = rows.join(segments, "path").where("start0 >= first and end0 - 1 <= last").select("projection_id")
        bad["a block that lies on no path"] = rows.join(on, "projection_id", "left_anti")
    for what, found in bad.items():
        if not found.isEmpty():
            raise ValueError(f"{path}: {what}")
    return rows


COPY_COLUMNS = "record_type family_id ancestral_copy_id parent_copy_id born_on_edge taxon_id member_type member_id seq start0 end0 strand expected_count relation confidence constraint source".split()


def read_copy_relations(spark: SparkSession, path: str, version: str) -> DataFrame:
    """GROUP, MEMBER and COUNT records. A group given twice, a member of two groups by hard relation, a confidence outside
    0 to 1 or a record of another kind is an error."""
    rows = _manifest(spark, path, COPY_COLUMNS, version)
    rows = rows.withColumns({**{c: F.col(c).cast("long") for c in ("start0", "end0", "expected_count")}, "confidence": F.col("confidence").cast("double")})
    bad = {
        "an unknown record": rows.where("record_type not in ('GROUP', 'MEMBER', 'COUNT')"),
        "a confidence outside 0 to 1": rows.where("confidence < 0 or confidence > 1"),
        "a group twice": rows.where("record_type = 'GROUP'").groupBy("family_id", "ancestral_copy_id").count().where("count > 1"),
        "contradictory hard relations": rows.where("record_type = 'MEMBER' and constraint = 'hard' and relation <> 'excluded'").groupBy("taxon_id", "member_type", "member_id").agg(F.countDistinct("family_id", "ancestral_copy_id").alias("n")).where("n > 1"),
        "a group without its names": rows.where("record_type = 'GROUP' and (family_id is null or ancestral_copy_id is null)"),
        "a member without its group, taxon, kind or relation": rows.where("record_type = 'MEMBER' and (family_id is null or ancestral_copy_id is null or taxon_id is null or not coalesce(relation in ('ortholog', 'coortholog', 'excluded'), false) or not coalesce(constraint in ('hard', 'soft'), false))"),
        "an anchor without an id": rows.where("record_type = 'MEMBER' and member_type = 'anchor' and member_id is null"),
        "an interval without its place": rows.where("record_type = 'MEMBER' and member_type = 'interval' and not coalesce(seq is not null and start0 >= 0 and end0 > start0, false)"),
        "a member of another kind": rows.where("record_type = 'MEMBER' and not coalesce(member_type in ('anchor', 'interval'), false)"),
        "a member twice": rows.where("record_type = 'MEMBER'").groupBy("family_id", "ancestral_copy_id", "taxon_id", "member_type", "member_id", "seq", "start0", "end0").count().where("count > 1"),
        "a count of nothing": rows.where("record_type = 'COUNT' and (family_id is null or taxon_id is null)"),
        "a count without a number": rows.where("record_type = 'COUNT' and (expected_count is null or expected_count < 0)"),
    }
    for what, found in bad.items():
        if found.limit(1).count():
            raise ValueError(f"{path}: {what}")
    return rows


def capacities(spark: SparkSession, items: list[str]) -> DataFrame:
    """(taxon, family, expected) from options ``TAXON=N`` and ``FAMILY:TAXON=N``; family is null in the first form."""
    rows = []
    for item in items:
        name, _, n = item.rpartition("=")
        family, _, taxon = name.rpartition(":")
        if not taxon or not n.isdigit():
            raise ValueError(f"{item}: expected TAXON=N or FAMILY:TAXON=N")
        rows.append((taxon, family or None, int(n)))
    return spark.createDataFrame(rows, "taxon string, family string, expected long")
