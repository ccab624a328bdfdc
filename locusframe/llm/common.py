"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.plans.runtime import cut

#: ASCII white space, as a Java character class: space, tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A null id gives null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def crc_mod_py(doc_id: int | None, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of strings as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def id_text(docs: DataFrame) -> DataFrame:
    """Just (doc_id long, text string): other columns, whatever their names, go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def out(schema: pa.Schema, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)


def signed(x: int) -> int:
    """An unsigned 64-bit number as the long of the same bits."""
    return x - (1 << 64) if x >> 63 else x


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as bytes, planes of equal significance together, compressed; length first."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def spread(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def trim() -> None:
    """Gives the system back what this process has freed, and lets arrays of a megabyte go at once from now on.

    Python workers are kept between tasks, sometimes more of them than there are cores; else each would hold its largest task's memory.
    """
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with what is freed
        libc.malloc_trim(0)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column, without nulls or repeats, that tells its rows apart.

    That is doc_id, if no row lacks one or shares one. Else rows are numbered, in a column
    whose name docs does not have, and written, so that the numbers are the same on every read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shared = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text) with ``key`` as the doc_id: what an operator needs to judge each row by itself."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def surplus(classes: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The keys (``_drop``) of all rows but one of each class. classes: (doc_id, grp), where doc_id holds ``key`` of docs.

    The row of smallest doc_id stays, null last, of equals the first. If ids tell the rows
    apart, grp must be the smallest of its class. Groups are only reduced, never gathered.
    """
    if key == "doc_id":
        return classes.where("doc_id <> grp").select(F.col("doc_id").alias("_drop"))
    ids = docs.select(F.col(key).alias("_key"), F.col("doc_id").cast("long").alias("_id"))
    named = cut(classes.join(ids, classes.doc_id == ids["_key"]).select("grp", "_key", "_id"), "members")
    best = named.groupBy("grp").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_key"))).alias("m")).select(F.col("m._key").alias("_best"))
    return named.join(best, F.col("_key") == F.col("_best"), "left_anti").select(F.col("_key").alias("_drop"))


def drop_rows(docs: DataFrame, key: str, dropped: DataFrame, label: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped`` (one column, ``_drop``), nor the key if :func:`keyed` made it.

    ``dropped`` is written first: Spark broadcasts it if its size is below its threshold
    and shuffles both sides otherwise.
    """
    gone = cut(dropped, label)
    left = docs.join(gone, docs[key].cast("long") == gone["_drop"], "left_anti")
    return left if key == "doc_id" else left.drop(key)
