"""SimHash near-dedup (operator 5): fingerprints linked through shared blocks of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import by_key, drop_rows, id_text, keyed, out, signed, surplus, texts
from locusframe.operators.components import components
from locusframe.plans.runtime import cut, ship

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: The 64 bits in this many blocks: a pair within DISTANCE agrees in BLOCKS - DISTANCE of them.
BLOCKS = 5
#: Fingerprints that share blocks are compared pair by pair up to this many, beyond it through hubs.
PAIRWISE = 512
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text: A-Z lower-cased, split at ASCII white space; no words: zero.

    The shingles are slices of the words joined by one space. Bits are counted in
    steps of 65,536 shingles, so memory does not depend on the length beyond the text.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    m = n - shingle + 1
    h = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for k in range(0, m, 65536):
        top = min(m, k + 65536)
        got = b"".join([h(flat[i:j], SEED) for i, j in zip(starts[k:top], ends[k + shingle - 1 : top + shingle - 1])])
        table = np.frombuffer(got, np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(table[:, c], minlength=256) @ _BITS for c in range(8)])
    return int.from_bytes(np.packbits(2 * counts > m).tobytes(), "big")


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        yield from out(_SCHEMA, [(i, signed(fingerprint(t))) for i, t in zip(ids, texts(batch))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, a row per row of docs; fp is the unsigned fingerprint's bits as a long."""
    ship(docs.sparkSession)
    return id_text(docs).mapInArrow(_map, "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [signed(sum(c)) for c in combinations(parts, blocks - distance)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _hubs(hot: DataFrame, distance: int) -> DataFrame:
    """Links among many fingerprints that share blocks, without comparing pairs.

    Two values within 3 bits have a value between them within 1 bit of the one and 2 of
    the other. Each fingerprint goes to all values within 2 bits of it (in the bits its
    group does not share): if one of those at a value is within 1 bit of it, all that
    meet there are truly linked to that one; else the value links nothing. Connectivity
    is that of all pairs, rows grow linearly with the group.
    """
    assert distance == 3, "hubs are for distance 3"
    free = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: b.bitwiseAND(F.col("mask")) == 0)
    ones = F.transform("free", lambda b: F.struct(b.alias("flip"), F.lit(1).alias("r")))
    twos = F.flatten(F.transform("free", lambda a: F.transform(F.filter("free", lambda b: F.shiftrightunsigned(b, 1) >= a), lambda b: F.struct(a.bitwiseOR(b).alias("flip"), F.lit(2).alias("r")))))
    none = F.array(F.struct(F.lit(0).cast("long").alias("flip"), F.lit(0).alias("r")))
    spread = hot.withColumn("free", free).withColumn("s", F.explode(F.concat(none, ones, twos)))
    spread = spread.select("mask", "fp", F.col("fp").bitwiseXOR(F.col("s.flip")).alias("hub"), F.col("s.r").alias("r"))
    near = spread.where("r <= 1").groupBy("mask", "hub").agg(F.min("fp").alias("center"))
    return spread.join(near, ["mask", "hub"]).where("fp <> center").select(F.least("fp", "center").alias("a"), F.greatest("fp", "center").alias("b")).distinct()


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """``(a, b)`` between distinct fingerprints ``fp``, with the connectivity of all pairs within ``distance`` bits.

    By the pigeonhole principle such a pair agrees in ``blocks - distance`` of the blocks,
    so it meets in the join on one of their combinations, where the distance is verified.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks, distance)])
    keyed = distinct.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = cut(sizes, "simhash-groups")
    shared = cut(keyed.join(sizes, ["mask", "part"]), "simhash-shared")
    few, many = shared.where(F.col("n") <= pairwise), shared.where(F.col("n") > pairwise)
    other = few.select(F.col("mask").alias("m2"), F.col("part").alias("p2"), F.col("fp").alias("b"))
    same = (F.col("mask") == F.col("m2")) & (F.col("part") == F.col("p2"))
    found = few.select("mask", "part", F.col("fp").alias("a")).join(other, same & (F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= distance)).select("a", "b").distinct()
    if many.limit(1).count():
        found = found.union(_hubs(many.select("mask", "fp"), distance))
    return found


def simhash_classes(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row per row of docs.

    component_id is the smallest doc_id reachable over links of ``distance`` bits or
    fewer. Null text counts as empty (fingerprint zero, linked like any other). A null
    doc_id is reachable but never the smallest; a component of such rows alone has null.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    # a row per fingerprint, whose smallest id stands for it; copies are linked by that alone
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = cut(links(distinct, distance, blocks, pairwise), "simhash-links")
    near = components(found, "a", "b")
    of = distinct.join(near, distinct.fp == near.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = of.join(least, "root").select(F.col("fp").alias("kfp"), "component_id")
    return prints.join(known, prints.fp == known.kfp).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of smallest doc_id.

    Every row is judged by its own text, whatever its id: rows that share an id or have
    none (null last in the order) are told apart by :func:`locusframe.llm.common.keyed`.
    All columns stay. An empty table gives an empty result.
    """
    rows, key = keyed(docs)
    classes = simhash_classes(by_key(rows, key)).select("doc_id", F.col("component_id").alias("grp"))
    return drop_rows(rows, key, surplus(classes, rows, key), "near-dropped")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
