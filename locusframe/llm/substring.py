"""Substring dedup (operator 3): repeated paragraphs and passages.

Paragraphs (lines of ``SHINGLE`` words or more) are banded by MinHash over five-word
shingles; paragraphs that collide in a band are compared by exact Jaccard similarity, and
removals follow the connected components. A passage inside a longer paragraph leaves that
paragraph unlike any other, which no banding of paragraphs can see: so texts are also cut
at places that their own words choose (minima of a rolling hash), and runs of segments
that stand in other documents too are passages, by equality. Segments at the ends of a
passage are cut by what surrounds it, so those under about 50 words are often missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import id_text, signed, spread, squeeze, texts
from locusframe.operators.components import components
from locusframe.plans.runtime import cut, ship

#: Words of a passage, at least; a paragraph needs one shingle.
LEAST_WORDS = 28
SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares one of 12 bands of 4 with probability 0.998.
BANDS, ROWS = 12, 4
#: Paragraphs of a band that are compared pair by pair, at most. In larger groups each is first compared with the two nearest in order
#: and the most central; a group that these links leave in several components goes through an exact join (:func:`_across`).
PAIRWISE = 32
#: Paragraphs of such a group that are put in order within one task, about.
PART = 1024
#: Counters by which that join orders shingles, as a power of two.
FREQUENCY_BITS = 18
#: Words on each side within which a segment's first word has the smallest hash.
RADIUS = 3
CHUNK_BYTES, RANGE_SEGMENTS = 12 << 20, 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M = np.uint64(0xFF51AFD7ED558CCD)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Words:
    """Of a text: the hash of each lower-case word, and where it starts and ends, in code points; and its line."""

    def __init__(self, text: bytes, hashes: WordHashes):
        words = text.lower().split()
        n = len(words)
        self.h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.start, self.end = point[starts], point[ends]
        self.line = np.searchsorted(np.flatnonzero(raw == 10), starts)


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = (total ^ h[i : i + n]) * _M + _B
    return total ^ (total >> np.uint64(31))


# ---------------------------------------------------------------- paragraphs

_PARAGRAPH = "doc_id long, start long, end long, n_words long, h long, bands array<long>, words binary"


def _paragraphs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            w = Words(text, hashes)
            if len(w.h) < least:
                continue
            first = np.flatnonzero(np.diff(w.line, prepend=-1))
            s = _rolled(w.h, SHINGLE)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(w.h)]):
                if b - a >= least:
                    rows.append((doc_id, int(w.start[a]), int(w.end[b - 1]), b - a, signed(xxhash.xxh64_intdigest(w.h[a:b].tobytes())), s[a : b - SHINGLE + 1]))
        for k in range(0, len(rows), 512):
            part = rows[k : k + 512]
            shingles = np.concatenate([r[5] for r in part])
            at = np.cumsum([0] + [len(r[5]) for r in part[:-1]])
            sig = np.stack([np.minimum.reduceat((shingles ^ b) * a, at) for a, b in _SEEDS.T], 1).reshape(len(part), BANDS, ROWS)
            band = np.zeros((len(part), BANDS), np.uint64)
            for r in range(ROWS):
                band = (band ^ sig[:, :, r]) * _M + _B
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in part], pa.int64()) for c in range(5)), pa.array(band.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array([np.unique((r[5] >> np.uint64(32)).astype(np.uint32)).tobytes() for r in part], pa.binary())],
                ["doc_id", "start", "end", "n_words", "h", "bands", "words"],
            )


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)  # two shingles of a pair hash alike once in a million pairs
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both))
        yield batch.filter(pa.array(keep)).select([0, 1])


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles * np.uint32(0x9E3779B1)) >> np.uint32(32 - FREQUENCY_BITS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            np.add.at(total, _bucket(np.frombuffer(x, np.uint32)), 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "f"])


def _prefixes(batches: Iterator[pa.RecordBatch], least: float, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, lab, n, s, at, indexed) for the first shingles of each set, in the order of counted frequency and then of value."""
    for batch in batches:
        for h, lab, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(words, np.uint32)
            n = len(x)
            # a little more than the exact lengths, so that rounding loses nothing
            probe = int((1 - least) * n + 1e-6) + 1
            index = int((1 - 2 * least / (1 + least)) * n + 1e-6) + 1
            s = x[np.lexsort((x, often[_bucket(x)]))[:probe]].view(np.int32)
            k = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, h)), pa.array(np.full(k, lab)), pa.array(np.full(k, n), pa.int32()), pa.array(s), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.arange(k) < index)], ["h", "lab", "n", "s", "at", "indexed"])


def _across(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different ``lab`` that may be similar; none that is similar is missing. sets: h, lab, words.

    Prefix filter: in any one order of shingles, similar sets share one among the first (1 - least) n + 1 of the
    larger and the first n - 2 least n / (1 + least) + 1 of the smaller. The rarest come first, by counters of a fixed
    number, so that sets of a template that differ by more than the threshold meet only in what they have in
    common, which comes last, and give no pairs. Rows of the label that is commonest at a shingle are not joined with each other.
    """
    often = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for bucket, f in sets.select("words").mapInArrow(_counts, "bucket int, f long").groupBy("bucket").agg(F.sum("f")).collect():
        often[bucket] = f
    firsts = cut(sets.mapInArrow(lambda it: _prefixes(it, least, often), "h long, lab long, n int, s int, at int, indexed boolean"), "paragraph-prefixes")
    labs = firsts.groupBy("s", "lab").agg(F.count(F.lit(1)).alias("rows")).groupBy("s").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.max_by("lab", F.struct("rows", "lab")).alias("major"))
    mixed = cut(firsts.join(labs.where("lo < hi").select("s", "major"), "s").withColumn("main", F.col("lab") == F.col("major")).drop("major"), "paragraph-mixed")
    x = mixed.select("s", *[F.col(c).alias(f"x_{c}") for c in ("h", "lab", "n", "at", "main")])
    y = mixed.where("indexed").select("s", *[F.col(c).alias(f"y_{c}") for c in ("h", "lab", "n", "at", "main")])
    n, need = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")), least / (1 + least) * (F.col("x_n") + F.col("y_n")) - 1e-6
    # nothing is shared before the first shingle in common, so the pair has at most what is left of the shorter from there; at later ones less is left
    fits = (F.col("x_lab") != F.col("y_lab")) & (F.struct("y_n", "y_h") < F.struct("x_n", "x_h")) & (F.col("y_n") >= least * F.col("x_n") - 1e-6) & (n >= need)
    met = x.join(y.where("not y_main"), "s").where(fits).union(x.where("not x_main").join(y.where("y_main"), "s").where(fits))
    return met.select(F.least("x_h", "y_h").alias("a"), F.greatest("x_h", "y_h").alias("b")).distinct()


def paragraph_classes(docs: DataFrame, least: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, start, end, n_words, class_id)`` for paragraphs that have an equal or similar one in another document.

    Equal paragraphs are one from the start, so a paragraph that is everywhere costs one
    row per task. class_id: the smallest doc_id of the component.
    """
    ship(docs.sparkSession)
    all_rows = cut(id_text(docs).where("doc_id is not null").mapInArrow(lambda it: _paragraphs(it, max(least, SHINGLE)), _PARAGRAPH), "paragraphs")
    first = F.min(F.struct("doc_id", "start"))  # where a paragraph stands first
    distinct = cut(all_rows.groupBy("h").agg(first["doc_id"].alias("rep"), first["start"].alias("at"), F.max("doc_id").alias("last"), F.any_value("bands").alias("bands")), "distinct-paragraphs")
    banded = distinct.select("h", F.posexplode("bands").alias("band", "key"))
    sizes = cut(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "paragraph-bands")
    met = cut(banded.join(sizes, ["band", "key"]), "paragraph-collisions")
    few = met.where(F.col("m") <= PAIRWISE).select("band", "key", F.col("h").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), ["band", "key"]).where("a < b").select("a", "b")
    # the more others a paragraph meets in all its bands, the nearer it is to what the group has in common
    large = met.where(F.col("m") > PAIRWISE)
    many = cut(large.join(large.groupBy("h").agg(F.sum("m").alias("meets")), "h"), "paragraph-crowds")
    hubs = many.groupBy("band", "key").agg(F.max_by("h", F.struct("meets", "h")).alias("first"))
    # a crowd of any size is dealt to tasks in parts of about PART paragraphs
    order = Window.partitionBy("band", "key", F.pmod(F.xxhash64("h"), F.ceil(F.col("m") / PART))).orderBy("h")
    near = many.join(hubs, ["band", "key"]).select("h", "first", F.lag("h", 1).over(order).alias("p1"), F.lag("h", 2).over(order).alias("p2"))
    near = near.select(F.explode(F.array("first", "p1", "p2")).alias("a"), F.col("h").alias("b")).where("a is not null and a <> b")
    pairs = cut(pairs.union(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "paragraph-pairs")
    needed = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    needed = distinct.join(needed, "h", "left_semi").select("h", F.col("rep").alias("doc_id"), F.col("at").alias("start"))
    # a row each, but for rows that share an id
    held = cut(all_rows.select("h", "doc_id", "start", "words").join(needed, ["h", "doc_id", "start"], "left_semi").groupBy("h").agg(F.any_value("words").alias("words")), "paragraph-words")
    side = lambda c: held.select(F.col("h").alias(c), F.col("words").alias(f"w{c}"))
    verify = lambda p: p.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb").mapInArrow(lambda it: _similar(it, similarity), "a long, b long")
    links = cut(verify(pairs), "paragraph-links")
    linked = components(links, "a", "b")
    tagged = many.join(linked, many.h == linked.node, "left").select("band", "key", "h", F.coalesce("label", "h").alias("lab"))
    split = tagged.groupBy("band", "key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo < hi")
    rest = cut(tagged.join(split, ["band", "key"], "left_semi").select("h", "lab").distinct(), "paragraph-rest")
    if not rest.isEmpty():
        more = cut(_across(rest.join(held, "h").select("h", "lab", "words"), similarity), "paragraph-pairs")
        linked = components(cut(links.union(verify(more)), "paragraph-links"), "a", "b")
    of = distinct.join(linked, distinct.h == linked.node, "left").where("rep < last or label is not null").select("h", "rep", "last", F.coalesce("label", "h").alias("root"))
    of = cut(of, "paragraph-classes")
    least_id = of.groupBy("root").agg(F.min("rep").alias("class_id"), F.max("last").alias("last_id")).where("class_id < last_id")
    known = of.join(least_id, "root").select(F.col("h").alias("kh"), "class_id")
    return all_rows.join(known, all_rows.h == known.kh).select("doc_id", "start", "end", "n_words", "class_id")


# ---------------------------------------------------------------- passages inside paragraphs

_CHUNK = "chunk long, ids array<long>, counts binary, starts binary, ends binary, sizes binary, hashes binary"


class Powers:
    def __init__(self) -> None:
        self.grow(1024)

    def grow(self, n: int) -> None:
        self.up = np.cumprod(np.full(n, _B)) * _B_INVERSE
        self.down = np.cumprod(np.full(n, _B_INVERSE)) * _B


def segments(w: Words, powers: Powers, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """First words of the segments (and the number of words at the end), and a hash of each segment's words.

    A segment begins where the hash of three words is the smallest within ``radius`` words
    on both sides (the first of equals), so the same words are cut in the same way in any text.
    """
    n = len(w.h)
    g = _rolled(w.h, 3)
    if len(g) == 0:
        first = np.zeros(1, np.int64)
    else:
        pad = np.full(radius, np.iinfo(np.uint64).max, np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, g, pad]), 2 * radius + 1)
        first = np.flatnonzero(view.argmin(1) == radius)
        if not len(first) or first[0]:
            first = np.concatenate([[0], first])
    if n + 1 > len(powers.up):
        powers.grow(2 * n + 2)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.h * powers.up[:n])])
    ends = np.append(first[1:], n)
    h = (total[ends] - total[first]) * powers.down[first] + (ends - first).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * _M
    return np.append(first, n), h ^ (h >> np.uint64(32))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number, held = TaskContext.get().partitionId() << 24, 0
    hashes, powers = WordHashes(), Powers()
    ids: list[int] = []
    parts: list[tuple] = []

    def emit() -> pa.RecordBatch:
        starts, ends, sizes, h = (np.concatenate(x) for x in zip(*(p[1:] for p in parts)))
        cells = [squeeze(np.array([p[0] for p in parts], np.int32)), *(squeeze(x.astype(np.int32)) for x in (starts, ends, sizes)), h.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)], ["chunk", "ids", "counts", "starts", "ends", "sizes", "hashes"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            w = Words(text, hashes)
            if not len(w.h):
                continue
            first, h = segments(w, powers)
            ids.append(doc_id)
            parts.append((len(h), w.start[first[:-1]], w.end[first[1:] - 1], np.diff(first), h))
            held += len(text)
            if held >= size:
                yield emit()
                number, held, ids, parts = number + 1, 0, [], []
    if ids:
        yield emit()


def _owners(ids: list[int], counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.array(ids, np.int64), counts)


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            h = np.frombuffer(r["hashes"], np.uint64)
            doc = _owners(r["ids"], spread(r["counts"], np.int32))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            low, high, h = doc[new], doc[np.append(new[1:], len(doc)) - 1], h[new]
            ends = np.searchsorted(h >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64), side="right") if bits else np.array([len(h)])
            at, rows = 0, []
            for part, end in enumerate(ends.tolist()):
                if end > at:
                    rows.append((part, r["chunk"], h[at:end].tobytes(), squeeze(low[at:end]), squeeze(high[at:end])))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "hashes", "low", "high"])


def _answer(asked: pa.Table) -> pa.Table:
    """For each segment of each chunk: is it in more than one document, and which is the first of them."""
    hashes = [np.frombuffer(x, np.uint64) for x in asked["hashes"].to_pylist()]
    low, high = (np.concatenate([spread(x, np.int64) for x in asked[c].to_pylist()]) for c in ("low", "high"))
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    first, last = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(first, inverse, low)
    np.maximum.at(last, inverse, high)
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    again, owner = np.split((first < last)[inverse], cuts), np.split(first[inverse], cuts)
    n = len(hashes)
    return pa.table(
        [pa.array([asked["part"][0].as_py()] * n, pa.int32()), asked["chunk"].combine_chunks(), pa.array([squeeze(a) for a in again], pa.binary()), pa.array([squeeze(o[a]) for o, a in zip(owner, again)], pa.binary())],
        ["part", "chunk", "again", "owner"],
    )


def _runs(left: pa.Table, right: pa.Table, least: int) -> pa.Table:
    r = left.to_pylist()[0]
    h, counts = np.frombuffer(r["hashes"], np.uint64), spread(r["counts"], np.int32)
    starts, ends, sizes = (spread(r[c], np.int32).astype(np.int64) for c in ("starts", "ends", "sizes"))
    got = sorted(zip(right["part"].to_pylist(), right["again"].to_pylist(), right["owner"].to_pylist()))
    distinct, inverse = np.unique(h, return_inverse=True)
    again = np.concatenate([spread(a, bool) for _, a, _ in got])
    owner = np.zeros(len(distinct), np.int64)
    owner[again] = np.concatenate([spread(o, np.int64) for _, _, o in got])
    hit, owner = again[inverse], owner[inverse]
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(hit)
    head = hit & np.concatenate([[True], ~hit[:-1] | (doc[1:] != doc[:-1])])
    tail = hit & np.concatenate([~hit[1:] | (doc[1:] != doc[:-1]), [True]])
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    words = np.concatenate([[0], np.cumsum(sizes)])
    long = words[b + 1] - words[a] >= least
    a, b = a[long], b[long]
    ids = np.array(r["ids"], np.int64)
    flat = np.stack([a, b + 1], 1).ravel()
    first = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), flat)[::2] if n and len(a) else np.zeros(0, np.int64)
    return pa.table([pa.array(x, pa.int64()) for x in (ids[doc[a]], starts[a], ends[b], words[b + 1] - words[a], first)], ["doc_id", "start", "end", "n_words", "class_id"])


def passage_classes(docs: DataFrame, least: int = LEAST_WORDS, chunk_bytes: int = CHUNK_BYTES, range_segments: int = RANGE_SEGMENTS) -> DataFrame:
    """``(doc_id, start, end, n_words, class_id)``: runs of ``least`` words or more whose segments all stand in other documents too.

    class_id: the smallest doc_id that holds one of the segments. Chunks of documents ask
    for their distinct segments, ranges of hashes answer, as in LM scoring, so a passage that is
    everywhere costs one entry per chunk.
    """
    ship(docs.sparkSession)
    table = cut(id_text(docs).where("doc_id is not null").mapInArrow(lambda it: _chunks(it, chunk_bytes), _CHUNK), "passage-chunks")
    total = table.agg(F.coalesce(F.sum(F.length("hashes") / 8), F.lit(0.0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, total / range_segments)))))
    asked = table.select("chunk", "ids", "counts", "hashes").mapInArrow(lambda it: _ask(it, bits), "part int, chunk long, hashes binary, low binary, high binary")
    answers = cut(asked.groupBy("part").applyInArrow(_answer, "part int, chunk long, again binary, owner binary"), "passage-answers")
    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: _runs(a, b, least), "doc_id long, start long, end long, n_words long, class_id long")


def repeats(docs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, start, end, n_words, class_id, kind, removed)``: the repeated paragraphs and passages of docs.

    Places are code points, end exclusive. ``removed``: not in the document of the smallest
    id. Passages have ``least`` words or more, paragraphs ``SHINGLE``. Null texts have none; rows of null id are
    left out; rows that share a doc_id count as one document, and what a document repeats
    only within itself is left alone.
    """
    rows = paragraph_classes(docs, similarity=similarity).withColumn("kind", F.lit("paragraph"))
    rows = rows.union(passage_classes(docs, least).withColumn("kind", F.lit("passage")))
    return rows.withColumn("removed", F.col("doc_id") > F.col("class_id"))
