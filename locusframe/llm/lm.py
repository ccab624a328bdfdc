"""LM scoring (operator 9): deleted interpolation of unigrams and bigrams.

P(w | v) = a_b c(v w) / c(v) + b_b c(w) / N + g_b / (V + 1), where b is the bucket of the
context's frequency. The weights of each bucket come from expectation-maximisation on
deleted counts: every training token is held out in turn, that is, predicted from counts
less its own.

Texts are tokenised once, into chunks: a chunk holds its documents' tokens as numbers in
a vocabulary of its own, and is one row of a written table. A chunk asks for the counts of
its distinct n-grams, by 64-bit hashes, sorted, a blob for each range of hashes; each
range adds up what all chunks sent and answers each with counts in the same order. So a
word or pair that is everywhere costs one entry per chunk, and no row per token is ever
shuffled. Where ranges are so many that a chunk would have few n-grams for each, n-grams are dealt
in two steps: chunks ask super-ranges, slice by slice of chunks each merges what it was asked,
asks the ranges within it, and gives the answers back; so no blob is ever small. Unequal n-grams are taken for one if their 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import crc_mod_py, id_text, out, spread, squeeze, texts, trim
from locusframe.plans.runtime import cut, ship

#: UTF-8 bytes of text in a chunk (a longer document is a chunk by itself), and n-grams in a range of hashes, about.
CHUNK_BYTES, RANGE_NGRAMS = 8 << 20, 1 << 20
#: Ranges that a chunk deals its n-grams to, at most, as a power of two, and chunks whose questions a slice of a super-range merges, about.
DEAL_BITS, SLICE_CHUNKS = 12, 4096
#: Context-frequency buckets (powers of two), and cells of a logarithmic ratio in the table that EM runs on.
BUCKETS, CELLS, CELL = 16, 48, 0.5
EM_ROUNDS, FLOOR = 60, 1e-4
#: Smoothing of the base score.
BASE = 0.5
_END, _START = b" ", b"  "  # no word holds a space
_MIX = np.uint64(0x9FB21C651E98DF25)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNK = "chunk long, ids array<long>, lens binary, train binary, tokens binary, words binary, n_train long, d_train long"


def _chunks(batches: Iterator[pa.RecordBatch], size: int, held_out: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    ids, lens, train, parts, held = [], [], [], [], 0
    index = _Index()

    def emit() -> pa.RecordBatch:
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
        n, t = np.array(lens, np.int32), np.array(train, bool)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([squeeze(n)], pa.binary()), pa.array([squeeze(t)], pa.binary()),
                pa.array([squeeze(np.concatenate(parts))], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([int(n[t].sum())]), pa.array([int(t.sum())]),
            ],
            ["chunk", "ids", "lens", "train", "tokens", "words", "n_train", "d_train"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            if not ids:
                index[_END], index[_START] = 0, 1
            words = text.lower().split()
            words.append(_END)
            parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            ids.append(doc_id)
            lens.append(len(words))
            train.append(crc_mod_py(doc_id, held_out[0]) != held_out[1])
            held += len(text)
            if held >= size:
                yield emit()
                number += 1
                ids, lens, train, parts, held = [], [], [], [], 0
                index.clear()
                trim()
    if ids:
        yield emit()
    ids, lens, train, parts = [], [], [], []
    index.clear()
    trim()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and each key's place among them, as np.unique gives them in twice the memory."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    place = np.empty(len(order), np.int32 if len(keys) < 1 << 31 else np.int64)
    place[order] = np.cumsum(new, dtype=place.dtype) - place.dtype.type(1)
    return keys, place


class _Chunk:
    """A chunk read back: per token its word, the word before it, and its place among the distinct pairs."""

    def __init__(self, lens: bytes, train: bytes, tokens: bytes, words: bytes):
        self.lens = spread(lens, np.int32)
        self.train = spread(train, bool)
        self.tokens = spread(tokens, np.int32)
        self.words = np.frombuffer(words, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = 1  # the start sign
        self.in_train = np.repeat(self.train, self.lens)
        pairs, self.pair = _distinct(self.before.astype(np.int64) * len(self.words) + self.tokens)
        a, b = self.words[pairs // len(self.words)], self.words[pairs % len(self.words)]
        h = (a ^ (a >> np.uint64(31))) * _MIX + b
        h ^= h >> np.uint64(28)
        h *= _MIX
        self.hashes = (self.words, h ^ (h >> np.uint64(28)))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training documents of this chunk: of its words, and of its pairs."""
        return (
            np.bincount(self.tokens[self.in_train], minlength=len(self.words)).astype(np.uint32),
            np.bincount(self.pair[self.in_train], minlength=len(self.hashes[1])).astype(np.uint32),
        )


_ASK = "kind int, part long, chunk long, hashes binary, counts binary"
_ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _dealt(kind: int, asker: int, h: np.ndarray, n: np.ndarray, bits: int) -> list[tuple]:
    """Sorted hashes with their counts as rows of _ASK, one for each range of ``bits`` leading bits that has some."""
    if not len(h):
        return []
    part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(kind, int(part[a]), asker, h[a:b].tobytes(), squeeze(n[a:b])) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(h)])]


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lens", "train", "tokens", "words")), strict=True):
            c = _Chunk(*blobs)
            both = list(zip(c.hashes, c.counts(), strict=True))
            del c, blobs
            for kind, (h, n) in enumerate(both):
                order = np.argsort(h, kind="stable")
                yield from out(_ASKED, _dealt(kind, chunk, h[order], n[order], bits))
            del both, h, n, order
            trim()


def _merged(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's questions: the distinct hashes, sorted, their counts added up, where each question's are among them, and where each question ends."""
    hashes = [np.frombuffer(x, np.uint64) for x in asked["hashes"].to_pylist()]
    counts = np.concatenate([spread(x, np.uint32) for x in asked["counts"].to_pylist()])
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)), inverse, np.cumsum([len(h) for h in hashes])[:-1]


def _ask_on(asked: pa.Table, bits: int) -> pa.Table:
    """A slice of a super-range asks the ranges within it what its chunks have asked; it is named by its first chunk."""
    asked = asked.sort_by("chunk")
    h, n, _, _ = _merged(asked)
    return pa.Table.from_batches(list(out(_ASKED, _dealt(asked["kind"][0].as_py(), asked["slice"][0].as_py(), h, n.astype(np.uint64), bits))), _ASKED)


def _give_back(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a slice, for each of its chunks in its own order."""
    asked = asked.sort_by("chunk")
    _, _, inverse, cuts = _merged(asked)
    totals = np.concatenate([spread(t, np.int64) for _, t in sorted(zip(answers["part"].to_pylist(), answers["totals"].to_pylist()))])
    mine = np.split(totals[inverse], cuts)
    return pa.table([asked["kind"], asked["part"], asked["chunk"], pa.array([squeeze(m) for m in mine], pa.binary()), pa.array(np.zeros(len(mine), np.int64))], ["kind", "part", "chunk", "totals", "n_distinct"])


_ANSWER = "kind int, part long, chunk long, totals binary, n_distinct long"


def _answer(asked: pa.Table, kind: type = np.uint32) -> pa.Table:
    """Of one range of hashes: the totals over all chunks, for each chunk in its order; and how many n-grams have any."""
    trim()
    hashes = [np.frombuffer(x, np.uint64) for x in asked["hashes"].to_pylist()]
    counts = np.concatenate([spread(x, kind) for x in asked["counts"].to_pylist()])
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(inverse, counts, len(distinct))
    mine = np.split(totals[inverse].astype(np.int64), np.cumsum([len(h) for h in hashes])[:-1])
    n = len(mine)
    return pa.table(
        [
            pa.chunked_array([pa.array([asked["kind"][0].as_py()] * n, pa.int32())]), pa.array([asked["part"][0].as_py()] * n, pa.int64()), asked["chunk"].combine_chunks(),
            pa.array([squeeze(m) for m in mine], pa.binary()), pa.array([int((totals > 0).sum())] + [0] * (n - 1), pa.int64()),
        ],
        ["kind", "part", "chunk", "totals", "n_distinct"],
    )


def _known(left: pa.Table, right: pa.Table) -> tuple[_Chunk, np.ndarray, np.ndarray]:
    """A chunk and the corpus counts of its words and pairs, in its own order."""
    trim()
    row = left.to_pylist()[0]
    c = _Chunk(row["lens"], row["train"], row["tokens"], row["words"])
    got = sorted(zip(*(right[x].to_pylist() for x in ("kind", "part", "totals")), strict=True))
    found = []
    for kind in (0, 1):
        parts = [spread(t, np.int64) for k, _, t in got if k == kind]
        totals = np.empty(len(c.hashes[kind]), np.int64)
        totals[np.argsort(c.hashes[kind], kind="stable")] = np.concatenate(parts)
        found.append(totals)
    return c, *found


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _cell(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of zero, else 1 to CELLS - 1 by its logarithm."""
    with np.errstate(divide="ignore"):
        k = np.floor(np.log(ratio) / CELL) + CELLS // 2
    return np.where(ratio > 0, np.clip(k, 1, CELLS - 1), 0).astype(np.int64)


def _deleted(c: _Chunk, words: np.ndarray, pairs: np.ndarray, n: int, v: int, d: int) -> pa.Table:
    """Training tokens by bucket and by how the two estimates without them compare with 1 / (V + 1)."""
    t = c.in_train
    w, b = c.tokens[t], c.before[t]
    context = np.where(b == 1, d, words[b]) - 1
    p2 = np.where(context > 0, (pairs[c.pair[t]] - 1) / np.maximum(context, 1), 0) * (v + 1)
    p1 = (words[w] - 1) / max(1, n - 1) * (v + 1)
    cell = (_bucket(context) * CELLS + _cell(p2)) * CELLS + _cell(p1)
    size = BUCKETS * CELLS * CELLS
    count, s2, s1 = (np.bincount(cell, x, size) for x in (None, p2, p1))
    at = np.flatnonzero(count)
    return pa.table([pa.array(at), *(pa.array(x[at].astype(float)) for x in (count, s2, s1))], ["cell", "n", "s2", "s1"])


def mixture(table: np.ndarray) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket, by EM; table: rows of cell, n, sum of p2, sum of p1."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for b in range(BUCKETS):
        rows = table[(table[:, 0] // (CELLS * CELLS)).astype(int) == b]
        if not len(rows):
            continue
        n = rows[:, 1]
        p = np.stack([rows[:, 2] / n, rows[:, 3] / n, np.ones(len(rows))], 1)
        x = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = p * x
            share /= share.sum(1, keepdims=True)
            x = (share * n[:, None]).sum(0) / n.sum()
        x = np.maximum(x, [0, 0, FLOOR])
        weights[b] = x / x.sum()
    return weights


def _scored(c: _Chunk, ids: list, words: np.ndarray, pairs: np.ndarray, n: int, v: int, d: int, weights: np.ndarray) -> pa.Table:
    w = words[c.tokens]
    context = np.where(c.before == 1, d, words[c.before])
    b = _bucket(context)
    p = weights[b, 0] * pairs[c.pair] / np.maximum(context, 1) + weights[b, 1] * w / max(1, n) + weights[b, 2] / (v + 1)
    add = lambda x: pa.array(np.add.reduceat(x, c.starts))
    return pa.table(
        [
            pa.array(ids, pa.int64()), pa.array(~c.train), pa.array(c.lens.astype(np.int64)), add((w > 0).astype(np.int64)), pa.array(np.full(len(ids), n, np.int64)),
            add(np.log10((w + BASE) / (n + BASE * (v + 1)))), add(np.log10(p)),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def counts_of(asking: DataFrame, bits: int, deal_bits: int = DEAL_BITS, slice_chunks: int = SLICE_CHUNKS) -> DataFrame:
    """Answers (_ANSWER) to what chunks ask (chunk, lens, train, tokens, words), over 2^bits ranges of hashes: for each chunk its totals by kind and part."""
    asked = asking.mapInArrow(lambda it: _ask(it, min(bits, deal_bits)), _ASK)
    if bits <= deal_bits:
        return cut(asked.groupBy("kind", "part").applyInArrow(lambda t: _answer(t), _ANSWER), "lm-counts")
    n = asking.count()
    slices = F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-n // slice_chunks))))
    asked = cut(asked.withColumn("slice", slices), "lm-asked")
    on = asked.groupBy("kind", "part", "slice").applyInArrow(lambda t: _ask_on(t, bits), _ASK)
    found = cut(on.groupBy("kind", "part").applyInArrow(lambda t: _answer(t, np.uint64), _ANSWER), "lm-range-counts")
    back = found.select("kind", F.shiftright("part", bits - deal_bits).alias("super"), F.col("chunk").alias("of_slice"), "part", "totals")
    given = asked.groupBy("kind", "part", "slice").cogroup(back.groupBy("kind", "super", "of_slice")).applyInArrow(_give_back, _ANSWER)
    return cut(given.union(found.where("n_distinct > 0").select("kind", "part", F.lit(-1).cast("long"), F.lit(None).cast("binary"), "n_distinct")), "lm-counts")


def lm_scores(docs: DataFrame, held_out: tuple[int, int] = (5, 1), chunk_bytes: int = CHUNK_BYTES, range_ngrams: int = RANGE_NGRAMS, deal_bits: int = DEAL_BITS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row of docs.

    Rows with crc32(doc_id as text) mod held_out[0] = held_out[1] are only scored; rows of
    null id are training rows. Null text counts as empty: one token, the end. Repeated
    rows each count. Without training rows all counts are 0 and the score is uniform.
    """
    spark = docs.sparkSession
    ship(spark)
    table = cut(id_text(docs).mapInArrow(lambda it: _chunks(it, chunk_bytes, held_out), _CHUNK), "lm-chunks")
    size = F.length("tokens") + F.length("words")
    n, d, entries = table.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("d_train"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, entries / 3 / range_ngrams)))))  # about 3 bytes for each distinct pair of a chunk
    answers = counts_of(table.select("chunk", "lens", "train", "tokens", "words"), bits, deal_bits)
    v = answers.where("kind = 0").agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    both = table.select("chunk", "ids", "lens", "train", "tokens", "words").groupBy("chunk").cogroup(answers.where("chunk >= 0").select("chunk", "kind", "part", "totals").groupBy("chunk"))

    def deleted(left: pa.Table, right: pa.Table) -> pa.Table:
        return _deleted(*_known(left, right), n, v, d)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        c, words, pairs = _known(left, right)
        return _scored(c, left["ids"].to_pylist()[0], words, pairs, n, v, d, weights)

    cells = both.applyInArrow(deleted, "cell long, n double, s2 double, s1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1"))
    rows = cut(cells, "lm-cells").collect()  # at most BUCKETS * CELLS * CELLS rows
    weights = mixture(np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 4))
    return both.applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
