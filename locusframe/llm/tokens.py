"""Token counts (operator 6): batch encoding that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import id_text, out, texts
from locusframe.plans.runtime import ship

#: UTF-8 bytes of text that are encoded in one call, and of one piece of a longer text.
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 15
#: A single space between characters that are neither spaces nor the model's space sign
#: (U+2581). No piece of the model has that sign after another character, so no merge
#: crosses such a place, and the encoder puts the sign before each piece anew.
_SAFE = re.compile(rb"(?<=[^ \x81]) (?=[^ \xe2])")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_MODELS: dict = {}


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size())):
            raise ValueError(f"{path}: a piece holds a space sign after another character, so texts can't be split at spaces")
    return _MODELS[path]


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``text`` cut at safe spaces, each piece of ``size`` bytes or up to the next safe space."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def count_all(items: list[bytes], path: str, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> list[int]:
    counts, load, whose, held = [0] * len(items), [], [], 0
    encode = model(path).encode

    def flush() -> None:
        for k, ids in zip(whose, encode(load, num_threads=1), strict=True):
            counts[k] += len(ids)
        load.clear(), whose.clear()

    for k, text in enumerate(items):
        for piece in pieces(text, piece_bytes):
            load.append(piece.decode())
            whose.append(k)
            held += len(piece)
            if held >= batch_bytes:
                flush()
                held = 0
    if load:
        flush()
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row per row of docs.

    Tokens as the library gives them for the whole text, without begin or end. Null text
    counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each count.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = texts(batch)
            yield from out(_SCHEMA, list(zip(batch.column(0).to_pylist(), map(len, items), count_all(items, path), strict=True)))

    got = id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
