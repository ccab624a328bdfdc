"""Packing (operator 10): documents into windows by sum-of-squares online packing.

The state is a level array: how many open windows hold h tokens, for each h. A document
of s tokens goes into the level h (or a new window, h = 0) for which the sum of squared
counts is least once a window has moved from h to h + s. Documents of more than a window
fill whole windows first; their rest is placed like any other document.

Each task packs what it reads. At its end, and whenever its open windows hold more than
a set number of tokens, their pieces are strung together and cut at the window's size;
what then remains is cut into sequences of decreasing powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from locusframe.llm.common import id_text, out, texts
from locusframe.plans.runtime import ship

WINDOW = 2048
#: Tokens that a task's open windows may hold before they are emptied.
OPEN_TOKENS = 4_000_000
#: Words kept with their ids in each worker, and the longest word that is kept, in bytes.
WORDS, WORD_BYTES = 300_000, 64
END_ID = 1
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_MODELS: dict = {}
#: Letters that normalisation leaves alone but for their case, between marks that form one part
#: each (without the apostrophe, which begins contractions, and "<", which begins special tokens).
_MARKS = r"([!-&(-/:;=>?@\[-`{-~]*)"
_PLAIN = re.compile(_MARKS + "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)" + _MARKS)
#: Byte-level BPE writes bytes that aren't printable Latin-1 as characters from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTES = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class Encoder(dict):
    """Word -> its token ids, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids in order. Words (split at ASCII white space, as they stand) are remembered,
    up to ``WORDS`` of them. A new word of letters with marks before or after goes to the
    library's BPE model as the parts that its normaliser and pre-tokenizer would make of
    it; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.bpe = self.model.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.model.get_vocab_size())]
        self.marks: dict[str, bytes] = {"": b""}

    def part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        return b"".join([self.four[t.id] for t in self.bpe(mapped)])

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[marks] = self.part(marks)
        return self.marks[marks]

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # letters of ASCII alone are one part
            four = self.four
            ids = b"".join([four[t.id] for t in self.bpe(word.lower().decode())])
        elif m := _PLAIN.fullmatch(text := word.decode()):
            ids = self.mark(m[1]) + self.part(m[2].lower()) + self.mark(m[3])
        else:
            ids = b"".join([self.four[i] for i in self.model.encode(text, add_special_tokens=False).ids])
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    if path not in _MODELS:
        _MODELS[path] = Encoder(path)
    return _MODELS[path]


class Packer:
    """Sum-of-squares packing of (doc_id, start, ids, doc_tokens) pieces."""

    def __init__(self, window: int, first_id: int, open_tokens: int = OPEN_TOKENS):
        self.window, self.next_id, self.open_tokens = window, first_id, open_tokens
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list] = defaultdict(list)
        self.held = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def level_for(self, s: int) -> int:
        """The fill h, of those with an open window or 0, for which moving a window to h + s costs least."""
        n = self.levels
        room = self.window - s
        # change of the sum of squares, halved and without its constant: N[h+s] - N[h]; neither
        # empty nor full windows are counted, so a new one costs N[s] + 1/2 - 1 and a full one -N[h] - 1/2
        cost = (n[s : self.window + 1] - n[: room + 1]).astype(float)
        cost[0] -= 0.5
        cost[room] -= 0.5
        usable = n[: room + 1] > 0
        usable[0] = True
        return int(np.argmin(np.where(usable, cost, np.inf)))

    def add(self, doc_id, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        full = total // w * w
        for start in range(0, full, w):
            self.close([(doc_id, start, ids[4 * start : 4 * (start + w)], total)])
        s = total - full
        if not s:
            return
        h = self.level_for(s)
        pieces = self.open[h].pop() if h else []
        pieces.append((doc_id, full, ids[4 * full :], total))
        if h:
            self.levels[h] -= 1
            self.held -= h
        if h + s == w:
            self.close(pieces)
            return
        self.open[h + s].append(pieces)
        self.levels[h + s] += 1
        self.held += h + s
        if self.held > self.open_tokens:
            self.drain()

    def drain(self) -> None:
        """Close all open windows: their pieces in one string, cut at the window's size, then at powers of two."""
        queue = [p for h in sorted(self.open, reverse=True) for pieces in self.open[h] for p in pieces]
        left = self.held
        self.levels[:] = 0
        self.open.clear()
        self.held = 0
        room, now = 0, []
        for doc_id, start, ids, total in queue:
            at, n = 0, len(ids) // 4
            while at < n:
                if not room:
                    room = min(self.window, 1 << (left.bit_length() - 1))
                take = min(room, n - at)
                now.append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self.close(now)
                    now = []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` must be a power of two. Null and empty texts are documents of one token
    (the end id); null ids stay null; repeated rows are packed each for itself. Sequence
    ids are unique: the task's number, then a count.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    ship(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc = Packer(window, TaskContext.get().partitionId() << 33), encoder(path)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                packer.add(doc_id, enc.ids(text) + end)
                if len(packer.rows) >= 10_000:
                    yield from out(SCHEMA, packer.taken())
        packer.drain()
        yield from out(SCHEMA, packer.taken())

    return id_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in SCHEMA.names))
