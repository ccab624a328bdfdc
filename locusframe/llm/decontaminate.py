"""Benchmark decontamination (operator 2): template windows with typed placeholders and slots.

Words lose case and outer punctuation; numbers, names and units become placeholders. A
name is a capitalised word; where it begins a sentence it may also be an ordinary word, and
windows that hold it are hashed in both readings. Windows of ``WINDOW`` template
words are hashed and joined with the benchmark's; the words that stand in the placeholders
are then held side by side, for each alignment of a text with an item by itself: one that
replaces another must do so throughout the occurrence. Windows of little but placeholders
say too much of any text as templates, so they are compared word for word; they count for
items that consist mostly of them. Items of fewer words than a window are compared
sentence by sentence, word for word.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import by_key, drop_rows, keyed, signed, texts
from locusframe.plans.runtime import cut, ship

#: Words in a window, share of an item's windows that must be found, and ordinary words that a window needs.
WINDOW, SHARE, LITERALS = 5, 0.8, 2
#: Window hashes, and word hashes, of the benchmark that are sent to the tasks, at most (16 MB each); beyond that both sides are shuffled, or all windows made.
FILTER_HASHES = 2_000_000
# Units of measurement and currency.
UNITS = frozenset("km m cm mm mi mile miles ft foot feet inch inches kg g mg lb lbs pound pounds oz ounce ounces t ton tons l ml litre litres liter liters gallon gallons h hr hour hours min minute minutes s sec second seconds day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent mph kmh".split())
_UNITS = frozenset(u.encode() for u in UNITS)
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(s)) for s in (b"<num>", b"<name>", b"<unit>"))
#: What a hash is of: a template window, a window word for word, a whole sentence of fewer words.
_TEMPLATE, _LITERAL, _SENTENCE = range(3)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Windows in an output batch, and bytes of the texts that are looked at together.
BATCH_ROWS, PART_BYTES = 60_000, 1 << 19
_ORDINARY, _CAPITAL, _NUMBER, _MEASURE = range(4)
_SCHEMA = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("pos", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.string())), ("either", pa.int64())])


class Words(dict):
    """Raw word -> its number; per number the kind, whether it ends a sentence, the 64-bit hash of the lower-case core, and whether
    a window of the benchmark may hold it: all but ordinary words that are not among ``vocabulary`` (sorted hashes; None: all words).

    Remembers up to 300,000 words of 32 MB between texts (:meth:`tidy`). New words are kept in lists until :meth:`tables`.
    """

    def __init__(self, vocabulary: np.ndarray | None = None) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.tidy(True)

    def tidy(self, now: bool = False) -> None:
        if now or len(self) > 300_000 or self.held > 32 << 20:
            self.clear()
            self.held = 0
            self._all = np.zeros(1024, np.int8), np.zeros(1024, bool), np.zeros(1024, np.uint64), np.ones(1024, bool)
            self._new: list[tuple[int, bool, int]] = []

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """kind, ends, h and known by number."""
        n = len(self)
        while n > len(self._all[0]):
            self._all = tuple(np.concatenate([a, np.zeros_like(a)]) for a in self._all)
        if self._new:
            kinds, ends, hashes = zip(*self._new)
            kind, h, known = np.array(kinds, np.int8), np.array(hashes, np.uint64), np.ones(len(kinds), bool)
            if self.vocabulary is not None:
                k = np.searchsorted(self.vocabulary, h)
                known = (kind != _ORDINARY) | (np.append(self.vocabulary, np.uint64(0))[k] == h) & (k < len(self.vocabulary))
            for a, new in zip(self._all, (kind, ends, h, known), strict=True):
                a[n - len(kind) : n] = new
            self._new.clear()
        return self._all

    def __missing__(self, raw: bytes) -> int:
        n = len(self)
        self.held += len(raw)
        if raw.isalpha():  # ASCII letters alone
            low = raw.lower()
            kind = _MEASURE if len(low) > 1 and low in _UNITS else _CAPITAL if raw[:1].isupper() and not raw.isupper() else _ORDINARY
            self._new.append((kind, False, xxhash.xxh64_intdigest(low)))
        else:
            core = raw.strip(PUNCT)
            text = core.decode()
            low = text.lower()
            if core and core[:1].isdigit() and not any(c.isalpha() for c in text):
                kind = _NUMBER
            elif low in UNITS and len(low) > 1:
                kind = _MEASURE
            else:
                kind = _CAPITAL if text[:1].isupper() and not text.isupper() else _ORDINARY
            self._new.append((kind, raw.rstrip(b"\"')]").endswith((b".", b"!", b"?", b":")), xxhash.xxh64_intdigest(low.encode())))
        self[raw] = n
        return n


@functools.cache
def _readings(window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of places in a window, as bits: how many of its subsets there are but for the empty one, where they begin, and all of them."""
    subsets = [[m for m in range(1, p + 1) if m & p == m] for p in range(1 << window)]
    count = np.array([len(x) for x in subsets])
    return count, np.cumsum(count) - count, np.array([m for x in subsets for m in x], np.int64)


def _mixed(h: np.ndarray, at: np.ndarray, window: int, either: np.ndarray | None = None, kind: int = _TEMPLATE) -> np.ndarray:
    """Hashes of the windows at ``at``; the words whose bits are set in ``either`` are read as names."""
    total = np.full(len(at), kind, np.uint64)
    for k in range(window):
        x = h[at + k]
        if either is not None:
            x = np.where(either >> k & 1, _NAME, x)
        total = (total ^ (x >> np.uint64(29)) ^ x) * _MIX + _STEP
    return total ^ (total >> np.uint64(32))


class Windows(NamedTuple):
    """Of some texts, one behind the other: hashes in all readings, where they begin, which words that begin a sentence are read as
    names (bits), what each hash is of, which words are slots at any rate, where sentences begin and end, the words, and
    where each text begins."""

    h: np.ndarray
    at: np.ndarray
    either: np.ndarray
    kind: np.ndarray
    slot: np.ndarray
    bounds: np.ndarray
    raw: list[bytes]
    first: np.ndarray

    def size(self, i: int, window: int) -> int:
        """Words of the ``i``-th hash."""
        return window if self.kind[i] != _SENTENCE else int(self.bounds[np.searchsorted(self.bounds, self.at[i]) + 1] - self.at[i])

    def of_item(self, window: int) -> np.ndarray:
        """Of one text, which hashes stand for it as a benchmark item: its templates if they are half of its windows or more, else all windows; its sentences if it has fewer words."""
        if len(self.raw) < window:
            return np.flatnonzero(self.kind == _SENTENCE)
        template = self.kind == _TEMPLATE
        enough = 2 * len(np.unique(self.at[template])) >= len(self.raw) - window + 1
        return np.flatnonzero(template if enough else self.kind != _SENTENCE)


def windows(items: list[bytes], words: Words, window: int) -> Windows:
    """The windows of some texts, none across two of them; templates only of words that ``words`` knows the benchmark to have.
    White space that holds a line feed begins a sentence, as a text's start does."""
    raw: list[bytes] = []
    starts, first = [], []
    for text in items:
        first.append(len(raw))
        for line in text.split(b"\n"):
            starts.append(len(raw))
            raw += line.split()
    n = len(raw)
    words.tidy()
    number = np.fromiter(map(words.__getitem__, raw), np.int64, n)
    kind, ends, h, known = (t[number] for t in words.tables())
    begins = np.zeros(n + 1, bool)
    begins[1:] = ends
    begins[[s for s in starts if s < n]] = True
    begins[n] = True
    bounds = np.flatnonzero(begins)
    sizes = np.diff(bounds)
    parts = []
    for size in range(1, window):
        at = bounds[:-1][sizes == size]
        if len(at):
            parts.append((_mixed(h, at, size, kind=_SENTENCE), at, np.zeros(len(at), np.int64), _SENTENCE))
    name = (kind == _CAPITAL) & ~begins[:n]
    slot = name | (kind == _NUMBER) | (kind == _MEASURE)
    first = np.array([*first, n])
    if n >= window:
        plain = np.concatenate([[0], np.cumsum(~slot)])
        plain = plain[window:] - plain[:-window]
        least = min(LITERALS, window)
        inside = np.ones(len(plain), bool)
        for k in range(1, window):  # a window in which another text begins is none
            edge = first[1:-1] - k
            inside[edge[(edge >= 0) & (edge < len(inside))]] = False
        at = np.flatnonzero((plain < least) & inside)
        if len(at):
            parts.append((_mixed(h, at, window, kind=_LITERAL), at, np.zeros(len(at), np.int64), _LITERAL))
        h[name], h[kind == _NUMBER], h[kind == _MEASURE] = _NAME, _NUM, _UNIT
        if words.vocabulary is not None:
            strange = np.concatenate([[0], np.cumsum(~known)])
            inside &= strange[window:] == strange[:-window]
        at = np.flatnonzero((plain >= least) & inside)
        parts.append((_mixed(h, at, window), at, np.zeros(len(at), np.int64), _TEMPLATE))
        open_ = (kind == _CAPITAL) & begins[:n]
        bits = np.zeros(n - window + 1, np.int64)
        if open_.any():
            for k in range(window):
                bits |= open_[k : k + len(bits)].astype(np.int64) << k
        some = at[bits[at] > 0]
        if len(some):
            count, begin, subsets = _readings(window)
            c = count[bits[some]]
            more = np.repeat(some, c)
            chosen = subsets[np.arange(len(more)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[bits[some]], c)]
            enough = plain[more] - np.bitwise_count(chosen) >= least
            more, chosen = more[enough], chosen[enough]
            parts.append((_mixed(h, more, window, chosen), more, chosen, _TEMPLATE))
    if not parts:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), _TEMPLATE)]
    kinds = np.repeat(np.array([p[3] for p in parts], np.int8), [len(p[0]) for p in parts])
    return Windows(*(np.concatenate([p[k] for p in parts]) for k in range(3)), kinds, slot, bounds, raw, first[:-1])


def vocabulary(rows: DataFrame) -> DataFrame:
    """(h) of the distinct words of (id, text) rows."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for text in texts(batch):
                words.tidy()
                number = [words[w] for w in text.split()]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(words.tables()[2][number]).view(np.int64))], ["h"])

    return rows.mapInArrow(run, "h long").distinct()


def _parts(items: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about ``size`` bytes together, at least one item each."""
    a = held = 0
    for k, item in enumerate(items):
        if k > a and held + len(item) > size:
            yield a, k
            a, held = k, 0
        held += len(item)
    if a < len(items):
        yield a, len(items)


def template_windows(rows: DataFrame, window: int = WINDOW, wanted: np.ndarray | None = None, items: bool = False, among: np.ndarray | None = None) -> DataFrame:
    """``(id, row, pos, h, slots, either)`` for the windows of (id, text) rows; only those whose hash is in ``wanted``, if given, or that stand for an item, with ``items``.

    among: sorted hashes of the words that windows in ``wanted`` may hold, so that others need not be made.

    row: a hash of the text, which tells apart rows that share an id. slots: for each word of the window, what stands in the placeholder, lower-case; null for an ordinary word.
    either: the places of words that begin a sentence and are read as names here, as bits.
    """
    ship(rows.sparkSession)
    table = None
    if wanted is not None:
        wanted = np.sort(wanted.astype(np.uint64))
        table = np.zeros(1 << 22, bool)
        table[(wanted >> np.uint64(42)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(among)
        for batch in batches:
            keys, all_texts = batch.column(0).to_pylist(), texts(batch)
            found: list[tuple] = []
            for a, b in [(k, k + 1) for k in range(len(keys))] if items else _parts(all_texts, PART_BYTES):
                part = all_texts[a:b]
                w = windows(part, words, window)
                h = w.h
                if items:
                    at = w.of_item(window)
                elif table is None:
                    at = np.arange(len(h))
                else:
                    at = np.flatnonzero(table[(h >> np.uint64(42)).astype(np.int64)])
                    if len(at):
                        k = np.searchsorted(wanted, h[at])
                        at = at[(k < len(wanted)) & (wanted[np.minimum(k, len(wanted) - 1)] == h[at])]
                owner = np.searchsorted(w.first, w.at[at], side="right") - 1
                row = {k: signed(xxhash.xxh64_intdigest(part[k])) for k in np.unique(owner).tolist()}
                for i, k, p, e, kind in zip(at.tolist(), owner.tolist(), w.at[at].tolist(), w.either[at].tolist(), w.kind[at].tolist()):
                    if kind == _TEMPLATE:
                        slots = [w.raw[p + q].strip(PUNCT).decode().lower() if w.slot[p + q] or e >> q & 1 else None for q in range(window)]
                    else:
                        slots = [None] * w.size(i, window)
                    found.append((keys[a + k], row[k], p - int(w.first[k]), int(h[i].view(np.int64)), slots, e))
                    if len(found) >= BATCH_ROWS:
                        yield _batch(found)
                        found = []
            if found:
                yield _batch(found)

    return rows.mapInArrow(run, "id long, row long, pos long, h long, slots array<string>, either long")


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _joined(pairs: Iterable[tuple[str, str]], ahead: dict[str, str], back: dict[str, str]) -> bool:
    """Adds the pairs to a one-to-one mapping and its inverse; changes nothing if they contradict it or each other."""
    new: list[tuple[str, str]] = []
    for a, b in pairs:
        if a not in ahead and b not in back:
            ahead[a], back[b] = b, a
            new.append((a, b))
        elif ahead.get(a) != b or back.get(b) != a:
            for x, y in new:
                del ahead[x], back[y]
            return False
    return True


def occurrence(hits: Iterable[tuple], need: float) -> bool | None:
    """Is there an occurrence with ``need`` windows of the item, and is it reworded; None if there is none.

    hits: (row, pos, wpos, islots, slots, either). Windows whose slots are the item's are an
    occurrence, whatever else the document says. Otherwise the hits of one alignment (same
    row and pos - wpos) must agree on a one-to-one mapping of the slots. Each alignment in
    turn, the fullest first, is extended by the others, the nearest first, that agree with
    what it has, as words put in or left out shift an item's alignment; those that
    contradict it belong to another occurrence.

    ``either`` has bits for words that begin a sentence in one of the texts and are read as
    names. Of the readings of a window the one with the fewest of them counts, and since such
    a word may be no name, a window that contradicts the rest by it is only not found.
    """
    best: dict[tuple, tuple] = {}
    same = set()
    for row, pos, w, a, b, either in sorted(set(hits), key=lambda x: (*x[:3], x[5].bit_count(), x[5])):
        if a == b:
            same.add(w)
        best.setdefault((row, pos, w), (a, b, either))
    if len(same) >= need:
        return False
    sure: dict[tuple[int, int], tuple[set, set]] = {}
    unsure: dict[tuple[int, int], list] = {}
    for (row, pos, w), (a, b, either) in best.items():
        seen, pairs = sure.setdefault((row, pos - w), (set(), set()))
        got = tuple((x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None)
        if either:
            unsure.setdefault((row, pos - w), []).append((w, got))
        else:
            seen.add(w)
            pairs.update(got)
    distinct: dict[tuple, tuple] = {}  # alignments that show the same windows and slots are one
    for key, (seen, pairs) in sure.items():
        if _joined(pairs, {}, {}):
            more = unsure.get(key, [])
            often = Counter(x for _, got in more for x in got)
            # what most windows say comes first
            more = sorted(more, key=lambda x: (-min(often[y] for y in x[1]), x[0]))
            distinct[frozenset(seen), frozenset(pairs), tuple(more)] = (key, [(seen, pairs)], [({w}, got) for w, got in more])
    lines = list(distinct.values())
    if len({w for _, first, more in lines for seen, _ in first + more for w in seen}) < need:
        return None
    for (row, at), _, _ in sorted(lines, key=lambda x: (-len(x[1][0][0]) - len(x[2]), x[0])):
        near = sorted(lines, key=lambda x: (x[0][0] != row, abs(x[0][1] - at), x[0]))
        # all that is sure before what isn't, or one alignment after the other
        for parts in ([x for line in near for x in line[1]] + [x for line in near for x in line[2]], [x for line in near for x in line[1] + line[2]]):
            held, ahead, back = set(), {}, {}
            for seen, pairs in parts:
                if not seen <= held and _joined(pairs, ahead, back):
                    held |= seen
                    if len(held) >= need:
                        return any(a != b for a, b in ahead.items())
    return None


def _judged(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = ((tuple(tuple(x) if isinstance(x, list) else x for x in hit.values()) for hit in row) for row in batch.column(4).to_pylist())
        got = [occurrence(x, share * n) for x, n in zip(hits, batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.bool_())], ["doc_id", "item_id", "found", "windows", "reworded"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``(doc_id, item_id, found, windows, reworded)``: documents that hold a benchmark item, and which.

    An item is held if ``share`` or more of its windows are found and the slots of an
    occurrence agree (:func:`occurrence`): in it each slot value of the item always has the
    same counterpart and no two values share one. ``found``: windows anywhere in the document.
    ``reworded``: no occurrence has the item's own values throughout.
    Items that are mostly numbers, names and units are found word for word only; items of fewer
    than ``window`` words where each of their sentences is a sentence or line of the document.
    Null texts and items without words match nothing; rows of null id are left out; rows that
    share a doc_id count as one document. Repeated items and rows change nothing.

    Documents emit only windows that the benchmark has: its hashes go to every task if
    they are at most ``FILTER_HASHES``, else both sides are shuffled by hash. Windows that hold an
    ordinary word which no item has are not made at all.
    """
    bench = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    item = cut(
        template_windows(bench, window, items=True)
        .where("id is not null").groupBy("id", F.col("pos").alias("wpos"), "h").agg(F.first("slots").alias("islots"), F.first("either").alias("ieither")),
        "benchmark-windows",
    )
    distinct = item.select("h").distinct()
    n = distinct.count()
    wanted = among = None
    if n <= FILTER_HASHES:
        wanted = distinct.toArrow().column(0).to_numpy().view(np.uint64)
        known = cut(vocabulary(bench), "benchmark-words")
        if known.count() <= FILTER_HASHES:
            among = np.sort(known.toArrow().column(0).to_numpy().view(np.uint64))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hits = template_windows(rows, window, wanted, among=among).where("id is not null").select(F.col("id").alias("doc_id"), "row", "pos", "h", "slots", "either")
    hits = cut(hits, "benchmark-hits") if wanted is not None else hits
    met = hits.join(item.withColumnRenamed("id", "item_id"), "h")
    size = item.groupBy(F.col("id").alias("sid")).agg(F.countDistinct("wpos").alias("windows"))
    seen = met.groupBy("doc_id", "item_id").agg(F.countDistinct("wpos").alias("found"))
    close = seen.join(size, F.col("item_id") == F.col("sid")).where(F.col("found") >= share * F.col("windows")).select("doc_id", "item_id", "found", "windows")
    sides = met.join(close, ["doc_id", "item_id"]).groupBy("doc_id", "item_id", "found", "windows").agg(F.collect_list(F.struct("row", "pos", "wpos", "islots", "slots", F.col("either").bitwiseOR(F.col("ieither")).alias("either"))).alias("hits"))
    return sides.mapInArrow(lambda it: _judged(it, share), "doc_id long, item_id long, found long, windows long, reworded boolean").where("reworded is not null")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay.

    Every row is judged by its own text, whatever its id (null and shared ids included).
    """
    rows, key = keyed(docs)
    held = contaminated(by_key(rows, key), benchmark)
    return drop_rows(rows, key, held.select(F.col("doc_id").alias("_drop")).distinct(), "contaminated")
