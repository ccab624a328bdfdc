"""Toxicity (operator 4): gradient-boosted trees over dense features, with isotonic calibration.

Features come from whole texts on the executors. The models are fitted on the driver from a
bounded sample of labelled rows (``SAMPLE`` rows of smallest hash), in three parts: one
gives the lexicon, one grows the trees, one calibrates. Only rows whose
crc32(doc_id as text) mod 4 is not 2 are ever used for fitting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import by_key, crc_mod, drop_rows, id_text, keyed, out, texts
from locusframe.plans.runtime import cut, ship

#: Labelled rows that models are fitted on, at most; lexicon entries, at most.
SAMPLE, LEXICON = 20_000, 1000
THRESHOLD = 0.3
#: A lexicon entry is a word or, with a star, what words of more than STEM letters begin with.
STEM, LEAST_DOCS, LEAST_ODDS = 5, 4, 1.5
# Words of the second person in the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine deiner sie ihr euch euer usted ustedes ti tus su sus vosotros".split())
# Common insults, which are in the lexicon even if the sample has too few of them to learn.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash clown pathetic disgusting worthless imbecile jerk bastard bitch asshole retard filthy vermin".split())
INSULT_ODDS = 3.0
# Characters written in place of letters.
LEET = str.maketrans("0134578@$!|", "oieastbasil")
PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¡¿–—"
FEATURES = ("hits a word", "log hits", "log odds a word", "largest odds", "near second person", "second person", "capitals", "exclamation", "other punctuation", "digits", "obfuscated", "obfuscated hits", "log words")
_YOU, _ODD, _ODDHIT, _MASK = 1 << 12, 1 << 13, 1 << 14, (1 << 12) - 1
_COUNTS = np.zeros((256, 4), np.int64)
for _c in range(128):
    _COUNTS[_c] = [chr(_c).isupper(), chr(_c) == "!", chr(_c) in PUNCT and chr(_c) != "!", chr(_c).isdigit()]


def units(word: str) -> Iterator[str]:
    yield word
    if len(word) > STEM:
        yield word[:STEM] + "*"


class Coder(dict):
    """Lower-case raw token -> number of its lexicon entry (0: none) and flags; remembers up to 300,000."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.number = {u: k + 1 for k, u in enumerate(lexicon)}
        self.odds = np.array([0.0, *lexicon.values()])

    def entry(self, word: str) -> int:
        return max((self.number.get(u, 0) for u in units(word)), key=lambda k: self.odds[k])

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        core = raw.strip(PUNCT)
        code = self.entry(core) if core else 0
        if core in SECOND_PERSON:
            code |= _YOU
        if core and not core.isalpha() and any(c.isalpha() for c in core):
            code |= _ODD
            plain = "".join(c for c in core.translate(LEET) if c.isalpha())
            if not code & _MASK and (k := self.entry(plain)):
                code |= k | _ODDHIT
        if len(raw) <= 64:
            self[raw] = code
        return code


def features(text: bytes, coder: Coder) -> list[float]:
    """The values of FEATURES; all 0 for an empty text. Linear in the text."""
    raw = text.decode().lower().split()
    n = max(1, len(raw))
    codes = np.fromiter(map(coder.__getitem__, raw), np.int64, len(raw))
    at = np.flatnonzero(codes & _MASK)
    odds = coder.odds[codes[at] & _MASK]
    you = np.flatnonzero(codes & _YOU)
    near = 0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        left = at - you[np.maximum(k - 1, 0)]
        right = you[np.minimum(k, len(you) - 1)] - at
        near = int(((np.abs(left) <= 5) | (np.abs(right) <= 5)).sum())
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _COUNTS / max(1, len(text))
    return [
        len(at) / n, math.log1p(len(at)), float(odds.sum()) / n, float(odds.max(initial=0)), near / max(1, len(at)), len(you) / n, *chars.tolist(),
        int((codes & _ODD > 0).sum()) / n, int((codes & _ODDHIT > 0).sum()) / n, math.log1p(len(raw)),
    ]


@dataclass
class Trees:
    """Depth-wise gradient-boosted trees with logistic loss on binned features (numpy)."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    l2: float = 2.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)  # a full binary tree; children of k are 2k+1 and 2k+2
            split = {}
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, 0, np.inf)
                    if len(rows) >= 20:
                        total = g[rows].sum() ** 2 / (h[rows].sum() + self.l2)
                        for f, e in enumerate(edges):
                            if not len(e):
                                continue
                            gl = np.bincount(codes[rows, f], g[rows], len(e) + 1).cumsum()
                            hl = np.bincount(codes[rows, f], h[rows], len(e) + 1).cumsum()
                            gain = gl[:-1] ** 2 / (hl[:-1] + self.l2) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + self.l2) - total
                            j = int(gain.argmax())
                            if gain[j] > best[0]:
                                best = (float(gain[j]), f, float(e[j]))
                    split[k] = best[1:]
                    node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
            leaves = {}
            for k in range(2**self.depth - 1, 2 ** (self.depth + 1) - 1):
                rows = node == k
                leaves[k] = float(-self.rate * g[rows].sum() / (h[rows].sum() + self.l2))
            self.trees.append((split, leaves))
            raw += np.vectorize(leaves.get, otypes=[float])(node)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for split, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            where = np.array([split[k][0] for k in range(len(split))])
            at = np.array([split[k][1] for k in range(len(split))])
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), where[node]] > at[node])
            raw += np.array([0.0] * len(split) + [leaves[k] for k in range(len(split), 2 * len(split) + 1)])[node]
        return 1 / (1 + np.exp(-raw))


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots for np.interp. One pseudo-count each way keeps values inside (0, 1)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + w, blocks[-1][2], hi]
    xs, ys = [], []
    for a, w, lo, hi in blocks:
        value = (a + 0.5) / (w + 1.0)
        for s in (lo, hi):
            xs.append(s)
            ys.append(max(value, ys[-1]) if ys else value)
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    prior: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.prior)
        raw = self.trees.predict(x)
        return raw if self.knots is None else np.interp(raw, *self.knots)


def _featured(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        yield batch, np.array([features(t, coder) for t in texts(batch)]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents (those of smallest hash of the id).

    An id labelled more than once is toxic if one label says so; of several texts of an id
    one is learned from; null labels and ids are left out. Without labels, or with labels
    of one kind, the score is a constant.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("toxic").cast("int").alias("toxic")).where("lid is not null and toxic is not null")
    known = known.where(crc_mod(F.col("lid"), 4) != 2).groupBy("lid").agg(F.max("toxic").alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("lid"), "lid").limit(sample), "toxic-labels")  # at most `sample` small rows
    part = F.pmod(F.xxhash64("lid", F.lit(1)), F.lit(10))
    rows = id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("lid")).select("doc_id", "text", "toxic", part.alias("part"))
    one = rows.groupBy("doc_id", "toxic", "part").agg(F.max_by("text", F.xxhash64("text")).alias("text"))  # an id may have any number of rows
    rows = cut(one.select("doc_id", "text", "toxic", "part"), "toxic-sample")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or ones in (0, n):
        return Model({}, prior=float(ones / n) if n else 0.0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, toxic in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                found = {u for raw in set(t.decode().lower().split()) for u in units(raw.strip(PUNCT)) if u}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([toxic] * len(found), pa.int32())], ["unit", "toxic"])

    first = rows.where("part < 5")
    n1, t1 = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = first.select("text", "toxic").mapInArrow(split, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("t") + 0.1) / (t1 + 0.2)) - F.log((F.col("n") - F.col("t") + 0.1) / (n1 - t1 + 0.2))
    best = counted.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    lexicon = {r.unit: r.odds for r in best.orderBy(F.desc(F.col("odds") * F.log1p("t")), "unit").limit(LEXICON).collect()}

    lexicon = {w: INSULT_ODDS for w in sorted(INSULTS)} | lexicon
    coder = Coder(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _featured(batches, coder):
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "part", "x"])

    rest = rows.where("part >= 5").select("text", "toxic", "part").mapInArrow(measure, "toxic int, part long, x array<double>").toPandas()  # bounded by `sample`
    if not len(rest) or rest.toxic.nunique() < 2:
        return Model(lexicon, prior=float(ones / n))
    rest = rest.sort_values("x", key=lambda c: c.map(tuple)).reset_index(drop=True)  # the same sums in any order of arrival
    x, y = np.array(rest.x.tolist()), rest.toxic.to_numpy(float)
    grow = (rest.part < 8).to_numpy()
    if len(set(y[grow])) < 2:
        return Model(lexicon, prior=float(ones / n))
    trees = Trees().fit(x[grow], y[grow])
    last = ~grow
    knots = isotonic(trees.predict(x[last]), y[last]) if len(set(y[last])) == 2 else None
    return Model(lexicon, trees, knots, float(ones / n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, a row per row of docs; from the text alone, null counts as empty."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _featured(batches, Coder(model.lexicon)):
            yield from out(schema, list(zip(batch.column(0).to_pylist(), model.score(x).tolist(), strict=True)))

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row per row of docs. A null id is not held out."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay.

    Every row is judged by its own text, whatever its id (null and shared ids included).
    """
    model = fit(docs, labels)
    rows, key = keyed(docs)
    toxic = score(by_key(rows, key), model).where(F.col("score") >= threshold)
    return drop_rows(rows, key, toxic.select(F.col("doc_id").alias("_drop")), "toxic-dropped")
