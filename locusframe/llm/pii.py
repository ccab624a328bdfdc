"""PII (operator 7): patterns, and a skip-chain conditional random field that adds to them.

Nodes are the words of a document that hold a digit, an at sign or ``[at]`` and the like (no
other word can be of one of the kinds). Neighbouring nodes share a chain potential; nodes with
the same or similar content (the same word, the same last digits of a run of numbers, the same
local part of an address) share a skip potential, however far apart: each with the next one like
it, and with the nearest one before and after that a pattern found. Loopy sum-product messages run over both kinds of edge, so that what is certain in one
place speaks for its likes elsewhere: a telephone number that the pattern finds once is found
again where it is written without its plus sign.

What the patterns found is evidence: those nodes have their labels for certain. Potentials are
learned together, by pseudo-likelihood, from a bounded sample of documents in which the
patterns' spans serve as labels. Each node is learned three times: with its features and its
neighbours' labels hidden in turn, so that either must tell, and with both. A node that no
pattern labels but that is like one with a label has no known label: it and what it is
chained to are left out of the learning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import id_text, out, texts
from locusframe.plans.runtime import cut, ship

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, at most, and nodes of each of them.
SAMPLE, SAMPLE_NODES = 2000, 200
ROUNDS, DAMPING, CERTAIN = 8, 0.5, 0.8
#: What a skip edge says of its two labels before any was seen: for equal ones, and against others; the strength of all priors, in nodes.
AGREE, PRIOR = 6.0, 2.0
#: Logarithm of the odds of a label known for certain.
CLAMP = 30.0
#: Digits at the end of a run of numbers that make two runs alike.
LAST = 7
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # from inside a run of digits nothing matches that did not from its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(rb"[0-9@]|[\[({]at[\])}]")
_NODE = re.compile(r"(?:[0-9@]|[\[({]at[\])}])[^\x20\x09-\x0D]*")
_AT = re.compile(r"@|[\[({]at[\])}]")
_SOME = "[0-9@]|[\\[({]at[\\])}]"
_DIGITS = re.compile(r"[0-9]+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "+(@")
# Words that announce each kind.
CUES = (
    frozenset("mail email e-mail courriel correo contact write".split()),
    frozenset("ip host server address addr adresse".split()),
    frozenset("card visa mastercard credit karte carte tarjeta".split()),
    frozenset("phone tel call telephone mobile fax telefon telefono".split()),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _parts_ok(ip: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in ip.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start. Linear in the text."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done = at + 1  # a local part holds no at sign
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            spans.append((0, start, done))
        at = text.find("@", done)
    spans += [(1, *m.span()) for m in _IP.finditer(text) if _parts_ok(m[0])]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return spans


def _alike(core: str, digits: str) -> set[str]:
    """What a node must share with another to be like it. digits: those of the run of numbers that ends in it."""
    low = core.lower()
    keys = {low}
    if len(digits) >= LAST:
        keys.add("#" + digits[-LAST:])
    local = _AT.split(low)[0]
    if len(local) >= 3 and not local.isdigit():
        keys.add("@" + local)
    return keys


class Nodes:
    """Nodes and edges of some documents: places, features, edges (a, b, 0 chain or 1 skip)."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.place: list[tuple[int, int]] = []
        self.seen: list[int] = []  # kind that a pattern gives the node, plus 1
        self.x: list[list[float]] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]], most: int | None = None) -> None:
        order = sorted((s, e, k) for k, s, e in spans)
        i, done, last = 0, 0, None
        like: dict[str, int] = {}
        sure: dict[str, int] = {}  # the last node of a key that a pattern found, and those since the last one
        open_: dict[str, list[int]] = {}
        count, run = 0, ""
        for m in _NODE.finditer(text):
            start = m.start()
            while start > done and text[start - 1] not in " \t\n\x0b\x0c\r":
                start -= 1
            done = end = m.end()
            raw = text[start:end]
            start += len(raw) - len(raw.lstrip(_EDGES))
            end = max(start + 1, end - (len(raw) - len(raw.rstrip(_EDGES + "(@"))))
            core = text[start:end]
            while i < len(order) and order[i][1] <= start:
                i += 1
            kind = 0
            for s, e, k in order[i : i + 4]:
                if s < end and start < e:
                    kind = k + 1
                    break
            before = text[max(0, start - 40) : start].lower().split()
            n = len(self.doc)
            self.doc.append(doc)
            self.place.append((start, end))
            self.seen.append(kind)
            self.x.append(node_features(core, before[-2:]))
            chained = last is not None and not text[last[1] : start].strip(" \t\n\x0b\x0c\r" + _EDGES + "(")
            if chained:
                self.edges.append((last[0], n, 0))
            last = (n, end)
            run = (run if chained else "")[-32:] + "".join(_DIGITS.findall(core))
            keys = _alike(core, run)
            near = {like[key] for key in keys if key in like} | {sure[key] for key in keys if key in sure and not kind}
            for key in keys:
                if kind:
                    near.update(open_.pop(key, ()))
                    sure[key] = n
                else:
                    open_.setdefault(key, []).append(n)
                like[key] = n
            self.edges += [(other, n, 1) for other in sorted(near)]
            count += 1
            if most and count >= most:
                break


def node_features(core: str, before: list[str]) -> list[float]:
    digits = "".join(_DIGITS.findall(core))
    n = len(digits)
    runs = core.split(".")
    words = [w.strip(_EDGES) for w in before]
    return [
        1.0, "@" in core, "@" in core[1:-1], core.count("@") > 1, "." in core.rpartition("@")[2], n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
        len(runs) == 4 and all(r.isdigit() for r in runs), core.startswith("+"), core.startswith("("), "-" in core, any(c.isalpha() for c in core), 13 <= n <= 19 and luhn(digits),
        len(core) == n, *(any(w in cue for w in words) for cue in CUES), bool(before) and before[-1].startswith("+"),
    ]


N_LABELS = 1 + len(KINDS)


class Field:
    """Node weights (features x labels) and the chain and skip potentials (labels x labels)."""

    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def marginals(self, x: np.ndarray, edges: np.ndarray, seen: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product over all edges at once; on forests it is exact after as many rounds as they are deep. seen: labels known for certain, or 0."""
        local = x @ self.weights
        local -= np.logaddexp.reduce(local, axis=1, keepdims=True)
        if seen is not None:
            local[seen > 0] = CLAMP * (np.eye(N_LABELS)[seen[seen > 0]] - 1)
        if not len(edges):
            return np.exp(local)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        psi = self.edge[edges[:, 2]]
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        messages = np.zeros((2 * m, N_LABELS))
        belief = local
        for _ in range(rounds):
            new = np.logaddexp.reduce((belief[src] - messages[back])[:, :, None] + psi, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
            belief = local.copy()
            np.add.at(belief, dst, messages)
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def unknown(y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Nodes without a label that are like one with a label, and those without that are chained to them."""
    a, b, kind = edges.T
    out = np.zeros(len(y), bool)
    n = -1
    while n < (n := int(out.sum())):
        spreads = np.where(kind == 0, out[a], out[a] | (y[a] > 0)), np.where(kind == 0, out[b], out[b] | (y[b] > 0))
        out[b[spreads[0]]] = True
        out[a[spreads[1]]] = True
        out &= y == 0
    return out


def learn(x: np.ndarray, y: np.ndarray, edges: np.ndarray, steps: int = 300) -> Field:
    """Node weights and edge potentials by pseudo-likelihood: each node given its features and its neighbours' labels.

    Weights and chain potentials are drawn to 0, skip potentials to ``AGREE`` for equal labels and its opposite for others.
    """
    known = ~unknown(y, edges)
    at = np.cumsum(known) - 1
    edges = edges[known[edges[:, 0]] & known[edges[:, 1]]]
    edges = np.column_stack([at[edges[:, :2]], edges[:, 2]])
    x, y = x[known], y[known]
    bare = np.zeros_like(x)
    bare[:, 0] = x[:, 0]
    views = ((x, 1), (x, 0), (bare, 1))  # features, and whether the neighbours are seen
    want = np.eye(N_LABELS)[y]
    after, before, like = np.zeros((3, len(x), N_LABELS))
    chain, skip = edges[edges[:, 2] == 0], edges[edges[:, 2] == 1]
    np.add.at(after, chain[:, 0], want[chain[:, 1]])
    np.add.at(before, chain[:, 1], want[chain[:, 0]])
    np.add.at(like, skip[:, 0], want[skip[:, 1]])
    np.add.at(like, skip[:, 1], want[skip[:, 0]])
    theta = [np.zeros((x.shape[1], N_LABELS)), np.zeros((N_LABELS, N_LABELS)), AGREE * (2 * np.eye(N_LABELS) - 1)]
    start = [t.copy() for t in theta]
    first, second = [[np.zeros_like(t) for t in theta] for _ in range(2)]
    for t in range(1, steps + 1):  # Adam
        w, c, s = theta
        context = after @ c.T + before @ c + like @ s
        g = [PRIOR * (now - was) for now, was in zip(theta, start)]
        for view, near in views:
            z = view @ w + near * context
            r = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True)) - want
            g[0] += view.T @ r
            if near:
                g[1] += r.T @ after + before.T @ r
                g[2] += like.T @ r
        g[2] = (g[2] + g[2].T) / 2  # skip edges have no direction
        for k, (a, b) in enumerate(zip(first, second)):
            d = g[k] / (len(views) * len(x))
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            theta[k] -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Field(theta[0], np.stack(theta[1:]))


def fit(docs: DataFrame, sample: int = SAMPLE, nodes: int = SAMPLE_NODES) -> Field | None:
    """Fit on at most ``sample`` documents that hold a node (those of smallest hash of the id; one text of each id)."""
    ship(docs.sparkSession)
    rows = id_text(docs).where(F.col("doc_id").isNotNull() & F.col("text").rlike(_SOME))
    chosen = cut(rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "cid"), "pii-sample")
    some = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("cid")).groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                found, text = Nodes(), t.decode()
                found.add(0, text, base_spans(text), nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id]), pa.array([[float(v) for r in found.x for v in r]], pa.list_(pa.float64())), pa.array([found.seen], pa.list_(pa.int64())), pa.array([[v for e in found.edges for v in e]], pa.list_(pa.int64()))],
                    ["doc_id", "x", "y", "edges"],
                )

    got = cut(some.mapInArrow(run, "doc_id long, x array<double>, y array<long>, edges array<long>"), "pii-nodes").collect()  # bounded by the two limits
    xs, ys, es, at = [], [], [], 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.x)):
        if r.y:
            xs.append(np.array(r.x).reshape(len(r.y), -1))
            ys.append(np.array(r.y))
            es.append(np.array(r.edges, np.int64).reshape(-1, 3) + [at, at, 0])
            at += len(r.y)
    if not xs:
        return None
    return learn(np.concatenate(xs), np.concatenate(ys), np.concatenate(es))


def _fits(kind: int, run: str) -> bool:
    """Could this be of the kind at all: an address has letters, an ip four numbers up to 255 and nothing else, a card and a telephone their number of digits and no letters."""
    numbers = _DIGITS.findall(run)
    digits, letters = sum(map(len, numbers)), any(c.isalpha() for c in run)
    return (letters, not letters and len(numbers) == 4 and all(_parts_ok(x) for x in numbers), not letters and 13 <= digits <= 19, not letters and LAST <= digits <= 15)[kind]


def added_spans(nodes: Nodes, field: Field, items: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Per document, what the field is certain of and no pattern found: neighbouring nodes of a kind together."""
    extra: list[list[tuple[int, int, int]]] = [[] for _ in items]
    if not nodes.x:
        return extra
    p = field.marginals(np.array(nodes.x, float), np.array(nodes.edges, np.int64).reshape(-1, 3), np.array(nodes.seen))
    label = np.where(p.max(1) >= CERTAIN, p.argmax(1), 0)
    chained = {a for a, b, kind in nodes.edges if kind == 0 and label[a] == label[b]}
    run = None
    for n in np.flatnonzero(label).tolist():
        doc, (start, end) = nodes.doc[n], nodes.place[n]
        if run and run[0] == doc and run[1] == label[n] and run[4] == n - 1 and n - 1 in chained:
            run[3:] = [end, n]
        else:
            run = [doc, int(label[n]), start, end, n]
            extra[doc].append(run)  # type: ignore[arg-type]
    for doc, runs in enumerate(extra):
        kept = []
        for _, k, start, end, _ in runs:  # type: ignore[misc]
            if _fits(k - 1, items[doc][start:end]) and not any(s < end and start < e for _, s, e in base[doc]):
                kept.append((k - 1, start, end))
        extra[doc] = kept
    return extra


def pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, base, spans)``, a row per row of docs: arrays of (kind, start, end) in code points, by kind, then start.

    ``base``: what the patterns find; ``spans``: that and what the field adds. Null text
    counts as empty; null ids stay null; repeated rows each have their row. Without
    digits and at signs in the corpus there is nothing to fit or to find.
    """
    field = fit(docs, sample)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", kind), ("spans", kind)])

    def told(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), texts(batch)
            items, base, nodes = [""] * len(raw), [[] for _ in raw], Nodes()
            for k, t in enumerate(raw):
                if _ANY.search(t):
                    items[k] = t.decode()
                    base[k] = base_spans(items[k])
                    nodes.add(k, items[k], base[k])
            extra = added_spans(nodes, field, items, base) if field else [[] for _ in raw]
            yield from out(schema, [(i, told(b), told(b + e)) for i, b, e in zip(ids, base, extra, strict=True)])

    span = "array<struct<kind:string,start:long,end:long>>"
    return id_text(docs).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and a hash of the patterns' spans, and all spans as text."""

    def told(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
