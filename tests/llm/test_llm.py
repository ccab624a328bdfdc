"""The training-data operators: round trips, brute force, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import chat, decontaminate, exact, lm, packing, pii, queries, simhash, substring, tokens, toxicity
from locusframe.plans.runtime import table

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   ", "\n", "a", "x" * 5000, "Ünï ßİ é ▁  y", "<|endoftext|> a's <s>", "don't we'll 3.5km", "日本語 テキスト", "\x1c\x85z", "a  b   c", "one two three four"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ids that clash, and columns whose names operators use inside."""
    rows = [(i, t, "en", "h") for i, t in enumerate(ODD)] + [(None, "a b c", None, None), (None, None, None, None), (3, "\n", "en", "h"), (3, "other text", "en", "h"), (7, ODD[7], "en", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string")
    return d.withColumns({c: F.lit(1) for c in ("fp", "name", "kept", "_drop", "_id", "pos", "node", "label")})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def texts_of(d):
    return [(r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect()]


# ------------------------------------------------------------ 1


def test_chat_round_trip(spark):
    words = ["<|im_end|>", "<|im_start|>", "<|im_turn|>", "<", "|", "\\", "<\\|", "\n", "ok", "é", ""]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "<|nl|>"]), "".join(rng.choices(words, k=rng.randint(0, 8)))) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(100, None, None, None), (100, 1, "user", None), (100, 1, "user", None), (None, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    got = chat.format_chat(d)
    back = {r.conv_id: [tuple(t) for t in r.ts] for r in got.select("conv_id", chat.read_chat(F.col("formatted")).alias("ts")).collect()}
    assert back == {c: [x[2:] for x in sorted(v)] for c, v in want.items()}
    for r in chat.digest(got).collect():
        turns = [x[2:] for x in sorted(want[r.conv_id])]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.n_messages == sum(k == 0 or turns[k - 1][0] != t[0] for k, t in enumerate(turns))
    assert chat.digest(chat.format_chat(d.limit(0))).count() == 0
    for r in got.collect():  # the spans are the texts under the mask, where they stand
        turns = [x[2:] for x in sorted(want[r.conv_id])]
        assert r.loss_mask == [role == "assistant" for role, _ in turns]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans] == [x for role, x in turns if role == "assistant"]


# ------------------------------------------------------------ 2


def test_decontamination_finds_other_slots(spark):
    item = "A train leaves the old station with 120 sleepy passengers and stops after 45 km near a village where 120 more get in."
    same = item.replace("120", "300").replace("45", "7")
    mixed = same.replace("300 more", "299 more")
    rows = [(1, "Before it all " + item + " And after."), (2, "So. " + same), (3, mixed), (4, "nothing of it"), (5, None), (6, " ".join(item.split()[:12])), (None, item), (2, "So. " + same)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    b = spark.createDataFrame([(9, item), (9, item), (8, "too short"), (None, item), (7, None)], "item_id long, text string").withColumn("id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 9): False, (2, 9): True}
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(d, b).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_with_and_without_the_filter(spark, docs, monkeypatch):
    b = table(spark, SF, "benchmark")
    with_filter = {tuple(r) for r in decontaminate.contaminated(docs, b).collect()}
    monkeypatch.setattr(decontaminate, "FILTER_HASHES", 0)
    assert {tuple(r) for r in decontaminate.contaminated(docs, b).collect()} == with_filter


def test_decontamination_judges_each_occurrence(spark):
    item = "In the morning they gave Anna 3 red apples and then some bread, later on they gave Anna 5 red apples and then went back home."
    other = lambda name, x, y: item.replace("Anna", name).replace("3", x).replace("5", y)
    rest = " Nobody there had seen the like of it before. "
    longer = other("Berta", "4", "8").replace("some bread", "some quite old bread")
    rows = [
        (1, item), (2, rest + item + rest + "They gave Carl 9 red apples and then left."), (3, other("Berta", "4", "8") + rest + other("Carl", "6", "7")),
        (4, other("Berta", "4", "4")), (5, longer + rest + other("Carl", "6", "7").replace("some bread", "some very dry bread")),
        (6, other("Berta", "4", "8")), (6, other("Carl", "6", "7")),
    ]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id: r.reworded for r in decontaminate.contaminated(d, b).collect()} == {1: False, 2: False, 3: True, 5: True, 6: True}


def test_decontamination_reads_names_at_sentence_starts(spark):
    item = "Once there was a farm. Tom has 3 apples in a basket. Tom gives 2 apples to his sister. Tom then buys 7 apples at the market. How many apples does Tom have now?"
    other = item.replace("Tom", "Jim")
    odd = "Every evening the old clock strikes. Then 4 birds sing in the garden. Then the dog barks at 9 cats. After that Bill goes to sleep until the early morning comes and the sun shines on the wet roof of the barn."
    rows = [
        (1, other), (2, item.replace(" Tom", "\nTom")), (3, other.replace("basket. Jim", "basket, Jim").replace("sister. Jim", "sister\nJim")),
        (4, odd.replace("Bill", "Will").replace("Then the", "Now the")), (5, other.replace("Jim gives", "Ann gives").replace("Jim then", "Bob then")),
    ]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(8, odd), (9, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(d, b).collect()} == {(1, 9): True, (2, 9): False, (3, 9): True, (4, 8): True}


def test_decontamination_of_short_and_all_slot_items(spark):
    items = [
        (1, "Who was there?"), (2, "3 5 8 13 21 34 55"), (3, "Stop. Go home."), (4, "Add 4 kg 7 kg 9 kg 12 kg 30 kg."), (5, ""), (6, "..."),
        (7, "Tom sold red apples today"), (8, "Dr Anna Maria Smith met Mr John Paul Jones."),
    ]
    rows = [
        (1, "He asked. Who was there? Nobody."), (2, "He asked who was there? Nobody."), (3, "The row 3 5 8 13 21 34 55 goes on."), (4, "The row 3 5 8 13 21 34 56 goes on."),
        (5, "Go home.\nStop."), (6, "Go home now. Stop."), (7, "add 4 kg 7 kg 9 kg 12 kg 30 kg"), (8, "Add 4 kg 6 kg 9 kg 12 kg 31 kg."), (9, "Now Tom sold red apples today again"),
        (10, "then Jim sold red apples today"), (11, "It is said that Dr Anna Maria Smith met Mr John Paul Jones."), (12, "It is said that Dr Berta Maria Smith met Mr John Luke Jones."), (13, "..."), (14, None),
    ]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 7), (10, 7), (11, 8)} | {(13, 6)}


def slow_windows(text, item=False):
    """{(what, begin, key, values)} of a text, from the docstrings: kinds of words, sentences, windows."""
    raw, begins = [], set()
    for line in text.split("\n"):
        begins.add(len(raw))
        for w in line.split():
            raw.append(w)
            if w.rstrip("\"')]")[-1:] in (".", "!", "?", ":"):
                begins.add(len(raw))
    n = len(raw)
    begins = sorted({b for b in begins if b < n})
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    core = [w.strip(marks) for w in raw]
    kind = ["#" if c[:1].isdigit() and not any(x.isalpha() for x in c) else "unit" if c.lower() in decontaminate.UNITS and len(c) > 1 else "name" if c[:1].isupper() and not c.isupper() else "" for c in core]
    got = set()
    for a, b in zip(begins, [*begins[1:], n]):
        if b - a < 5:
            got.add(("sentence", a, tuple(c.lower() for c in core[a:b]), ()))
    template, literal = set(), set()
    for i in range(n - 4):
        free = [q for q in range(i, i + 5) if kind[q] == "name" and q in begins]
        sure = {q for q in range(i, i + 5) if kind[q]} - set(free)
        if 5 - len(sure) < 2:
            literal.add(("literal", i, tuple(c.lower() for c in core[i : i + 5]), ()))
        for m in range(1 << len(free)):
            slots = sure | {q for k, q in enumerate(free) if m >> k & 1}
            if 5 - len(slots) >= 2:
                template.add(("template", i, tuple(f"<{kind[q]}>" if q in slots else core[q].lower() for q in range(i, i + 5)), tuple(core[q].lower() if q in slots else None for q in range(i, i + 5))))
    if item and n < 5:
        return got
    if item:
        return template if 2 * len({t[1] for t in template}) >= n - 4 else template | literal
    return got | template | literal


def test_windows_against_brute_force(docs):
    rng = random.Random(12)
    bits = ["Tom", "gave", "3", "red", "apples", "kg", "to", "Anna.", "the", "The", "IBM", "\n", "then", "4.5", "he", "went?", "(so", "..."]
    some = [" ".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(300)] + [t for _, t in texts_of(docs)[:30]]
    words = decontaminate.Words()
    for text in some:
        for item in (False, True):
            w = decontaminate.windows([text.encode()], words, 5)
            at = w.of_item(5) if item else range(len(w.h))
            want = slow_windows(text, item)
            assert sorted(w.at[list(at)].tolist()) == sorted(x[1] for x in want), text
            for i in at:
                mine = [x for x in want if x[1] == w.at[i] and x[0] == ("template", "literal", "sentence")[w.kind[i]]]
                assert mine
            # equal keys and equal hashes go together
            seen = {}
            for i in at:
                seen.setdefault((int(w.at[i]), int(w.kind[i])), set()).add(int(w.h[i]))
            for key, hashes in seen.items():
                keys = {x[2] for x in want if x[1] == key[0] and x[0] == ("template", "literal", "sentence")[key[1]]}
                assert len(hashes) == len(keys)


def test_decontamination_of_odd_and_long_texts(spark, odd):
    """Extra columns, odd characters, shared and null ids, empty tables, and an item deep inside a very long text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = "In the old town of Lund 25 small boats left the harbour early in the grey morning."
    long = " ".join(word() for _ in range(150_000)) + " so it was. " + item.replace("25", "31") + " " + " ".join(word() for _ in range(50_000))
    d = odd.unionByName(spark.createDataFrame([(50, long), (51, "q " * 100_000), (3, item)], "doc_id long, text string"), allowMissingColumns=True)
    b = spark.createDataFrame([(1, item, 5), (1, item, 6), (2, None, 7), (3, "x " * 3000, 8)], "item_id long, text string, h int")
    assert {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(d, b).collect()} == {(50, 1): True, (3, 1): False}
    kept = decontaminate.decontaminate(d, b)
    assert kept.count() == d.count() - 2 and kept.columns == d.columns and kept.where("doc_id = 3").count() == d.where("doc_id = 3").count() - 1


def test_windows_of_texts_together_are_those_of_each(docs):
    rng = random.Random(16)
    some = [t.encode() for _, t in texts_of(docs)] + [b"", b"One.", b"a b c d", b"\n\n"] * 5
    rng.shuffle(some)
    known = decontaminate.Words()
    number = [known[w] for t in some[::9] for w in t.split()]
    among = np.unique(known.tables()[2][number])
    for words in (decontaminate.Words(), decontaminate.Words(among)):
        whole = decontaminate.windows(some, words, 5)
        owner = np.searchsorted(whole.first, whole.at, side="right") - 1
        got = Counter(zip(owner.tolist(), (whole.at - whole.first[owner]).tolist(), whole.h.tolist(), whole.either.tolist(), whole.kind.tolist()))
        want: Counter = Counter()
        for k, t in enumerate(some):
            w = decontaminate.windows([t], words, 5)
            want.update(zip([k] * len(w.h), w.at.tolist(), w.h.tolist(), w.either.tolist(), w.kind.tolist()))
        assert got == want


# ------------------------------------------------------------ rows whatever their ids


def test_stages_judge_rows_not_ids(spark, odd):
    """Null and shared ids, repeated rows and clashing columns: each stage keeps exactly the rows that brute force keeps."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    long = [" ".join(word() for _ in range(80)) for _ in range(6)]
    near = long[0].replace(long[0].split()[40], "changed", 1)
    item = "In the morning they gave Anna 3 red apples and then some bread, later on they gave Anna 5 red apples and then went back home."
    rows = [(1, long[0]), (3, near), (3, long[1]), (None, long[0]), (None, long[2]), (None, long[2]), (7, long[3]), (7, long[3] + " "), (None, item), (7, item.replace("Anna", "Berta")), (7, long[4]), (None, None), (None, ""), (9, None), (None, "you idiot moron scum"), (5, "you idiot moron scum"), (5, long[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "_drop", "_key", "_id", "_best", "grp", "fp", "n", "h", "score", "_nth_of_row", "kept")})
    left = lambda x: Counter((r.doc_id, r.text) for r in x.collect())
    first = lambda k, t: (k is None, k or 0)
    for table_ in (d, odd):
        had = [(r.doc_id, r.text) for r in table_.select("doc_id", "text").collect()]
        groups = defaultdict(list)
        for k, t in had:
            groups[norm(t or "")].append((k, t))
        got = exact.exact_dedup(table_)
        kept = left(got)
        assert got.columns == table_.columns and sum(kept.values()) == len(groups)
        assert {norm(t or ""): k for k, t in kept} == {key: min(g, key=lambda x: first(*x))[0] for key, g in groups.items()}
        prints = [slow_fingerprint(t or "") for _, t in had]
        comps = slow_components(list(range(len(had))), prints)
        want = defaultdict(list)
        for (k, t), c in zip(had, comps):
            want[c].append((k, t))
        got = simhash.simhash_dedup(table_)
        kept = left(got)
        assert got.columns == table_.columns and sum(kept.values()) == len(want)
        assert Counter(k for k, _ in kept.elements()) == Counter(min(g, key=lambda x: first(*x))[0] for g in want.values())
        b = spark.createDataFrame([(1, item)], "item_id long, text string")
        got = decontaminate.decontaminate(table_, b)
        assert got.columns == table_.columns and left(got) == Counter((k, t) for k, t in had if "red apples" not in (t or ""))
        labels = spark.createDataFrame([(100, 1, 1)], "doc_id long, quality int, toxic int")
        got = toxicity.clean(table_, labels)
        assert got.columns == table_.columns and left(got) == Counter(had)


def test_clean_drops_the_toxic_rows_alone(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7)))
    rows, marks = [], []
    for k in range(900):
        ws, bad = [word() for _ in range(rng.randint(20, 60))], k % 6 == 0
        if bad:
            ws[rng.randrange(len(ws))] = "moron"
        rows.append((k, " ".join(ws)))
        marks.append((k, 1, int(bad)))
    extra = [(None, rows[6][1]), (None, rows[1][1]), (2, rows[12][1]), (None, None)]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("_row", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = Counter((r.doc_id, r.text) for r in toxicity.clean(d, labels).collect())
    assert kept == Counter((k, t) for k, t in rows + extra if not (t and "moron" in t.split()))


# ------------------------------------------------------------ 3


def test_repeats(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(80)
    near = line.split()
    near[40] = "changed"
    rows = [(k, f"{text(70)} {passage} {text(50)}") for k in range(4)] + [(10, f"{text(40)}\n{line}\n{text(20)}"), (11, f"{line}\n{text(9)}"), (12, " ".join(near)), (20, text(300)), (21, None), (22, ""), (23, f"{passage[:0]}{text(40)}"), (None, passage), (24, (own := text(40)) + "\n" + own)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    got = defaultdict(list)
    for r in substring.repeats(d).collect():
        got[r.doc_id].append(r)
    assert set(got) == {0, 1, 2, 3, 10, 11, 12}
    by = dict((k, t) for k, t in rows if k is not None)
    for k in range(4):
        (r,) = got[k]
        assert by[k][r.start : r.end] in passage and r.n_words >= 40 and r.class_id == 0 and r.removed == (k > 0)
    assert {r.class_id for k in (10, 11, 12) for r in got[k] if r.kind == "paragraph"} == {10}
    assert substring.repeats(d.limit(0)).count() == 0 and substring.repeats(d.where("doc_id is null")).count() == 0


def test_short_lines_repeat(spark):
    verse = ["the moon goes down behind the hill", "and all the birds are still tonight my friend", "no wind is in the trees"]
    rows = [(k, "\n".join([f"own words of text {k} alone {k * 7}", v, f"other words {k} that no other text has"])) for k, v in enumerate(verse * 2)] + [(9, verse[2]), (10, "four words are few"), (11, "four words are few")]
    got = {(r.doc_id, r.class_id, r.kind, r.removed) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, k % 3, "paragraph", k > 2) for k in range(6)} | {(9, 2, "paragraph", True)}


def test_large_band_groups_lose_no_link(spark, monkeypatch):
    """With groups of more than four taken as large, the classes are those of all pairs compared."""
    monkeypatch.setattr(substring, "PAIRWISE", 4)
    monkeypatch.setattr(substring, "_SEEDS", np.ones((2, substring.BANDS * substring.ROWS), np.uint64))  # one hash: bands meet often
    rng = random.Random(8)
    rows = []
    for base in range(3):
        stem = [f"b{base}w{k}" for k in range(60)]
        for _ in range(40):
            ws = list(stem)
            for _ in range(rng.randint(1, 4)):
                ws[rng.randrange(12, 60)] = f"v{rng.randrange(6)}"
            rows.append((len(rows), " ".join(ws)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    size = Counter(find(k) for k in sets)
    want = {k: find(k) for k in sets if size[find(k)] > 1}
    got = {r.doc_id: r.class_id for r in substring.paragraph_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_recall_of_banding(spark):
    """Of pairs of paragraphs at Jaccard 0.8 or more, most just above it, banding and components lose fewer than one in fifty."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows, groups = [], []
    for _ in range(250):
        base = [word() for _ in range(rng.randint(30, 110))]
        groups.append([len(rows)])
        rows.append(base)
        for _ in range(2):  # a changed word costs five shingles of n - 4, of both sides
            copy = list(base)
            for k in rng.sample(range(4, len(base) - 4), max(1, (len(base) - 4) // rng.choice([45, 46, 50, 60]))):
                copy[k] = word()
            groups[-1].append(len(rows))
            rows.append(copy)
    sets = [{tuple(r[i : i + 5]) for i in range(len(r) - 4)} for r in rows]
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b, similar(a, b)) for g in groups for k, a in enumerate(g) for b in g[k + 1 :]]
    wanted = [(a, b) for a, b, j in pairs if j >= 0.8]
    d = spark.createDataFrame([(k, "some line of its own\n" + " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in substring.paragraph_classes(d).where("n_words > 5").collect()}
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in wanted)
    assert len(wanted) > 200 and sum(0.8 <= j < 0.85 for _, _, j in pairs) > 100
    assert found / len(wanted) > 0.98
    # and nothing is linked that isn't similar to something in its class
    near = defaultdict(set)
    for a, b in wanted:
        near[a].add(b), near[b].add(a)
    assert all(near[k] for k in got)


def test_recall_of_passages(spark):
    """Passages of 51 words inside foreign paragraphs: 99 in 100 are found."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    text = lambda n: [word() for _ in range(n)]
    rows = []
    for k in range(300):
        passage = text(51)
        rows += [(2 * k, " ".join(text(40) + passage + text(40))), (2 * k + 1, " ".join(text(30) + passage + text(60)))]
    rows += [(1000 + k, " ".join(text(120))) for k in range(200)]
    got = {r.doc_id for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 0.97 * 600 and max(got) < 1000


def test_repeats_in_odd_and_long_texts(spark, odd):
    """Extra columns, odd characters, shared and null ids, and one very long text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    line = " ".join(word() for _ in range(40))
    long = " ".join(word() for _ in range(150_000)) + "\n" + line
    d = odd.unionByName(spark.createDataFrame([(50, long), (51, line), (51, line), (None, line)], "doc_id long, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.class_id, r.kind, r.removed) for r in substring.repeats(d).collect()}
    assert {x for x in got if x[2] == "paragraph"} == {(50, 50, "paragraph", False), (51, 50, "paragraph", True)} and {x[0] for x in got} == {50, 51}


# ------------------------------------------------------------ 4


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7)))
    rows, marks = [], []
    for k in range(1500):
        ws, bad = [word() for _ in range(rng.randint(20, 60))], k % 6 == 0
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(["idiot", "MORON!", "blarg", "blargish"])
        rows.append((k, " ".join(ws)))
        marks.append((k, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "idiot")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame(marks + [(None, 1, 1), (3, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    held = [k for k, _, _ in marks if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in set(held)) for k, _, _ in marks)
    right = sum(got[k].predicted == marks[k][2] for k in held)
    assert right / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values()) and not got[5000].predicted
    # labels of held-out rows have no say
    other = spark.createDataFrame([(k, q, 1 - t if k in set(held) else t) for k, q, t in marks], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(d, other).collect()}
    same = {r.doc_id: r.score for r in toxicity.toxicity(d, labels.where("text = 'x' and toxic is not null and doc_id is not null and not (doc_id = 7 and toxic = 0 and quality = 2)")).collect()}
    assert all(abs(again[k] - same[k]) < 1e-9 for k in held)
    assert {r.score for r in toxicity.toxicity(d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), labels).count() == 0


def test_trees_against_a_plain_implementation():
    """Each round by itself: for every node all splits are tried by sorting; the predictions agree."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 8)).astype(float)
    model = toxicity.Trees(rounds=6, depth=2).fit(x, y)
    raw = np.full(len(y), math.log(y.mean() / (1 - y.mean())))

    def leaf(g, h):
        return g.sum() ** 2 / (h.sum() + model.l2)

    for _ in range(6):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(2):
            below = []
            for rows in nodes:
                best = (1e-6, None, None)
                if len(rows) >= 20:
                    for f in range(4):
                        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, model.bins + 1)[1:-1])):
                            left = x[rows, f] <= cut
                            gain = leaf(g[rows[left]], h[rows[left]]) + leaf(g[rows[~left]], h[rows[~left]]) - leaf(g[rows], h[rows])
                            if gain > best[0] + 1e-12:
                                best = (gain, f, cut)
                split = x[rows, best[1]] > best[2] if best[1] is not None else np.zeros(len(rows), bool)
                below += [rows[~split], rows[split]]
            nodes = below
        for rows in nodes:
            raw[rows] -= model.rate * g[rows].sum() / (h[rows].sum() + model.l2)
    assert np.allclose(model.predict(x), 1 / (1 + np.exp(-raw)))


def slow_features(text, lexicon):
    """The values of FEATURES by their names, word by word."""
    marks = toxicity.PUNCT
    raw = text.lower().split()
    entry = lambda w: max((lexicon[u], u) for u in toxicity.units(w) if u in lexicon) if any(u in lexicon for u in toxicity.units(w)) else None
    hits, you, odd, odd_hits = {}, [], 0, 0
    for k, w in enumerate(raw):
        core = w.strip(marks)
        found = entry(core) if core else None
        if core in toxicity.SECOND_PERSON:
            you.append(k)
        if core and not core.isalpha() and any(c.isalpha() for c in core):
            odd += 1
            if not found:
                found = entry("".join(c for c in core.translate(toxicity.LEET) if c.isalpha()))
                odd_hits += found is not None
        if found:
            hits[k] = found[0]
    n, b = max(1, len(raw)), max(1, len(text.encode()))
    near = sum(any(abs(k - y) <= 5 for y in you) for k in hits)
    chars = [sum(c.isascii() and c.isupper() for c in text), text.count("!"), sum(c.isascii() and c in marks and c != "!" for c in text), sum(c in "0123456789" for c in text)]
    return [len(hits) / n, math.log1p(len(hits)), sum(hits.values()) / n, max(hits.values(), default=0), near / max(1, len(hits)), len(you) / n, *(c / b for c in chars), odd / n, odd_hits / n, math.log1p(len(raw))]


def test_features_against_brute_force(docs):
    lexicon = {"idiot": 3.0, "moron": 2.0, "blarg*": 1.7, "the": 1.6, "ende*": 1.8}
    coder, rng = toxicity.Coder(lexicon), random.Random(9)
    bits = ["you", "Idiot!", "1d10t", "m0r0n", "blarging", "the", "«tu»", "word", "ÜBER", "x" * 70, "a1", "!!!", "\n", "", "endeed"]
    some = [" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300)] + [t for _, t in texts_of(docs)[:40]]
    some.append(" ".join(rng.choices(bits, k=200_000)))
    for t in some:
        assert toxicity.features(t.encode(), coder) == pytest.approx(slow_features(t, lexicon)), t[:80]


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    s = rng.random(500)
    x, y = toxicity.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] and y[-1] < 1


# ------------------------------------------------------------ 5


def slow_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints, distance=3):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)].append(k)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


@pytest.mark.parametrize("pairwise", [512, 1])
def test_simhash(spark, odd, docs, pairwise):
    for d in (odd, docs):
        rows = texts_of(d)
        prints = [slow_fingerprint(t) for _, t in rows]
        want = Counter((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, slow_components([k for k, _ in rows], prints)))
        got = simhash.simhash_classes(d, pairwise=pairwise).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id")
        assert Counter(tuple(r) for r in got.collect()) == want


def test_simhash_links_of_dense_groups(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(60)})
    d = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for pairwise in (512, 8, 1):
        up = {simhash.signed(p): simhash.signed(p) for p in prints}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in simhash.links(d, pairwise=pairwise).collect():
            a, b = find(r.a), find(r.b)
            up[max(a, b)] = min(a, b)
        groups = defaultdict(set)
        for p in prints:
            groups[find(simhash.signed(p))].add(p)
        want = defaultdict(set)
        for p, c in zip(prints, slow_components(list(range(len(prints))), prints)):
            want[c].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_dedup(spark, docs):
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    want = {r.component_id for r in simhash.simhash_classes(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


# ------------------------------------------------------------ 6


def test_token_counts(spark, odd, docs):
    sp = tokens.model(PIECES)
    for d in (odd, docs):
        rows = texts_of(d)
        want = Counter((k, len(t.encode()), n, n > 4096) for (k, t), n in zip(rows, [len(x) for x in sp.encode([t for _, t in rows], num_threads=1)]))
        assert Counter(tuple(r) for r in tokens.token_counts(d, PIECES).collect()) == want
    assert tokens.token_counts(odd.limit(0), PIECES).count() == 0


def test_pieces_change_no_count(docs):
    sp = tokens.model(PIECES)
    items = [t.encode() for _, t in texts_of(docs)][:60] + [t.encode() for t in ODD if t]
    want = [len(sp.encode(t.decode())) for t in items]
    for size in (1, 7, 100):
        assert tokens.count_all(items, PIECES, batch_bytes=500, piece_bytes=size) == want


# ------------------------------------------------------------ 7

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(text: str) -> list:
    def fine(k, m):
        digits = re.sub(r"[^0-9]", "", m)
        return (True, k != 1 or all(int(x) <= 255 for x in m.split(".")), 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]

    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if fine(k, m[0])]


def test_base_spans():
    rng = random.Random(6)
    bits = ["a", "@", ".", "-", "b.c", " ", "1", "23", "4111 1111 1111 1111", "+49 (30) 1234567", "10.0.0.1", "999.1.1.1", "%", "x@y.z", "\n", "é", "٣"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert pii.base_spans(t) == slow_spans(t), t


def test_pii(spark, odd, docs):
    for d in (odd, docs):
        want = Counter((k, tuple(slow_spans(t))) for k, t in texts_of(d))
        got = pii.pii(d).collect()
        assert Counter((r.doc_id, tuple((pii.KINDS.index(s.kind), s.start, s.end) for s in r.base)) for r in got) == want
        assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    assert pii.digest(pii.pii(odd.limit(0))).count() == 0


def test_field_agrees_on_repeats():
    """A chain of equal nodes: what is certain of one carries over to the others."""
    weights = np.zeros((2, pii.N_LABELS))
    weights[0, 1], weights[1, 0] = 6, 0.3
    edge = np.tile(np.where(np.eye(pii.N_LABELS) > 0, 2.0, -2.0), (2, 1, 1))
    field = pii.Field(weights, edge)
    x = np.array([[1, 0], [0, 1], [0, 1]], float)
    p = field.marginals(x, np.array([[0, 1, 1], [1, 2, 1]]), rounds=20)
    sure = field.marginals(x[1:], np.array([[0, 1, 1]]), np.array([3, 0]))
    assert sure.argmax(1).tolist() == [3, 3] and sure[0, 3] > 1 - 1e-9
    assert p.argmax(1).tolist() == [1, 1, 1] and field.marginals(x[1:], np.zeros((0, 3), int)).argmax(1).tolist() == [0, 0]
    # on a tree the messages are exact
    joint = {}
    for a in range(5):
        for b in range(5):
            for c in range(5):
                joint[a, b, c] = math.exp((x @ weights)[[0, 1, 2], [a, b, c]].sum() + edge[1][a, b] + edge[1][b, c])
    want = [sum(v for k, v in joint.items() if k[1] == s) / sum(joint.values()) for s in range(5)]
    assert np.allclose(field.marginals(x, np.array([[0, 1, 1], [1, 2, 1]]), rounds=60)[1], want, atol=1e-6)


def planted_mentions(rng, n):
    """Texts in which personal data occur once as the patterns know them and again in other forms, among other numbers: (id, text, [(kind, start, end)] of the other forms)."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    words = lambda: " ".join(word() for _ in range(rng.randint(3, 30)))
    docs = []
    for k in range(n):
        parts, want = [words()], []

        def put(s, kind=None):
            at = sum(map(len, parts)) + len(parts)
            if kind:
                want.append((kind, at, at + len(s)))
            parts.extend([s, words()])

        for _ in range(rng.randint(1, 3)):
            what = rng.randrange(7)
            if what == 0:
                a, b, c = rng.randint(200, 999), 555, rng.randint(1000, 9999)
                put(f"+1 ({a}) {b}-{c}")
                for form in rng.sample([f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"({a}) {b}-{c}"], 2):
                    put(form, "phone")
            elif what == 1:
                local, host = f"{word()}.{rng.randint(0, 99):02d}", f"mail{rng.randint(1, 9)}.example.com"
                put(f"{local}@{host}")
                put(rng.choice([f"{local}[at]{host}", f"{local}(at){host}", f"{local}@localhost"]), "email")
            elif what == 2:
                ip = [str(rng.randint(100, 255)) for _ in range(4)]
                put(".".join(ip))
                put(rng.choice("-_/").join(ip), "ip")
            elif what == 3:
                d = "4" + "".join(rng.choices("0123456789", k=14))
                d += next(x for x in "0123456789" if pii.luhn(d + x))
                put(d)
                put(rng.choice("./_").join(d[i : i + 4] for i in range(0, 16, 4)), "card")
            elif what == 4:
                x = str(rng.randint(10 ** rng.randint(1, 11), 10**12))
                put(x), put(x)
            elif what == 5:
                put(f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"), put(f"{rng.randint(1, 999)}.{rng.randint(10, 99)}")
            else:
                put('token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"')
        docs.append((k, " ".join(parts), want))
    return docs


def test_field_adds_other_forms_of_what_is_certain(spark):
    """End to end: recall over 0.9 and precision over 0.95 on planted repeats that no pattern finds; nothing without a likeness."""
    docs = planted_mentions(random.Random(3), 600)
    rows = {r.doc_id: r for r in pii.pii(spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string"), sample=400).collect()}
    hit, missed, wrong = Counter(), Counter(), 0
    for k, text, want in docs:
        base = {tuple(s) for s in rows[k].base}
        assert base == {(pii.KINDS[x], s, e) for x, s, e in slow_spans(text)}
        added = {tuple(s) for s in rows[k].spans} - base
        over = lambda a, b: a[0] == b[0] and a[1] < b[2] and b[1] < a[2]
        want = [w for w in want if not any(s < w[2] and w[1] < e for _, s, e in base)]
        for w in want:
            (hit if any(over(a, w) for a in added) else missed)[w[0]] += 1
        wrong += sum(not any(over(a, w) for w in want) for a in added)
    assert all(hit[kind] >= 0.9 * (hit[kind] + missed[kind]) for kind in pii.KINDS) and sum(hit.values()) > 500
    assert wrong <= 0.05 * sum(hit.values())


def test_unknown_nodes():
    edges = np.array([[0, 1, 1], [1, 2, 0], [2, 3, 0], [4, 5, 1], [6, 7, 0]])
    assert pii.unknown(np.array([3, 0, 0, 0, 0, 0, 2, 0]), edges).tolist() == [False, True, True, True, False, False, False, False]


# ------------------------------------------------------------ 8


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


@pytest.mark.parametrize("block,hashed", [(4096, F.xxhash64), (3, F.xxhash64), (2, lambda c: F.xxhash64(c) % 5)])
def test_exact_classes(spark, odd, docs, block, hashed):
    for d in (odd, docs.where(F.length("text") < 400)):
        rows = [(k, norm(t)) for k, t in texts_of(d)]
        groups = defaultdict(list)
        for k, t in rows:
            groups[t].append(k)
        least = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
        want = {(k, least[t], len(groups[t]), hashlib.sha256(t.encode()).digest(), rows.count((k, t)), k == least[t]) for k, t in rows}
        assert {tuple(r)[:3] + (bytes(r.sha), r.n_rows, r.kept) for r in exact.exact_classes(d, block, hashed).collect()} == want


def test_rows_that_repeat_come_out_as_often(spark, tmp_path):
    rows = [(1, "a  b")] * 2500 + [(1, "c"), (2, "a b"), (None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in queries.op8_exact_dedup(spark, f"{tmp_path}").collect())
    assert got == {(1, 1, 2501, True): 1, (1, 1, 2501, False): 2499, (2, 1, 2501, False): 1, (1, 1, 2, True): 1, (None, 1, 2, False): 1}


def test_exact_dedup(spark, odd, docs):
    for d in (odd, docs):
        rows = Counter(norm(t) for _, t in texts_of(exact.exact_dedup(d)))
        assert set(rows.values()) == {1} and set(rows) == {norm(t) for _, t in texts_of(d)}
        assert exact.exact_dedup(d).columns == d.columns
    assert exact.exact_dedup(odd.limit(0)).count() == 0 and exact.exact_classes(odd.limit(0)).count() == 0


# ------------------------------------------------------------ 9


def slow_mixture(train, one, two, heads):
    """EM of each bucket over every training token, held out in turn, with the estimates rounded to the cells' means as the operator's are."""
    n, v, cells = sum(one.values()), len(one), defaultdict(list)
    for ws in train:
        for a, w in zip([None, *ws], ws):
            context = heads[a] - 1
            p2, p1 = ((two[a, w] - 1) / context if context else 0) * (v + 1), (one[w] - 1) / max(1, n - 1) * (v + 1)
            bucket = min(context.bit_length(), lm.BUCKETS - 1)
            cell = [0 if x == 0 else min(max(math.floor(math.log(x) / lm.CELL) + lm.CELLS // 2, 1), lm.CELLS - 1) for x in (p2, p1)]
            cells[bucket, *cell].append((p2, p1))
    weights = np.tile([0.5, 0.4, 0.1], (lm.BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for b in range(lm.BUCKETS):
        rows = [(len(x), sum(p for p, _ in x) / len(x), sum(p for _, p in x) / len(x), 1.0) for k, x in cells.items() if k[0] == b]
        if rows:
            mix = [1 / 3] * 3
            for _ in range(lm.EM_ROUNDS):
                parts = [(m, [y * p for y, p in zip(mix, ps)]) for m, *ps in rows]
                mix = [sum(m * x[k] / sum(x) for m, x in parts) / sum(m for m, _ in parts) for k in range(3)]
            mix[2] = max(mix[2], lm.FLOOR)
            weights[b] = np.array(mix) / sum(mix)
    return weights


@pytest.mark.parametrize("size,ngrams,deal", [(1 << 24, 1 << 20, 12), (3000, 500, 12), (3000, 200, 3)])
def test_lm(spark, odd, docs, size, ngrams, deal, monkeypatch):
    monkeypatch.setattr(lm.counts_of, "__defaults__", (deal, 5))  # slices of few chunks
    for d in (odd, docs):
        rows = [(k, t.encode().lower().split() + [b" "]) for k, t in texts_of(d)]
        train = [w for k, w in rows if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
        one, two = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([None, *ws], ws))
        n, v = sum(one.values()), len(one)
        got = sorted(lm.lm_scores(d, chunk_bytes=size, range_ngrams=ngrams, deal_bits=deal).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score))
        want = sorted(((k is None, k or 0, len(ws), sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), sum(one[w] > 0 for w in ws)) for k, ws in rows))
        for r, w in zip(got, want, strict=True):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (w[2], w[4], n) and r.base_score == pytest.approx(w[3])
        heads = Counter(p[0] for p in two.elements())  # a context's count; None: the start
        weights = slow_mixture(train, one, two, heads)

        def p(v, w):
            mix = weights[lm._bucket(np.array([heads[v]]))[0]]
            return mix[0] * two[v, w] / max(1, heads[v]) + mix[1] * one[w] / max(1, n) + mix[2] / (len(one) + 1)

        slow = Counter((k, len(ws), round(sum(math.log10(p(v, w)) for v, w in zip([None, *ws], ws)), 6)) for k, ws in rows)
        assert Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got) == slow
        for v in [None, *sorted(heads.keys() - {None})[:20], b"never seen"]:  # all words, and one for all that were never seen
            assert sum(p(v, w) for w in [*one, object()]) == pytest.approx(1)
    assert lm.lm_scores(odd.limit(0)).count() == 0


def test_lm_beats_its_base_on_held_out_text(docs):
    held = lm.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_mixture_maximises_likelihood():
    cell = lambda b, i, j: (b * lm.CELLS + i) * lm.CELLS + j
    t = np.array([[cell(3, 30, 20), 60.0, 60 * 50.0, 60 * 2.0], [cell(3, 0, 25), 40.0, 0.0, 40 * 5.0]])
    w = lm.mixture(t)[3]
    like = lambda x: 60 * math.log(x @ [50, 2, 1]) + 40 * math.log(x @ [0, 5, 1])
    assert all(like(w) >= like(np.array(x)) - 1e-3 for x in ([0.5, 0.4, 0.1], [0.6, 0.4, 0], [0.7, 0.2, 0.1]))


# ------------------------------------------------------------ 10


def test_packing_round_trip(spark, odd, docs):
    enc = packing.encoder(WORDS).model
    for d, window in ((odd, 16), (docs, 2048), (docs, 64)):
        want = Counter((k, np.array(enc.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for k, t in texts_of(d))
        got = packing.pack(d, WORDS, window).collect()
        at = defaultdict(list)
        for r in got:
            at[r.sequence_id].append((r.offset, r.length))
        for pieces in at.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end and length > 0
                end += length
            assert end == window or (end < window and end & (end - 1) == 0)
        assert sum(r.length for r in got) == sum(len(b) // 4 * n for (_, b), n in want.items())
        by = defaultdict(list)
        for (k, b), n in want.items():
            by[k, len(b) // 4] += [b] * n
        for r in got:
            assert any(zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for b in by[r.doc_id, r.doc_tokens])
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_encoder_on_odd_words():
    enc, rng = packing.Encoder(WORDS), random.Random(4)
    bits = ["a", "B", "é", "É", "ß", "'", "s", "'ll", ".", "!?", "<|", "endoftext", "|>", "9", "_", "µ", "İ", "ñ", "é", "İ", "日", "x" * 70, "\x85", "\xa0", "²"]
    for _ in range(3000):
        t = " ".join("".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(3))
        assert enc.ids(t.encode()) == np.array(enc.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(3)
    p = packing.Packer(32, 0)
    for k in range(400):
        s = rng.randint(1, 31)
        n = p.levels.copy()

        def after(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + s < 32:
                m[h + s] += 1
            return int((m[1:32] ** 2).sum())

        usable = [h for h in range(0, 33 - s) if h == 0 or n[h]]
        assert after(p.level_for(s)) == min(map(after, usable))
        p.add(k, b"\0\0\0\0" * s)


# ------------------------------------------------------------ the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    text = dict(texts_of(docs))
    bad = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    left = sorted(k for k in text if k not in bad)
    seen: dict = {}
    for k in left:
        seen.setdefault(norm(text[k]), k)
    left = sorted(seen.values())
    left = sorted(set(slow_components(left, [slow_fingerprint(text[k]) for k in left])))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    items = [grams(r.text) for r in table(spark, SF, "benchmark").collect()]
    left = [k for k in left if not any(len(g & grams(text[k])) >= 0.8 * len(g) for g in items if g)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(left)
    enc = packing.encoder(WORDS).model
    total = {k: len(enc.encode(text[k], add_special_tokens=False).ids) + 1 for k in left}
    assert Counter({k: sum(r.length for r in got if r.doc_id == k) for k in left}) == Counter(total)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and shared ids, copies, a benchmark item and extra columns, from end to end: what is left is what brute force leaves."""
    import corpus_pipeline

    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    long = [" ".join(word() for _ in range(90)) for _ in range(5)]
    near = long[0].capitalize()  # another text of the same fingerprint
    item = "In the old town of Lund 25 small boats left the harbour early in the grey morning."
    rows = [(4, long[0]), (2, near), (2, long[1]), (None, long[2]), (None, long[2] + "  "), (None, long[3]), (7, long[4]), (7, long[4]), (9, None), (None, ""), (10, f"{word()} {item.replace('25', '31')} {word()}"), (None, item)]
    for name, frame in {
        "documents": spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "_drop", "lang", "score", "h")}),
        "labels": spark.createDataFrame([(None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}").collect()
    enc = packing.encoder(WORDS).model
    left = [(2, near), (2, long[1]), (None, long[2]), (None, long[3]), (7, long[4]), (9, None)]
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((k, len(enc.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in left)
    for stage, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = table(spark, f"{tmp_path}", "documents")
        assert f(spark, docs, f"{tmp_path}").columns == docs.columns, stage
        assert f(spark, docs.limit(0), f"{tmp_path}").count() == 0, stage


def test_lm_chunk_takes_little_memory():
    import tracemalloc

    from locusframe.llm.common import squeeze
    from locusframe.llm.lm import _Chunk, _distinct

    r = np.random.default_rng(3)
    for keys in (r.integers(0, 50, 400), np.zeros(0, np.int64), np.array([7])):
        pairs, place = _distinct(keys)
        want = np.unique(keys, return_inverse=True)
        assert pairs.tolist() == want[0].tolist() and place.tolist() == want[1].tolist()
    n = 1 << 20
    blobs = squeeze(np.array([n], np.int32)), squeeze(np.ones(1, bool)), squeeze((r.zipf(1.3, n) % 20_000).astype(np.int32)), r.integers(0, 1 << 63, 20_000, np.uint64).tobytes()
    tracemalloc.start()
    try:
        c = _Chunk(*blobs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(c.pair) == n and peak < 42 * n, peak / n
