"""Chat formatting (operator 1): conversations to one training string each, in Spark expressions only.

Template, per message (a run of adjacent turns of one role)::

    <|im_start|>ROLE\\nTEXT[<|im_turn|>TEXT...]<|im_end|>\\n

A control string always begins with ``<|``. Inside roles and texts, ``<`` followed by any
number of backslashes and ``|`` gets one backslash more, so that ``<|`` never occurs in
them; taking one backslash away again restores every text. A line feed in a role is
written as ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN, NL = "<|im_start|>", "<|im_end|>", "<|im_turn|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NL))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NL), F.lit("\n")))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_mask, loss_spans, n_messages)``, one row per conversation.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered by
    (turn, role, text), so ties and repeated rows have a defined place; all rows stay.
    Null text and null role count as empty; a null turn comes first; rows of null
    conv_id form one conversation. An empty table gives an empty result.
    loss_mask: for each turn in order, whether the loss is taken on its text. loss_spans: the
    same as places, an array of (start, length), 0-based code points in ``formatted``, of the
    escaped texts.

    A conversation is one output string, so its turns meet in one row by definition;
    everything inside a row is linear in its turns but the list of spans, which is computed
    only if it is selected.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # first turn of each message, and the messages as slices between two of them
    heads = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    convs = convs.withColumn("heads", heads)
    ends = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(F.size("ts") + 1))
    merged = F.zip_with("heads", ends, lambda a, b: F.slice("ts", a, b - a))
    messages = F.transform(
        merged,
        lambda m: F.struct(
            F.element_at(m, 1)["role"].alias("role"),
            F.concat(F.lit(START), _role_out(F.element_at(m, 1)["role"]), F.lit("\n")).alias("head"),
            F.transform(m, lambda t: escape(t["text"])).alias("bodies"),
        ),
    )
    convs = convs.select("conv_id", messages.alias("ms"))
    formatted = F.array_join(
        F.transform("ms", lambda m: F.concat(m["head"], F.array_join(m["bodies"], TURN), F.lit(END + "\n"))), ""
    )
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def body(acc: Column, text: Column, wanted: Column) -> Column:
        n = F.char_length(text).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n + len(TURN)).alias("at"), F.when(wanted, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def message(acc: Column, m: Column) -> Column:
        start = F.struct((acc["at"] + F.char_length(m["head"])).alias("at"), acc["spans"].alias("spans"))
        done = F.aggregate(m["bodies"], start, lambda x, t: body(x, t, m["role"] == loss_role))
        return F.struct((done["at"] - len(TURN) + len(END) + 1).alias("at"), done["spans"].alias("spans"))

    spans = F.aggregate("ms", step, message)["spans"]
    mask = F.flatten(F.transform("ms", lambda m: F.transform(m["bodies"], lambda _: m["role"] == loss_role)))
    return convs.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"), spans.alias("loss_spans"), F.size("ms").cast("long").alias("n_messages"))


def read_chat(formatted: Column) -> Column:
    """The turns in a formatted string: array of (role, text), exactly as they went in."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda m: m != "")

    def turns(m: Column) -> Column:
        cut = F.locate("\n", m)  # 1-based
        role = F.substring(m, F.lit(len(START) + 1), cut - 1 - len(START))
        body = F.substring(m, cut + 1, F.char_length(m))
        return F.transform(F.split(body, r"<\|im_turn\|>"), lambda t: F.struct(_role_in(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output of :func:`format_chat`, by hashes: the turns, and the texts under the loss mask."""
    read = formatted.select("conv_id", "formatted", "n_messages", "loss_mask", read_chat(F.col("formatted")).alias("ts"))
    under = F.zip_with("ts", "loss_mask", lambda t, on: F.when(on, t["text"]).otherwise(F.lit("")))
    return read.withColumn("loss", F.array_join(under, "")).select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )
