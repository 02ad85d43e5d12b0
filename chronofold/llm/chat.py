"""Chat formatting (operator 5), DataFrame functions only.

Budgeted windows: prefix sums of the turns' tokens choose turn-aligned spans; each window holds the system turn, a limited history
repeated from the span before, and its span.  Its loss mask covers the texts of the assistant turns of its own span, so a target is
learnt once and masked wherever it is repeated.

A turn is written ``<|turn|>`` role, line feed, text, ``<|end|>``, line feed.  Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``; a line feed in a role becomes ``<\\-``.  No role or text can then hold a control string, and ``unescape`` gives back what
was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import put

TURN, END = "<|turn|>", "<|end|>\n"
#: What counts as a token against the budget; ``MARKS`` are those of a turn's control strings.
TOKEN, MARKS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", 4
LOSS = "array<struct<start:int,stop:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("<\\-"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def conversations(df: DataFrame, *, budget: int = 1024, history_tokens: int = 128, history_turns: int = 4) -> DataFrame:
    """One row per conversation: conv_id and its windows, in order.

    ``df`` has conv_id, turn, role and text, a row a turn; other columns are left out.  Turns are ordered by turn, role and text, nulls
    first and taken as empty; repeated rows stay repeated; turns without a conv_id form one conversation.  A window is a struct of text,
    loss (code point spans), repeated (how many of its turns were in a window before) and tokens.  A window is within ``budget`` unless
    its span is one turn that alone is not; history is the last turns before the span, at most ``history_turns`` and
    ``history_tokens``.  A conversation is one row and one task's work, whatever its length.
    """
    turns = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + F.lit(MARKS)).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("i", F.row_number().over(order)).withColumn("sum", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    turns = turns.select("conv_id", F.struct("i", "role", F.concat(F.replace(escape(F.col("role")), F.lit("\n"), F.lit("<\\-")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), "tokens", "sum").alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda a, b: a["i"] - b["i"]).alias("t"))
    t = F.col("t")
    system = F.element_at(t, 1)["role"] == "system"
    first = F.when(system, 2).otherwise(1)
    held = F.when(system, F.element_at(t, 1)["tokens"]).otherwise(F.lit(0).cast("long"))
    whole = whole.withColumn("first", first).withColumn("room", F.greatest(F.lit(budget - history_tokens) - held, F.lit(1)).cast("long")).withColumn("held", held)

    def step(s: Column, x: Column) -> Column:
        full = (x["i"] > F.element_at(s["starts"], -1)) & (x["sum"] - s["base"] > F.col("room"))
        return F.struct(F.when(full, F.array_append(s["starts"], x["i"])).otherwise(s["starts"]).alias("starts"), F.when(full, x["sum"] - x["tokens"]).otherwise(s["base"]).alias("base"))

    whole = whole.withColumn("starts", F.aggregate(F.slice(t, F.col("first"), F.size(t)), F.struct(F.array(F.col("first")).alias("starts"), F.col("held").alias("base")), step)["starts"])

    def window(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.try_element_at("starts", k + 2), F.size(t) + 1)
        low = F.greatest(F.col("first"), start - F.lit(history_turns))
        before = F.slice(t, low, F.greatest(start - low, F.lit(0)))
        recent = F.filter(before, lambda x: F.element_at(before, -1)["sum"] - x["sum"] + x["tokens"] <= F.lit(history_tokens))
        lead = F.slice(t, 1, F.col("first") - 1)
        old = F.when(k == 0, 0).otherwise(F.col("first") - 1 + F.size(recent))
        return F.struct(F.concat(lead, recent, F.slice(t, start, stop - start)).alias("turns"), old.alias("repeated"))

    whole = whole.select("conv_id", F.transform("starts", window).alias("windows"))

    def mask(w: Column) -> Column:
        def place(s: Column, x: Column) -> Column:
            begin = s["at"] + F.length(F.lit(TURN)) + F.length(x["head"])
            stop = begin + F.length(x["body"])
            target = (s["k"] >= w["repeated"]) & (x["role"] == "assistant")
            span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
            return F.struct((stop + F.length(F.lit(END))).alias("at"), (s["k"] + 1).alias("k"), F.when(target, F.concat(s["loss"], span)).otherwise(s["loss"]).alias("loss"))

        return F.aggregate(w["turns"], F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(LOSS).alias("loss")), place)["loss"]

    def write(w: Column) -> Column:
        text = F.array_join(F.transform(w["turns"], lambda x: F.concat(F.lit(TURN), x["head"], x["body"], F.lit(END))), "")
        tokens = F.aggregate(w["turns"], F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
        return F.struct(text.alias("text"), mask(w).alias("loss"), w["repeated"].alias("repeated"), tokens.alias("tokens"))

    return whole.select("conv_id", F.transform("windows", write).alias("windows"))


def windows(df: DataFrame, **settings) -> DataFrame:
    """The windows of ``conversations``, a row each: conv_id, window (from 0), text, loss, repeated, tokens."""
    return conversations(df, **settings).select("conv_id", F.posexplode("windows").alias("window", "w")).select("conv_id", "window", "w.*")


def turns_of(text: Column) -> Column:
    """The turns written in a window's text: structs of role and text, as they were before escaping."""

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        at = F.length(role) + 2
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, at, F.length(x) - F.lit(len(END) - 1) - at)).alias("text"))

    return F.transform(F.slice(F.split(text, r"<\|turn\|>"), F.lit(2), F.length(text) + 1), one)


def read_back(df: DataFrame, **settings) -> DataFrame:
    """Per conversation what its windows say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Turns are those that no earlier window of the conversation had; a turn adds role, line feed, text, line feed to the digest.
    """
    each = conversations(df, **settings)
    turns = F.flatten(F.transform("windows", lambda w: F.slice(turns_of(w["text"]), w["repeated"] + 1, F.length(w["text"]) + 1)))
    loss = F.array_join(F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda m: unescape(F.substring(w["text"], m["start"] + 1, m["stop"] - m["start"]))))), "")
    each = each.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.length(w["text"])).alias("formatted_chars"), F.size("windows").cast("long").alias("n_windows"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return put(
        each.select("conv_id", "turns", "loss", "formatted_chars", "n_windows"),
        n_turns=F.size("turns").cast("long"), turns_sha256=F.sha2(said, 256), loss_chars=F.length("loss").cast("long"), loss_sha256=F.sha2("loss", 256),
    ).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")
