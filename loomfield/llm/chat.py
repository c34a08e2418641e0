"""Preference formatting of paired conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once, as the prompt; what follows in
each is its completion. A completion's mask says which of its characters are
trained on: the text and end mark of assistant turns, as spans [start, end) of
code points. Turns are rendered as ``<|role|>``, a line end, the text,
``<|end|>`` and a line end.

Turns carry the rendered length of all turns before them, a running sum made
where their rows are ordered, so prompts, completions and masks are cut out in
time linear in a conversation's length. A conversation is one row of the result,
and is gathered in one row once.

Defined cases: null text or role is empty. Turns are ordered by turn number,
then role and text, so repeated turn numbers have an order; null turn numbers
come first, and repeated rows are turns of their own. Equal conversations give
the whole as prompt and empty completions. A side that is missing has no turns,
so the prompt is empty. Very long texts are rendered whole. Rows without a
conv_id belong to no conversation. Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"
NO_TURNS = "array<struct<turn:bigint,role:string,text:string,at:bigint>>"


def _shown(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END + "\n"))


def _length(role: Column, text: Column) -> Column:
    """Characters of a rendered turn."""
    return (F.length(role) + F.length(text) + len("<||>\n") + len(END) + 1).cast("long")


def turns_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, turns array<struct<turn,role,text,at>>), one row a conversation; one exchange serves the running sum and the grouping."""
    r = rows.select(key, F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy(key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = r.withColumn("at", F.coalesce(F.sum(_length(F.col("role"), F.col("text"))).over(before), F.lit(0).cast("long")))
    return placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("turns"))


def with_lengths(turns: Column) -> Column:
    """Turns of other origin (turn, role, text) with ``at`` filled in."""
    start = F.struct(F.array().cast(NO_TURNS).alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a, t):
        one = F.struct(t["turn"].cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text"), a["at"].alias("at"))
        return F.struct(F.concat(a["out"], F.array(one)).alias("out"), (a["at"] + _length(t["role"], t["text"])).alias("at"))

    return F.aggregate(F.coalesce(turns, F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), start, step)["out"]


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def loss_spans(turns: Column) -> Column:
    """Assistant spans of the rendered turns, as array<struct<start,end>>."""
    base = F.get(turns, F.lit(0))["at"]

    def one(t):
        start = (t["at"] - base + F.length(t["role"]) + len("<||>\n")).cast("int")
        return F.struct(start.alias("start"), (start + F.length(t["text"]) + len(END)).alias("end"))

    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), one)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"]))
    return F.get(unlike, F.lit(0))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of turns, with lengths or without) as prompt, completions and their masks."""
    known = lambda c: "at" in [f.name for f in pairs.schema[c].dataType.elementType.fields]
    side = lambda c: F.coalesce(c, F.array().cast(NO_TURNS)) if known(c) else with_lengths(F.col(c))
    p = pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r")).withColumn("k", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("k") + 1, F.size(x))  # noqa: E731  (from k + 1, at most all)
    p = p.withColumn("cr", rest("c")).withColumn("rr", rest("r"))
    return p.select(
        "pair_id",
        F.col("k").cast("int").alias("prompt_turns"),
        render(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        render(F.col("cr")).alias("chosen"),
        render(F.col("rr")).alias("rejected"),
        loss_spans(F.col("cr")).alias("chosen_spans"),
        loss_spans(F.col("rr")).alias("rejected_spans"),
    )


def branched_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) from plain conversations, a row a conversation.

    Chosen runs to the last assistant turn. Rejected leaves it at one of its assistant turns, number (conv_id / 2) modulo their
    count, and goes on as the partner does from the assistant turn so numbered; the partner's id differs in the lowest bit. How
    long the two agree is for ``common_prefix`` to find: the partner may say the same. Without a partner that answers, the
    rejected answer is empty. A conversation without an assistant turn is its own rejected side: all prompt.
    """
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    t = turns_of(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"), "conv_id").withColumn("places", places)
    number = F.get("places", F.pmod(F.shiftright("conv_id", 1), F.nullif(F.size("places"), F.lit(0))).cast("int"))
    t = t.select("conv_id", F.when(F.size("places") > 0, F.slice("turns", F.lit(1), F.element_at("places", -1) + 1)).otherwise(F.col("turns")).alias("chosen"), number.alias("branch"))
    # the partner goes on from its own branch: conv_id / 2 is the same for both
    other = t.where("branch is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("for_id"), F.slice("chosen", F.col("branch") + 1, F.size("chosen")).alias("goes_on"))
    both = t.join(other, F.col("conv_id") == F.col("for_id"), "left")
    here = F.get("chosen", F.col("branch"))
    silent = F.array(F.struct(here["turn"].alias("turn"), F.lit("assistant").alias("role"), F.lit("").alias("text"), here["at"].alias("at")))
    shifted = F.transform("goes_on", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), (x["at"] - F.get("goes_on", F.lit(0))["at"] + here["at"]).alias("at")))
    left = F.concat(F.slice("chosen", F.lit(1), F.col("branch")), F.coalesce(shifted, silent))
    return both.select(F.col("conv_id").alias("pair_id"), "chosen", F.when(F.col("branch").isNull(), F.col("chosen")).otherwise(left).alias("rejected"))


def spans_text(spans: Column) -> Column:
    """``start-end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def preference_examples(conversations: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, and the masks as text."""
    return format_pairs(branched_pairs(conversations)).withColumn("chosen_spans", spans_text(F.col("chosen_spans"))).withColumn("rejected_spans", spans_text(F.col("rejected_spans")))
