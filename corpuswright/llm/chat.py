"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned windows. Every
window repeats the system turn and a limited history, both outside the loss, so
each assistant text is a target once. Texts cannot be mistaken for the template:
control strings inside them are escaped, and reading back undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sums
from ..session import materialize

#: New turns of a window start within so many tokens; its history holds so many at most (not above the stride).
STRIDE, HISTORY = 768, 256
#: Tokens of a turn's marks.
MARKS = 4
WORD = r"[^\x20\x09-\x0D]+"

#: The template. An assistant turn is ``<s> text </s>``, any other ``[INST] role``, a line break and ``text [/INST]``.
CONTROL = r"\[/?INST\]|</?s>"
CLOSE = r" (?:\[/INST\]|</s>)\n"


def escape(text: Column) -> Column:
    """One more ``~`` ahead of every control string."""
    return F.regexp_replace(text, f"(~*)({CONTROL})", "~$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"~(~*)({CONTROL})", "$1$2")


_ROLE = (("~", "~0"), ("\n", "~1"), ("[", "~2"), ("<", "~3"))


def escape_role(role: Column) -> Column:
    for plain, code in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def turn_tokens(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + MARKS).cast("long")


def format_windows(conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """``conv_id``, ``window``, ``n_context``, ``text``, ``loss`` of every window.

    ``conversations`` has ``conv_id``, ``turn``, ``role``, ``text``. Null text and
    role are empty, a null conv_id is a conversation of its own, turns of equal
    number are ordered by a hash of role and text, repeated rows are turns of
    their own. A turn longer than the stride stays whole. ``n_context`` turns at
    the front repeat earlier ones; ``loss`` lists ``start`` and ``length`` (code
    points of ``text``) of the assistant texts of the others.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        turn_tokens(F.col("text")).alias("n"),
        F.xxhash64("role", "text").alias("tie"),
    )
    placed = running_sums(rows, ["conv_id"], ["turn", "tie"], {"end": F.col("n")})
    start = F.col("end") - F.col("n")
    system = (F.col("role") == "system") & (start == 0)
    placed = placed.select(
        "conv_id", start.alias("at"), F.floor(start / stride).cast("long").alias("window"), "role", "text", system.alias("system")
    )
    placed = materialize(placed, "placed")
    # a turn can only be history of the next window, as the history is no longer than the stride
    windows = placed.groupBy("conv_id", "window").agg(F.min("at").alias("first"))
    windows = materialize(windows, "windows").withColumnsRenamed({"conv_id": "_conv", "window": "_window"})
    turn = F.struct("at", "role", "text")
    new = placed.select("conv_id", "window", turn.alias("turn"), F.lit(True).alias("new"))
    earlier = placed.where("NOT system").withColumn("window", F.col("window") + 1)
    earlier = earlier.join(windows, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("window") == F.col("_window")))
    earlier = earlier.where(F.col("at") + history >= F.col("first")).select("conv_id", "window", turn.alias("turn"), F.lit(False).alias("new"))
    told = placed.where("system").select("conv_id", F.struct(F.lit(-1).cast("long").alias("at"), "role", "text").alias("turn"))
    told = told.join(windows.where("_window > 0"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    told = told.select("conv_id", F.col("_window").alias("window"), "turn", F.lit(False).alias("new"))
    parts = new.unionByName(earlier).unionByName(told).groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn.at").alias("at"), "turn.role", "turn.text", "new"))).alias("turns"),
        F.sum((~F.col("new")).cast("int")).alias("n_context"),
    )
    answer = lambda t: t["role"] == "assistant"
    head = lambda t: F.when(answer(t), F.lit("<s> ")).otherwise(F.concat(F.lit("[INST] "), escape_role(t["role"]), F.lit("\n")))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(answer(t), F.lit(" </s>\n")).otherwise(F.lit(" [/INST]\n")).alias("close"),
            (answer(t) & t["new"]).alias("target"),
        ),
    )
    parts = parts.select("conv_id", "window", "n_context", pieces.alias("p"))
    size = lambda s: F.length(s["head"]) + F.length(s["body"]) + F.length(s["close"])
    none = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), none.alias("loss")),
        lambda acc, s: F.struct(
            (acc["at"] + size(s)).alias("at"),
            F.when(
                s["target"],
                F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(s["head"])).alias("start"), F.length(s["body"]).alias("length")))),
            ).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    text = F.array_join(F.transform("p", lambda s: F.concat(s["head"], s["body"], s["close"])), "")
    return parts.select("conv_id", "window", F.col("n_context").cast("int").alias("n_context"), text.alias("text"), spans["loss"].alias("loss"))


def read_turns(windows: DataFrame) -> DataFrame:
    """``conv_id``, ``window``, ``turns`` (role and text, repeated ones left out), ``losses`` (texts under the loss), from the text alone."""
    chunks = F.split("text", CLOSE)
    own = F.slice(chunks, F.col("n_context") + 1, F.size(chunks) - 1 - F.col("n_context"))
    cut = lambda c: F.instr(c, "\n")
    turn = lambda c: F.when(
        c.startswith("<s> "),
        F.struct(F.lit("assistant").alias("role"), unescape(F.substring(c, F.lit(5), F.length(c))).alias("text")),
    ).otherwise(
        F.struct(
            unescape_role(F.substring(c, F.lit(8), cut(c) - 8)).alias("role"),
            unescape(F.substring(c, cut(c) + 1, F.length(c))).alias("text"),
        )
    )
    losses = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(own, turn).alias("turns"), losses.alias("losses"))
