"""Preference pairs as training text: one prompt, two masked completions.

Only DataFrame functions. The longest common prefix of the turns of the chosen and the rejected
conversation is rendered once; the other turns of each are its completion, in which the text of
assistant turns is trained on and everything else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: what stands before a role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>) in order of turn, then role, then text.

    A null role or text is empty; equal rows count once; rows without conv_id take no part, and a
    null turn stands first.
    """
    rows = turns.select(
        "conv_id", F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))))


def _spans(turns: Column) -> Column:
    """Places of the assistant texts, with their end mark, in the rendered completion."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + head
        end = start + F.length(t["text"]) + (tail - 1)
        place = F.concat_ws("-", start.cast("string"), end.cast("string"))
        out = F.when(t["role"] == "assistant", F.concat_ws(",", F.when(s["out"] != "", s["out"]), place)).otherwise(s["out"])
        return F.struct((end + 1).alias("at"), out.alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans) of every pair.

    ``chosen`` and ``rejected`` are arrays of turns with ``role`` and ``text``. Turns are common
    while both agree in role and text; ``n_common`` counts them. Spans are the trained places of a
    completion in code points, as "start-end" with commas; the rest is masked.

    A null array is one without turns. Equal conversations have everything in the prompt and two
    empty completions. Rows stay one for one; other columns are not read.
    """
    empty = F.array().cast("array<struct<role: string, text: string>>")

    def turns(name: str) -> Column:
        return F.coalesce(F.transform(name, lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), empty)

    rows = pairs.select(F.col(id_col).alias("pair_id"), turns(chosen).alias("c"), turns(rejected).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    rows = rows.withColumn("n", F.when(differ > 0, differ.cast("int") - 1).otherwise(shorter))
    rows = rows.select("pair_id", "n", "c", F.slice("c", F.col("n") + 1, F.size("c")).alias("cs"), F.slice("r", F.col("n") + 1, F.size("r")).alias("rs"))
    return rows.select(
        "pair_id", F.col("n").cast("bigint").alias("n_common"), _rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(F.col("cs")).alias("chosen"), _rendered(F.col("rs")).alias("rejected"),
        _spans(F.col("cs")).alias("chosen_spans"), _spans(F.col("rs")).alias("rejected_spans"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: each one, and itself with the last reply of its neighbour.

    The neighbour of conv_id 2k is 2k + 1 and the other way round. The rejected conversation ends
    with the last assistant turn of the chosen one, in which the neighbour's last reply stands; where
    either has no assistant turn there is no pair.
    """
    rows = conversations(turns).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turns")
    replies = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    rows = rows.withColumn("reply", F.element_at(F.when(F.size(replies) > 0, replies), -1))
    other = rows.filter("reply is not null").select(F.expr("conv_id ^ 1").alias("conv_id"), F.col("reply").alias("other"))
    last = F.aggregate(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), F.lit(-1), lambda s, x: F.coalesce(x, s))
    joined = rows.filter("reply is not null").join(other, "conv_id").withColumn("last", last)
    worse = F.concat(F.slice("turns", F.lit(1), F.col("last")), F.array(F.struct(
        F.get("turns", F.col("last"))["turn"].alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), worse.alias("rejected"))
