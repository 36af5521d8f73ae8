"""Chat formatting (operator 9): preference pairs with the common prompt rendered once.

A pair has a chosen and a rejected conversation, each a row per turn. Turns are gathered by pair, as both renderings are
single values; the longest common turn prefix becomes the prompt, and the rest of either side its completion. A
completion also comes as segments, one for each turn, with what training may learn from: the turns of `learn_from`.

Defined results: turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one order;
a null text is empty and a null role is rendered as `unknown`, but a null equals only a null; rows without a pair_id or
side belong to no conversation and are left out; a side without turns, or one that the other extends, has an empty
completion; an empty table gives an empty result; other columns are not read, so their names do not matter. A very long
conversation is one value of one row, as its rendering is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written: what stands before the role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(
        F.lit(OPEN),
        F.coalesce(turn["role"], F.lit("unknown")),
        F.lit(MIDDLE),
        F.coalesce(turn["text"], F.lit("")),
        F.lit(CLOSE),
    )


def _segments(turns: Column, learn_from: str) -> Column:
    return F.transform(
        turns,
        lambda t: F.struct(
            _rendered(t).alias("text"), t["role"].eqNullSafe(F.lit(learn_from)).alias("learn")
        ),
    )


def format_preferences(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. A row for each pair: pair_id, n_chosen and n_rejected (turns),
    n_common (turns of the prompt), prompt, chosen and rejected (the completions as text), chosen_segments and
    rejected_segments (arrays of text and learn)."""
    turn = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    side = lambda own: F.sort_array(F.collect_list(F.when(own, turn)))
    pairs = (
        turns.where(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
        .groupBy("pair_id")
        .agg(side(F.col("chosen")).alias("c"), side(~F.col("chosen")).alias("r"))
    )
    alike = F.zip_with(
        "c",
        "r",
        lambda a, b: a.isNotNull()
        & b.isNotNull()
        & a["role"].eqNullSafe(b["role"])
        & a["text"].eqNullSafe(b["text"]),
    )
    first_other = F.array_position(alike, F.lit(False))
    pairs = pairs.withColumn(
        "n_common", F.when(first_other > 0, first_other - 1).otherwise(F.size("c").cast("long"))
    )
    after = lambda x: F.slice(x, (F.col("n_common") + 1).cast("int"), F.size(x))
    text = lambda x: F.array_join(F.transform(x, lambda s: s["text"]), "")
    return (
        pairs.select(
            "pair_id",
            F.size("c").cast("long").alias("n_chosen"),
            F.size("r").cast("long").alias("n_rejected"),
            "n_common",
            F.array_join(F.transform(F.slice("c", 1, F.col("n_common").cast("int")), _rendered), "").alias("prompt"),
            _segments(after(F.col("c")), learn_from).alias("chosen_segments"),
            _segments(after(F.col("r")), learn_from).alias("rejected_segments"),
        )
        .withColumn("chosen", text(F.col("chosen_segments")))
        .withColumn("rejected", text(F.col("rejected_segments")))
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs for a table that names none: conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    own = F.col("conv_id").cast("bigint")
    return conversations.select(
        F.shiftright(own, 1).alias("pair_id"), (F.pmod(own, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"
    )
