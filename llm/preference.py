"""Preference formatting for chats (operator 3), in DataFrame functions.

A pair holds a chosen and a rejected conversation as arrays of turns. Their
longest common turn prefix is rendered once as the prompt; what follows in each is
rendered as its completion, with a mask of runs that tells trainable text (what
the assistant says, and the mark that ends it) from the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS = "array<struct<role:string,text:string>>"
#: Marks of the chat format; where a text holds the start of one, a blank breaks it.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Consecutive numbers of conversations among which partners are sought.
BLOCK = 1_000


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _clean(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_clean(turn["text"]), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask_runs(turns: Column) -> Column:
    """Runs ``length:0`` and ``length:1`` in code points, two for each turn."""
    flag = lambda t: F.when(t["role"] == TRAINED_ROLE, F.lit(":1")).otherwise(F.lit(":0"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_header(t)).cast("string"), F.lit(":0 "), F.length(_body(t)).cast("string"), flag(t))), " ")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns in which both conversations agree in role and text."""
    differs = F.array_position(F.zip_with(chosen, rejected, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(chosen), F.size(rejected))).cast("int")


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask and usable of every pair.

    usable: both completions hold a trained turn and differ. Defined cases: a null conversation has no turns; equal
    conversations share all turns and have empty completions; a null turn text is empty, a null role is an empty
    one; a repeated pair is formatted again; an empty table gives an empty result. Other columns are ignored.
    """
    none = F.array().cast(TURNS)
    turns = pairs.select(
        F.col(id_col).alias("pair_id"), F.coalesce(F.col(chosen_col).cast(TURNS), none).alias("a"), F.coalesce(F.col(rejected_col).cast(TURNS), none).alias("b")
    ).withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = turns.select(
        "pair_id", "n", F.slice("a", 1, F.col("n")).alias("prefix"),
        F.slice("a", F.col("n") + 1, F.size("a")).alias("a"), F.slice("b", F.col("n") + 1, F.size("b")).alias("b"),
    )
    trained = lambda c: F.coalesce(F.exists(c, lambda t: t["role"].eqNullSafe(TRAINED_ROLE)), F.lit(False))
    return rest.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.col("prefix")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"),
        mask_runs(F.col("a")).alias("chosen_mask"),
        rendered(F.col("b")).alias("rejected"),
        mask_runs(F.col("b")).alias("rejected_mask"),
        (trained("a") & trained("b") & (F.col("a") != F.col("b"))).alias("usable"),
    )


def pairs_of_conversations(conversations: DataFrame) -> DataFrame:
    """A pair (pair_id, chosen, rejected) for each conversation of a table of turns (conv_id, turn, role, text), all turns kept.

    Partners are sought among BLOCK consecutive numbers. The next conversation there that opens with the same turn is rejected
    as it is: how far both agree shows only when they are compared. Where none does, rejected is the conversation itself
    with its last assistant's turn taken from the next one, or that one as it is if either has no such turn. The last of a
    block has nothing to be held against: rejected is null. Defined cases: turns go by number, then role, then text, so that
    repeated ones stay in a fixed order; turns without a conv_id belong to none and are left out; an empty table gives no
    pair. A conversation is one row, so its length bounds a group; a block bounds what is sorted together, however many
    conversations open alike.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", "role", "text").alias("t"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("ts"))
    spoken = F.filter(F.transform("ts", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1)), lambda i: i.isNotNull())
    whole = whole.withColumn("last", F.array_max(spoken))
    openings = listed.select("conv_id", F.floor(F.col("conv_id") / BLOCK).alias("block"), F.col("ts")[0]["role"].alias("role"), F.col("ts")[0]["text"].alias("text"))
    alike = Window.partitionBy("block", "role", "text").orderBy("conv_id")
    partners = openings.select("conv_id", F.lead("conv_id").over(alike).alias("alike"), F.lead("conv_id").over(Window.partitionBy("block").orderBy("conv_id")).alias("next"))
    other = whole.select(F.col("conv_id").alias("partner"), F.col("ts").alias("others"), F.col("last").alias("others_last"))
    met = whole.join(partners.select("conv_id", "alike", F.coalesce("alike", "next").alias("partner")), "conv_id").join(other, "partner", "left")
    instead = F.transform("ts", lambda t, i: F.when(i + 1 == F.col("last"), F.element_at("others", F.col("others_last"))).otherwise(t))
    takes_turn = F.col("alike").isNull() & F.col("last").isNotNull() & F.col("others_last").isNotNull()
    return met.select(F.col("conv_id").alias("pair_id"), F.col("ts").alias("chosen"), F.when(takes_turn, instead).otherwise(F.col("others")).alias("rejected"))
