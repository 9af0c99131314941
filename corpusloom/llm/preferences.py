"""Preference pairs as a shared prompt and two masked completions.

Turns of a chosen and a rejected conversation are gathered by pair in one shuffle. Their
longest common prefix of turns (equal role and text) is rendered once as the prompt; what
follows in either is its completion. A mask lists runs of characters of the completion
in order: (chars, trained). Only what an assistant says, with its end mark, is trained.

Only DataFrame functions are used.

Edge cases: a null role is 'unknown', a null text empty. Turns go by number, then role, then
text, so repeated turn numbers and rows have one order; a null number comes first. A pair
with one side missing has an empty prompt and one empty completion; equal sides give two empty
completions. A null pair_id is a pair of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a turn.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
TRAINED_ROLE = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END + BREAK))), "")


def mask(turns: Column) -> Column:
    def run(chars: Column, trained: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), trained.cast("int").alias("trained"))

    never = F.lit(0)
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                run(F.length(head(t)), never),
                run(F.length(t["text"]) + len(END), t["role"] == TRAINED_ROLE),
                run(F.lit(len(BREAK)), never),
            ),
        )
    )


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    both = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(both).cast("int")


def preference_examples(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both inputs have pair_id, turn, role, text.
    """

    def side(turns: DataFrame, name: str) -> DataFrame:
        role = F.coalesce("role", F.lit("unknown"))
        return turns.select(
            "pair_id", F.lit(name).alias("side"), F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
        )

    def gathered(name: str) -> Column:
        said = F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("said"))))
        return F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)

    pairs = side(chosen, "c").unionByName(side(rejected, "r")).groupBy("pair_id").agg(gathered("c"), gathered("r"))
    n = F.col("n")

    def rest(turns: str) -> Column:
        return F.slice(F.col(turns), n + 1, F.greatest(F.size(turns) - n, F.lit(0)))

    return pairs.withColumn("n", common_turns(F.col("c"), F.col("r"))).select(
        "pair_id",
        n.alias("prompt_turns"),
        rendered(F.slice(F.col("c"), 1, n)).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Rejected sides made from the conversations themselves.

    The last assistant turn of each conversation says what the last assistant turn of its
    neighbour (conv_id with its lowest bit flipped) says; it is left out if the neighbour has none.
    """
    last = (
        conversations.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"), F.lit(True).alias("met"))
    turns = conversations.join(last.select("conv_id", F.col("last.turn").alias("at")), "conv_id", "left").join(other, "conv_id", "left")
    swap = F.coalesce((F.col("role") == TRAINED_ROLE) & (F.col("turn") == F.col("at")), F.lit(False))
    return turns.where(~swap | F.col("met")).select(
        "conv_id", "turn", "role", F.when(swap, F.col("reply")).otherwise(F.col("text")).alias("text")
    )
