"""Multi-party perspective rotation of conversations (op8).

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and all others as named users; only the assistant's words (and the
mark that ends them) are trained on. A conversation comes as rows, one for each turn
and perspective, with the place of the turn in the rendered dialogue, so that no
conversation is ever gathered in one task: places are summed by blocks of turns first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: roles that give rules and never take part
RULES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NOBODY = "unknown"
#: turns that one block of a conversation spans
BLOCK_TURNS = 256


def _plain(text: Column) -> Column:
    """Text that holds neither mark: their first underscore becomes a hyphen."""
    return F.replace(text, F.lit("<|im_"), F.lit("<|im-"))


def _head(speaker: Column, perspective: Column) -> Column:
    """The line above a turn: rules stay rules, the perspective's turns are the assistant's."""
    user = F.concat(F.lit(OPEN + "user name="), _plain(F.translate(speaker, "\n\r", "  ")), F.lit("\n"))
    return F.when(speaker.isin(*RULES), F.concat(F.lit(OPEN), speaker, F.lit("\n"))).when(speaker == perspective, F.lit(OPEN + "assistant\n")).otherwise(user)


def rotate(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn and perspective: ``conv_id, perspective, turn, speaker, rendered, start, mask_start, mask_end, trained``.

    ``rendered`` is the turn's part of the dialogue, from code point ``start`` on;
    [mask_start, mask_end) are the code points to train on, empty where ``trained`` is
    false. A null role is a speaker of the name ``unknown``, a null text is empty, a null
    turn comes first; marks in a text or role lose their underscore to a hyphen, and line
    breaks in a role become spaces, so that no turn can be forged; null ``conv_id``s are one conversation. Turns of one number go by
    speaker and text; repeated rows are repeated turns. A conversation of rules alone,
    or an empty table, gives no row. Other columns are ignored. Only the number of
    repeats of one turn number has to fit a task's sort, which spills.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(NOBODY)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("bigint").alias("block"),
    )
    cast = turns.filter(~F.col("speaker").isin(*RULES)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    # a row for each block and participant, so that a long conversation's turns meet them block by block
    spans = turns.select(F.col("conv_id").alias("in_conv"), F.col("block").alias("in_block")).distinct()
    views = spans.join(cast, F.col("in_conv").eqNullSafe(F.col("of"))).drop("of")
    seen = turns.join(views, F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("block") == F.col("in_block"))).drop("in_conv", "in_block")
    head = _head(F.col("speaker"), F.col("perspective"))
    seen = seen.withColumn("rendered", F.concat(head, _plain(F.col("text")), F.lit(CLOSE + "\n"))).withColumn("body", F.length(head))
    seen = seen.withColumn("size", F.length("rendered").cast("bigint"))
    own = ["conv_id", "perspective"]
    blocks = seen.groupBy(*own, "block").agg(F.sum("size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy(*own).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_view"), F.col("block").alias("b_block"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("size").over(Window.partitionBy(*own, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1))
    placed = seen.withColumn("within", F.coalesce(within, F.lit(0))).join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_view")) & (F.col("block") == F.col("b_block")))
    start = F.col("before") + F.col("within")
    trained = F.col("speaker") == F.col("perspective")
    low = start + F.col("body")
    high = F.when(trained, start + F.col("size") - 1).otherwise(low)  # the end mark is learned, the line feed is not
    return placed.select(*own, "turn", "speaker", "rendered", start.alias("start"), low.alias("mask_start"), high.alias("mask_end"), trained.alias("trained"))
