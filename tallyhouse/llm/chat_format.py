"""Chat formatting by perspective rotation, with DataFrame functions only.

For every speaker of a conversation, the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask marks the assistant's content (with its end
mark), the only part a model is trained on.  Rows of the system role are kept in every
rendering and are no speaker of their own.

Where a speaker's content stands in their own rendering is told by running sums along the
dialogue: what all heads and bodies before it take with everybody as a user, and how much shorter
the speaker's own earlier heads are.  So one shuffle by conversation serves the sums, the
gathering of turns and all renderings.

Nulls, empties and ties: a null role is the speaker ``unknown``, a null text is empty, a null
turn sorts before all others; equal turns are ordered by role and text; repeated rows are
repeated turns.  A row with a null conversation id belongs with no other row and is a dialogue
of its own.  A conversation without speakers has no rendering, an empty table gives no rows.
Markers that stand inside a text are content and stay as they are; the mask, not a search for
markers, says what is trained on.

A dialogue of any length is one row by default.  For dialogues that a task cannot hold,
``turns_per_block`` gives several rows: a block has all system turns of the dialogue, then so many
of the other turns in order, and is rendered for each of its own speakers; nothing earlier is
repeated in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _in_blocks(rows: DataFrame, size: int, system_role: str) -> DataFrame:
    """Rows with their block; system rows once in every block of their conversation."""
    along = Window.partitionBy("conv_id").orderBy("is_system", "turn", "role", "text")
    number = F.row_number().over(along) - 1
    rows = rows.withColumn("is_system", F.col("role") == system_role)
    rows = rows.withColumn("others", F.sum((~F.col("is_system")).cast("long")).over(Window.partitionBy("conv_id"))).withColumn("number", number)
    last = F.greatest(F.ceil(F.col("others") / size).cast("long") - 1, F.lit(0).cast("long"))
    blocks = F.when(F.col("is_system"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(F.floor(F.col("number") / size).cast("long")))
    return rows.select("conv_id", F.explode(blocks).alias("block"), "turn", "role", "text", F.when(F.col("is_system"), 0).otherwise(1).alias("rank"))


def rotate_perspectives(turns: DataFrame, system_role: str = "system", turns_per_block: int | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to one row per conversation (or block) and speaker.

    Columns: conv_id, participant, block (0, or the block's number), n_turns, text, mask (array of
    start and end, in characters of ``text``, end exclusive).
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    together = rows.where(F.col("conv_id").isNotNull())
    if turns_per_block:
        together = _in_blocks(together, turns_per_block, system_role)
    else:
        together = together.select("conv_id", F.lit(0).cast("long").alias("block"), "turn", "role", "text", F.lit(0).alias("rank"))

    def head(role: Column, own: bool) -> Column:
        said = F.lit("assistant") if own else F.when(role == system_role, "system").otherwise(F.concat(F.lit("user name="), role))
        return F.concat(F.lit(START), said, F.lit("\n"))

    key, order = ["conv_id", "block"], ["rank", "turn", "role", "text"]
    size = F.length(head(F.col("role"), False)) + F.length("text") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = F.row_number().over(Window.partitionBy(*key, "role").orderBy(*order))  # this turn and the speaker's earlier ones have the shorter head
    start = before + F.length(head(F.col("role"), False)) + mine * (F.length(head(F.col("role"), True)) - F.length(head(F.col("role"), False)))
    placed = together.withColumn("start", start.cast("int"))
    one = F.struct("rank", "turn", "role", "text", "start")
    dialogues = placed.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull()).select(
        "conv_id",
        F.lit(0).cast("long").alias("block"),
        F.array(F.struct(F.lit(0).alias("rank"), "turn", "role", "text", F.length(head(F.col("role"), True)).alias("start"))).alias("turns"),
    )
    speakers = F.array_distinct(F.transform(F.filter("turns", lambda t: t["role"] != system_role), lambda t: t["role"]))
    each = dialogues.unionByName(alone).select("*", F.explode(speakers).alias("participant"))
    me = F.col("participant")
    text = F.transform("turns", lambda t: F.concat(F.when(t["role"] == me, head(t["role"], True)).otherwise(head(t["role"], False)), t["text"], F.lit(END)))
    mask = F.transform(
        F.filter("turns", lambda t: t["role"] == me),
        lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["text"]) + len(END)).cast("int").alias("end")),
    )
    return each.select("conv_id", "participant", "block", F.size("turns").cast("long").alias("n_turns"), F.array_join(text, "").alias("text"), mask.alias("mask"))
