"""Chat formatting by perspective rotation.

Every participant of a dialogue is the assistant once: the dialogue is rendered with that
speaker's turns as ``assistant`` and all others as ``user`` with their name; system turns stay
system turns and are nobody's perspective. The result has one row per (conversation,
perspective, turn), so a dialogue of any length is spread over tasks; concatenating ``chunk``
in turn order gives the training text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
UNKNOWN = "unknown"


def _plain(text: Column) -> Column:
    """Content cannot open a marker of its own."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(OPEN), F.lit("< |"))


def rotated(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    system: tuple[str, ...] = ("system",),
) -> DataFrame:
    """``(conv_col, perspective, turn_col, role, name, chunk, mask_start, mask_end)``.

    ``chunk`` is ``<|role|>name``, a line break, the content, ``<|end|>`` and a line break;
    characters ``[mask_start, mask_end)`` of it are learned: content and end mark of the
    perspective's own turns, nothing (an empty range) elsewhere. A null speaker is a user
    named "unknown" and no participant, a null text an empty turn, a null conversation id one
    conversation, repeated turns are rendered again; turns of equal number are in order of
    speaker and content. A conversation without participants has no rows.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), _plain(F.col(text_col)).alias("content"))
    members = rows.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system)).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    joined = rows.join(members, F.col("conv").eqNullSafe(F.col("c")))
    is_system = F.coalesce(F.col("speaker").isin(*system), F.lit(False))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(is_system, "system").when(own, "assistant").otherwise("user")
    name = F.when(is_system | own, "").otherwise(_plain(F.coalesce(F.col("speaker"), F.lit(UNKNOWN))))
    shown = joined.select("conv", "perspective", "turn", role.alias("role"), name.alias("name"), "content", own.alias("own"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(CLOSE), F.col("name"), F.lit("\n"))
    chunk = F.concat(head, F.col("content"), F.lit(END + "\n"))
    start = F.when(F.col("own"), F.length(head)).otherwise(0).cast("long")
    end = F.when(F.col("own"), F.length(chunk) - 1).otherwise(0).cast("long")
    return shown.select(F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "role", "name",
                        chunk.alias("chunk"), start.alias("mask_start"), end.alias("mask_end"))
