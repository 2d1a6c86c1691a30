"""Chat formatting by perspective rotation, in DataFrame operations.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and everyone else as a user with a name; turns of a
context role (``system``) stay what they are and never become the assistant.
The loss mask covers what the assistant of the perspective says, with its end
marker.

A rendering is given as its segments, one row per turn, with the characters that
each takes in the whole: concatenated by ``seq`` they are the rendering
(``assemble`` does that for conversations small enough for one row).

Spark side: a conversation may be of any length.  Positions and character
offsets are running sums in two levels: inside runs of ``CHUNK`` turn numbers,
cut again at a sampled one of every ``CHUNK_ROWS`` turns (so turns of one number,
or without any, make many runs as well), and over the totals of the runs; no task
needs a whole conversation.
Participants are a distinct set, combined on the map side.  The result has
turns x participants rows by definition.  No Python, no driver data.

Defined cases: a repeated turn (same conversation, number, role and text) counts
once; turns of one number are ordered by role, then text; a null number comes
first; a null role is the participant ``unknown``, a null text is empty; rows
without a conversation id are one conversation; a conversation of context roles
only gives no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridseries.llm.common import quoted

CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 256
CHUNK_ROWS = 1 << 14


def _runs(said: DataFrame) -> DataFrame:
    """``said`` with chunk, the bounded run of its conversation's order that a turn belongs to."""
    said = said.withColumn("run", F.floor(F.col("turn") / CHUNK))
    turn = F.struct("turn", "role", "text")
    marks = said.filter(F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(CHUNK_ROWS)) == 0) \
        .groupBy(F.col("conv_id").alias("mc"), F.col("run").alias("mr")).agg(F.collect_list(turn).alias("marks"))
    return said.join(marks, F.col("conv_id").eqNullSafe(F.col("mc")) & F.col("run").eqNullSafe(F.col("mr")), "left") \
        .withColumn("chunk", F.struct("run", F.when(F.col("marks").isNull(), 0).otherwise(F.size(F.filter("marks", lambda m: m <= turn))).alias("nth"))) \
        .drop("mc", "mr", "marks", "run")


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, segment, char_start, char_end, mask_start, mask_end.

    mask_start and mask_end are null for turns that are not the perspective's own.
    """
    said = turns.select(quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"),
                        F.coalesce(quoted(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"),
                        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    speakers = said.filter(~F.col("role").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    rows = _runs(said).join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c") \
        .withColumn("own", F.col("role") == F.col("perspective")) \
        .withColumn("speaker", F.when(F.col("own"), F.lit("assistant")).when(F.col("role").isin(*context_roles), F.col("role"))
                    .otherwise(F.concat(F.lit("user name="), F.col("role")))) \
        .withColumn("head", F.concat(F.lit(BEGIN), F.col("speaker"), F.lit("\n"))) \
        .withColumn("segment", F.concat("head", "text", F.lit(END))) \
        .withColumn("size", F.length("segment").cast("long"))
    inside = W.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "role", "text")
    placed = rows.withColumn("nth", F.row_number().over(inside) - 1) \
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "perspective", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")) \
        .select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"),
                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("chunk").eqNullSafe(F.col("k"))
    end = F.col("s0") + F.col("upto")
    start = end - F.col("size")
    return placed.join(totals, same).select(
        "conv_id", "perspective", (F.col("n0") + F.col("nth")).cast("long").alias("seq"), "turn", "speaker", "segment",
        start.alias("char_start"), end.alias("char_end"),
        F.when(F.col("own"), start + F.length("head")).alias("mask_start"),
        F.when(F.col("own"), end - 1).alias("mask_end"))


def assemble(parts: DataFrame) -> DataFrame:
    """conv_id, perspective, rendering, masks: one row per rendering, for conversations that fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    return parts.groupBy("conv_id", "perspective").agg(ordered.alias("s")).select(
        "conv_id", "perspective", F.array_join("s.segment", "").alias("rendering"),
        F.expr("transform(filter(s, x -> x.mask_start IS NOT NULL), x -> struct(x.mask_start AS start, x.mask_end AS end))").alias("masks"))
