"""Multi-party chat formatting, on DataFrame functions: each participant in
turn speaks as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are numbered together.
BLOCK = 4096
SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>\n"


def _speaker(role: Column) -> Column:
    return F.when(F.coalesce(F.trim(role), F.lit("")) == "", UNNAMED).otherwise(F.trim(role))


def _content(text: Column) -> Column:
    """Text that can't be read as a mark of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(speaker: Column, perspective: Column) -> Column:
    return (F.when(speaker == perspective, "<|assistant|>\n").when(speaker == SYSTEM, "<|system|>\n")
            .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, turn, speaker, segment, seg_start, seg_end,
    mask_start, mask_end): the dialogue as each participant would have
    answered it, one row per segment.

    Joined by seg_start, the segments of a perspective are the rendered
    dialogue: that participant's turns as the assistant, all others as named
    users, system turns as such. Offsets count code points of the whole
    rendering; the mask spans what is trained on, an assistant's words and the
    mark that ends them, and is null elsewhere.

    Every speaker but the system is a participant; a null or blank role is
    the speaker "unknown"; a conversation of system turns alone has no
    perspective. Turns go by number (null first), then speaker, then text;
    equal rows are separate turns. A null text is an empty one; rows without
    a conv_id are one conversation; other columns are not read.

    A conversation is read in blocks of turns. Lengths are summed per block
    first, so that a block knows its offset and no task holds a whole one.
    """
    content = _content(F.col("text"))
    slim = turns.select(
        F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        _speaker(F.col("role")).alias("speaker"), content.alias("content"))
    slim = slim.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    sums = slim.groupBy("conv", "block", "speaker").agg(
        F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars"))
    people = sums.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    marks = F.char_length(_head(F.col("speaker"), F.col("perspective"))) + len(END)
    lengths = sums.join(people, "conv").groupBy("conv", "perspective", "block").agg(
        F.sum(F.col("chars") + F.col("n") * marks).alias("length"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("conv", "perspective", "block", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
    rows = slim.join(starts, ["conv", "block"])
    rows = rows.withColumn("head", _head(F.col("speaker"), F.col("perspective")))
    rows = rows.withColumn("size", F.char_length("head") + F.char_length("content") + len(END))
    within = Window.partitionBy("conv", "block", "perspective").orderBy("turn", "speaker", "content")
    placed = rows.withColumn("seg_end", F.col("offset") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.col("speaker") == F.col("perspective")
    start = F.col("seg_end") - F.col("size")
    return placed.select(
        "conv.conv_id", "perspective", "turn", "speaker", F.concat("head", "content", F.lit(END)).alias("segment"),
        start.alias("seg_start"), "seg_end", F.when(own, start + F.char_length("head")).alias("mask_start"),
        F.when(own, F.col("seg_end") - 1).alias("mask_end"))


def rotate_sql(table: str = "conversations") -> str:
    end = "'<|end|>' || chr(10)"
    return f"""WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN '{UNNAMED}' ELSE trim(role) END speaker,
  replace(coalesce(text, ''), '<|', '< |') content FROM {table}),
p AS (SELECT DISTINCT conv_id, speaker perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = '{SYSTEM}' THEN '<|system|>'
  ELSE '<|user name=' || speaker || '|>' END || chr(10) head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || content || {end} segment, CAST(sum(length(head || content || {end})) OVER (PARTITION BY conv_id, perspective
  ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING) AS BIGINT) seg_end FROM r)
SELECT conv_id, perspective, turn, speaker, segment, seg_end - length(segment) seg_start, seg_end,
  CASE WHEN speaker = perspective THEN seg_end - length(segment) + length(head) END mask_start,
  CASE WHEN speaker = perspective THEN seg_end - 1 END mask_end FROM s"""
