"""Dialogues told once from the side of every participant.

Rows are turns (conv_id, turn, role, text). For each participant of a conversation the whole dialogue is
rendered with that speaker as the assistant, the others as named users and context speakers (system) as
they are; the mask marks the characters that the assistant says, its closing mark included.

Turns go by turn number (nulls last), then role and text; null roles are written as users without a
name and are nobody's side; null texts are empty. Names lose characters outside letters, digits, ``_``
and ``-``; marks inside a text are broken up by a backslash, so that a text can't open a turn. Rows
without a conv_id make up one conversation. A conversation without participants gives no row.

A dialogue of more than ``PART_TURNS`` turns comes in parts, numbered from 0, which are rendered one
after another; so no row and no group grows without bound. Ranks are taken inside ranges of the sorted
turns and shifted by the counts of the ranges before. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import materialize

PART_TURNS = 512
CONTEXT = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, rank): turns with their rank in the conversation, from 0."""
    sorted_by = ["conv_id", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first()]
    # Tied turns go by text; its beginning is enough to deal out the ranges in that order.
    sorted_by.append(F.substring("text", 1, 256).asc_nulls_first())
    ranged = turns.select("conv_id", "turn", "role", "text").repartitionByRange(*sorted_by)
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("conv_id", "range").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    placed = ranged.withColumn("nth", F.row_number().over(inside) - 1)
    met = placed.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")))
    return met.select("conv_id", "role", "text", (F.col("before") + F.col("nth")).alias("rank"))


def rendered(messages: Column, side: Column, context: tuple[str, ...] = CONTEXT) -> Column:
    """Array of struct(role, name, content, piece, trained) of the messages as seen by ``side``."""

    def message(m: Column) -> Column:
        mine = m["role"].eqNullSafe(side)
        fixed = F.coalesce(m["role"].isin(*context), F.lit(False))
        role = F.when(mine, F.lit("assistant")).when(fixed, m["role"]).otherwise(F.lit("user"))
        name = F.when(mine | fixed | m["role"].isNull(), F.lit("")).otherwise(F.regexp_replace(m["role"], r"[^\p{L}\p{N}_-]", "_"))
        content = F.regexp_replace(F.coalesce(m["text"], F.lit("")), r"<(\\*\|im_(?:start|end)\|>)", r"<\\$1")
        head = F.concat(F.lit(OPEN), role, F.when(name != "", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))
        return F.struct(
            role.alias("role"),
            name.alias("name"),
            content.alias("content"),
            head.alias("head"),
            F.concat(content, F.lit(CLOSE)).alias("said"),
            mine.alias("trained"),
        )

    return F.transform(messages, message)


def masks(pieces: Column) -> Column:
    """Array of struct(start, end): the code points of the rendered text that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(m["head"])
        end = begin + F.length(m["said"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"), F.when(m["trained"], F.concat(state["found"], span)).otherwise(state["found"]).alias("found")
        )

    return F.aggregate(pieces, start, step, lambda state: state["found"])


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv_id, participant, part, messages, text, mask."""
    ranked = materialize(numbered(turns), "ranks")
    sides = ranked.where(F.col("role").isNotNull() & ~F.col("role").isin(*context)).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("participant")
    )
    blocks = ranked.groupBy("conv_id", F.expr(f"cast(rank div {part_turns} AS int)").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns")
    )
    met = blocks.join(sides.distinct(), F.col("conv_id").eqNullSafe(F.col("_conv")))
    seen = met.select("conv_id", "participant", "part", rendered(F.col("turns"), F.col("participant"), context).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda m: F.concat(m["head"], m["said"], F.lit("\n"))), "")
    messages = F.transform("pieces", lambda m: F.struct(m["role"], m["name"], m["content"], m["trained"]))
    return seen.select("conv_id", "participant", "part", messages.alias("messages"), text.alias("text"), masks(F.col("pieces")).alias("mask"))


def perspective_rows(turns: DataFrame, context: tuple[str, ...] = CONTEXT, part_turns: int = PART_TURNS) -> DataFrame:
    """``perspectives`` with the mask as text and counts in place of the messages."""
    found = perspectives(turns, context, part_turns)
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "conv_id",
        "participant",
        "part",
        F.size("messages").alias("n_messages"),
        F.size("mask").alias("n_trained"),
        "text",
        F.array_join(spans, ",").alias("mask"),
    )


SQL = rf"""
WITH ranked AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS rank FROM conversations),
sides AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role NOT IN ('system')),
seen AS (
  SELECT s.conv_id, s.participant, (r.rank // {PART_TURNS})::INTEGER AS part, r.rank, coalesce(r.role = s.participant, false) AS mine,
    '{OPEN}' || CASE WHEN r.role = s.participant THEN 'assistant' WHEN r.role = 'system' THEN 'system' WHEN r.role IS NULL THEN 'user'
      ELSE 'user name=' || regexp_replace(r.role, '[^\p{{L}}\p{{N}}_-]', '_', 'g') END || chr(10) AS head,
    regexp_replace(coalesce(r.text, ''), '<(\\*\|im_(?:start|end)\|>)', '<\\\1', 'g') || '{CLOSE}' AS said
  FROM sides s JOIN ranked r ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, (sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, participant, part ORDER BY rank))::BIGINT - length(said) - 1 AS start
  FROM seen)
SELECT conv_id, participant, part, count(*)::INTEGER AS n_messages, sum(mine::INTEGER)::INTEGER AS n_trained,
  string_agg(head || said || chr(10), '' ORDER BY rank) AS text,
  coalesce(string_agg(start || ':' || (start + length(said)), ',' ORDER BY rank) FILTER (WHERE mine), '') AS mask
FROM placed GROUP BY conv_id, participant, part
"""
