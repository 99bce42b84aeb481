"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as
``assistant``, ``system`` turns as ``system`` and all others as users named after their roles. The loss
mask covers the assistant's contents and end marks, as [start, end) spans of code points.

A turn renders as ``<|im_start|>assistant\\n`` or ``<|im_start|>system\\n`` or
``<|im_start|>user name=ROLE\\n``, its text, ``<|im_end|>\\n``. Turns are ordered by number, role and text.
A conversation of over ``PART_TURNS`` turns comes in parts of so many turns numbers each; ``start`` is a
part's place in the whole rendering, so the parts' texts joined in order are the whole. Only speakers
other than ``system`` are participants. Null texts render as empty, null roles as ``unknown``, null turns
come last; null conversation ids form one conversation. Repeated rows are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 1024


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv_id, participant, part, start, n_turns, text, mask."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit((1 << 62))).cast("long").alias("part"),
    )
    speakers = (
        turns.where("role <> 'system'")
        .groupBy("conv_id", "part")
        .agg(F.collect_set("role").alias("some"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))).alias("speakers"))
    )
    parts = turns.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "body"))).alias("turns")
    )
    each = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["conv_id"])).select(
        parts["conv_id"], "part", "turns", F.explode("speakers").alias("participant")
    )
    head = lambda t: (
        F.when(t["role"] == F.col("participant"), F.lit("<|im_start|>assistant\n"))
        .when(t["role"] == "system", F.lit("<|im_start|>system\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), t["role"], F.lit("\n")))
    )
    tail = "<|im_end|>\n"
    pieces = each.select(
        "conv_id",
        "participant",
        "part",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(head(t), t["body"], F.lit(tail)).alias("text"),
                F.length(head(t)).alias("skip"),
                (t["role"] == F.col("participant")).alias("mine"),
            ),
        ).alias("pieces"),
    )
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["mine"],
                F.array_append(
                    acc["out"],
                    F.concat_ws(":", (acc["at"] + p["skip"]).cast("string"), (acc["at"] + F.length(p["text"]) - 1).cast("string")),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], ","),
    )
    done = pieces.select(
        "conv_id",
        "participant",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        spans.alias("mask"),
    )
    before = Window.partitionBy("conv_id", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0))).select(
        "conv_id", "participant", "part", "start", "n_turns", "text", "mask"
    )


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body,
         CAST(coalesce(floor(turn / {PART_TURNS}.0), 4611686018427387904) AS BIGINT) AS part
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
h AS (
  SELECT t.*, s.participant,
         CASE WHEN role = participant THEN '<|im_start|>assistant' || chr(10)
              WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS piece,
         row_number() OVER (PARTITION BY conv_id, participant, part ORDER BY turn NULLS LAST, role, body) AS pos
  FROM h),
a AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, participant, part ORDER BY pos
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0
  FROM r),
g AS (
  SELECT conv_id, participant, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY pos) AS text,
         coalesce(string_agg(CAST(CAST(pos0 + length(head) AS BIGINT) AS VARCHAR) || ':' ||
                             CAST(CAST(pos0 + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY pos)
                  FILTER (WHERE role = participant), '') AS mask
  FROM a GROUP BY ALL)
SELECT conv_id, participant, part,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, participant ORDER BY part
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       n_turns, text, mask
FROM g
"""
