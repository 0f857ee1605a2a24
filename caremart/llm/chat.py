"""Operator 5: chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant and
all others as named users; the mask holds the code-point spans of the speaker's own words, the only ones to
learn from.  Roles in ``SYSTEM_ROLES`` take no part: their turns stand where they fall, under the system head.

A conversation may hold a third of all rows, so it is never gathered whole: turns get their rank in the
conversation from range-partitioned running sums, and each record holds ``turns`` consecutive turns (``part``
counts them).  Conversations of up to ``turns`` turns have one record for each participant.  Parts share nothing: a
system turn stands only in the part it falls in, and later parts have neither it nor earlier turns.

Defined cases: a null role is the participant ``unknown``; a null text is empty (its turn stays, with an empty span
left out of the mask); turns with the same number are ordered by role, then text, and null numbers come first; repeated
rows are repeated turns; a null conversation id is a conversation of its own; a conversation of system turns only
has no participant and no record; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.functions.prefix import row_index
from caremart.llm.common import read_table

SYSTEM_ROLES = ("system",)
TURNS = 64
SYSTEM, ASSISTANT, USER, END = "<|system|>\n", "<|assistant|>\n", "<|user:%s|>\n", "<|end|>\n"


def perspectives(turns: DataFrame, per_part: int = TURNS, system_roles: Sequence[str] = SYSTEM_ROLES) -> DataFrame:
    """``conv_id, speaker, part, n_turns, n_target_chars, rendered, mask``.

    ``turns`` needs ``conv_id, turn, role, text``; ``mask`` is ``start:end`` of the speaker's words, comma-joined.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = row_index(rows, ["conv_id"], ["turn", "role", "text"], out="_at")
    rows = rows.withColumns({"part": (F.col("_at") / per_part).cast("long"), "_conv": F.coalesce(
        F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~"))})
    parts = rows.groupBy("_conv", "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(
        F.collect_list(F.struct("_at", "role", "text"))).alias("_turns"))  # at most per_part turns
    speakers = (rows.filter(~F.col("role").isin(list(system_roles))).select("_conv", F.col("role").alias("speaker"))
                .distinct())
    views = parts.join(speakers, "_conv")
    head = (lambda t: F.when(t["role"] == F.col("speaker"), F.lit(ASSISTANT))
            .when(t["role"].isin(list(system_roles)), F.lit(SYSTEM))
            .otherwise(F.format_string(USER, t["role"])))
    views = views.withColumn("_seen", F.transform("_turns", lambda t: F.struct(
        head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("speaker")).alias("own"))))
    step = (lambda t: F.length(t["head"]) + F.length(t["text"]) + len(END))
    spans = F.aggregate(
        "_seen", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("chars")),
        lambda acc, t: F.struct(
            (acc["at"] + step(t)).alias("at"),
            F.when(t["own"] & (t["text"] != ""), F.concat(acc["spans"], F.array(F.concat_ws(
                ":", (acc["at"] + F.length(t["head"])).cast("string"),
                (acc["at"] + F.length(t["head"]) + F.length(t["text"])).cast("string")))))
            .otherwise(acc["spans"]).alias("spans"),
            (acc["chars"] + F.when(t["own"], F.length(t["text"])).otherwise(0)).alias("chars")))
    views = views.withColumn("_spans", spans)
    return views.select(
        "conv_id", "speaker", "part", F.size("_turns").cast("long").alias("n_turns"),
        F.col("_spans.chars").cast("long").alias("n_target_chars"),
        F.array_join(F.transform("_seen", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("rendered"),
        F.array_join("_spans.spans", ",").alias("mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(read_table(spark, sf_dir, "conversations"))


def _e(text: str) -> str:
    return "E'" + text.replace("\n", "\\n") + "'"


_U0, _U1 = USER.split("%s")
SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                            coalesce(text, '')) - 1 AS pos
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role NOT IN ('{"', '".join(SYSTEM_ROLES)}')),
v AS (
  SELECT t.conv_id, s.speaker, t.pos // {TURNS} AS part, t.pos, t.text, t.role = s.speaker AS own,
         CASE WHEN t.role = s.speaker THEN {_e(ASSISTANT)}
              WHEN t.role IN ('{"', '".join(SYSTEM_ROLES)}') THEN {_e(SYSTEM)}
              ELSE {_e(_U0)} || t.role || {_e(_U1)} END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, coalesce(sum(length(head) + length(text) + {len(END)}) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + length(head) AS start FROM v)
SELECT conv_id, speaker, part, count(*) AS n_turns,
       sum(CASE WHEN own THEN length(text) ELSE 0 END)::BIGINT AS n_target_chars,
       string_agg(head || text || {_e(END)}, '' ORDER BY pos) AS rendered,
       coalesce(string_agg(start || ':' || (start + length(text)), ',' ORDER BY pos)
                FILTER (WHERE own AND text <> ''), '') AS mask
FROM p GROUP BY conv_id, speaker, part
"""
