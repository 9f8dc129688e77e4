"""Chat formatting by perspective rotation, with DataFrame expressions only.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant
and all others as named users; the speaker's own messages are the spans to train on.  Speakers in
``context`` (system prompts) are rendered as such and never rotated.

A row is a whole dialogue from one perspective, and spans are code points of its text.  A dialogue must fit
in a row's text; for tables where a third of all rows may be one, ``part_turns`` cuts dialogues into parts of
so many consecutive turn numbers, each a row of its own with spans of its own; the parts in order are the dialogue.

Cases: each row is a message, repeated ones too; messages of one turn are ordered by role, then text; those without
a turn come before all others (with ``part_turns``, as the part before the first); a null role is the speaker ``unknown``; a null text is empty; a null dialogue id is a dialogue of its own;
dialogues without participants, and empty tables, give no rows; other columns are ignored.
Control marks inside texts are broken up, so that a text cannot end its message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import let, running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render(docs_role: Column, speaker: Column, text: Column, context: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Head, body and tail of one message seen from a speaker."""
    name = F.when(docs_role == speaker, F.lit("assistant")).when(docs_role.isin(*context), docs_role).otherwise(F.concat(F.lit("user name="), docs_role))
    return F.concat(F.lit(OPEN), name, F.lit("\n")), text, F.lit(CLOSE)


def perspectives(
    turns: DataFrame, context: tuple[str, ...] = ("system",), part_turns: int | None = None,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, speaker, part (0 for whole dialogues, null for what has no turn), n_messages, text, mask (spans "start:end", end exclusive, comma-joined)
    and n_train_chars."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"<\|im_", "<| im_")
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), text.alias("text"),
    )
    rows = rows.withColumn("part", F.floor(F.col("turn") / part_turns).cast("long") if part_turns else F.lit(0).cast("long"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = rows.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv")))

    def piece(m: Column) -> Column:
        head, body, tail = render(m["role"], F.col("speaker"), m["text"], context)
        return F.struct(F.concat(head, body, tail).alias("all"), F.length(head).alias("head"), F.length(body).alias("body"), (m["role"] == F.col("speaker")).alias("own"))

    def masked(p: Column, ends: Column) -> Column:
        span = lambda x, i: let(F.get(ends, i) - F.length(x["all"]) + x["head"], lambda lo: F.struct(x["own"].alias("own"), lo.alias("lo"), (lo + x["body"]).alias("hi")))
        return F.filter(F.transform(p, span), lambda x: x["own"])

    pieces = seen.select("conv_id", "speaker", "part", F.transform("messages", piece).alias("p"))
    ends = running(F.transform("p", lambda x: F.length(x["all"])), lambda a, b: a + b)
    out = pieces.select("conv_id", "speaker", "part", "p", let(ends, lambda e: masked(F.col("p"), e)).alias("m"))
    return out.select(
        "conv_id", "speaker", "part", F.size("p").cast("long").alias("n_messages"),
        F.array_join(F.transform("p", lambda x: x["all"]), "").alias("text"),
        F.array_join(F.transform("m", lambda x: F.concat(x["lo"].cast("string"), F.lit(":"), x["hi"].cast("string"))), ",").alias("mask"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]).alias("n_train_chars"),
    )


ORACLE_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
p AS (SELECT r.conv_id, speaker, CAST(0 AS BIGINT) AS part, turn, role, text, role = speaker AS own,
  '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head
  FROM r JOIN s USING (conv_id)),
o AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM p),
q AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS lo FROM o)
SELECT conv_id, speaker, part, count(*) AS n_messages, string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(CAST(lo AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(lo + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(length(text)) FILTER (WHERE own), 0) AS BIGINT) AS n_train_chars
FROM q GROUP BY conv_id, speaker, part"""
