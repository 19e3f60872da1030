"""Chat formatting for preferences: the common turn prefix as prompt, once, and two masked completions.

A pair of conversations (chosen, rejected) shares its turns up to the first one that differs. Turns before it are
rendered once, as the prompt; the rest of either side is a completion. Everything is rendered as ordered segments, a
header and a body for each turn, with a mask: only bodies of assistant turns in completions are trained on. Segments
are rows, so that no conversation, however long, is gathered in one place; the first differing turn comes from
aggregates by (pair, turn) and then by pair.

Defined results: of rows that repeat a side's turn, the smallest by (role, text) counts; a null text is empty, a null
role is "unknown", a null turn stands before all others; rows without a conversation id take no part. A conversation
without a partner is all chosen completion; two equal conversations are all prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The chat template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

CHOSEN, REJECTED = 0, 1


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Turns as pair_id, side, conv_id, turn, role, text: conversation 2k is chosen over 2k + 1."""
    conv = F.col("conv_id").cast("long")
    side = F.pmod(conv, F.lit(2)).cast("int")
    return conversations.filter(conv.isNotNull()).select(
        ((conv - side) / 2).cast("long").alias("pair_id"),
        side.alias("side"),
        conv.alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def preference_segments(turns: DataFrame) -> DataFrame:
    """Segments of every pair: pair_id, part (prompt, chosen, rejected), conv_id, turn, piece (0 header, 1 body), role,
    text (rendered), trained (1 if the loss counts), cut_turn (first turn of the completions, null if there are none).
    """
    said = turns.groupBy("pair_id", "side", "conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    # what both sides say is compared by its digest, so that texts needn't meet
    role, text = F.col("said.role"), F.col("said.text")
    digest = F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)
    by_turn = said.select("pair_id", "turn", digest.alias("digest")).groupBy("pair_id", "turn").agg(
        F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    differs = (F.col("n") < 2) | (F.col("low") != F.col("high"))
    cuts = by_turn.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("cut_turn"))
    placed = said.join(cuts, "pair_id")
    common = F.col("cut_turn").isNull() | (F.col("turn") < F.col("cut_turn"))
    placed = placed.filter(~common | (F.col("side") == CHOSEN)).withColumn(
        "part", F.when(common, "prompt").when(F.col("side") == CHOSEN, "chosen").otherwise("rejected")
    )
    learnt = ((F.col("part") != "prompt") & (role == "assistant")).cast("int")
    header = F.struct(F.lit(0).alias("piece"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("text"), F.lit(0).alias("trained"))
    body = F.struct(F.lit(1).alias("piece"), F.concat(text, F.lit(CLOSE + "\n")).alias("text"), learnt.alias("trained"))
    return placed.select(
        "pair_id", "part", "conv_id", "turn", "cut_turn", role.alias("role"), F.explode(F.array(header, body)).alias("x")
    ).select("pair_id", "part", "conv_id", "turn", "x.piece", "role", "x.text", "x.trained", "cut_turn")


SQL = f"""
WITH t AS (
  SELECT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, CAST(((conv_id % 2) + 2) % 2 AS INTEGER) AS side, conv_id,
         coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT pair_id, side, conv_id, turn, min({{'role': role, 'text': text}}) AS said FROM t GROUP BY ALL),
c AS (
  SELECT pair_id, min(CASE WHEN n < 2 OR low <> high THEN turn END) AS cut_turn
  FROM (SELECT pair_id, turn, count(*) AS n, min(said) AS low, max(said) AS high FROM s GROUP BY ALL) GROUP BY pair_id),
p AS (
  SELECT s.*, c.cut_turn, CASE WHEN c.cut_turn IS NULL OR turn < c.cut_turn THEN 'prompt'
         WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part
  FROM s JOIN c USING (pair_id))
SELECT pair_id, part, conv_id, turn, CAST(piece AS INTEGER) AS piece, said.role AS role,
       CASE piece WHEN 0 THEN '{OPEN}' || said.role || chr(10) ELSE said.text || '{CLOSE}' || chr(10) END AS text,
       CAST(piece = 1 AND part <> 'prompt' AND said.role = 'assistant' AS INTEGER) AS trained, cut_turn
FROM p, (VALUES (0), (1)) AS v(piece) WHERE NOT (part = 'prompt' AND side = 1)
"""
