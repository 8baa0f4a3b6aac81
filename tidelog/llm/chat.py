"""Conversations logged again after each turn: keep the longest of each chain, then render it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place and two 64-bit hashes of the conversation up to it.

    A turn's hash covers its place, role and text; the hash of a prefix is the exclusive or of its turns' hashes, which
    rolls on from turn to turn. Turns are placed by turn, then role and text, so repeated turn numbers are no accident.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order).cast("long"))
    # Nulls are hashed as nulls: xxhash64 skips them, so whether each is null is hashed too.
    seen = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return turns.withColumn("h1", F.bit_xor(F.xxhash64(F.lit(1), *seen)).over(so_far)).withColumn("h2", F.bit_xor(F.xxhash64(F.lit(2), *seen)).over(so_far))


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations.

    A conversation goes if it is the beginning of a longer one; of equal ones the smallest conv_id stays (null sorts
    first). Rows with a null conv_id are one conversation. A null role renders as `unknown`, a null text as nothing.
    Other columns are ignored. Only turns of the same conversation meet in one task.
    """
    turns = turn_prefixes(conversations)
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    last = F.max(F.struct("place", "h1", "h2"))
    whole = turns.groupBy("conv_id").agg(last.alias("end"), F.sort_array(F.collect_list(F.struct("place", said.alias("said")))).alias("turns"))
    whole = whole.select("conv_id", F.col("end.place").alias("n_turns"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2"), F.array_join(F.col("turns.said"), "").alias("rendered"))
    longest = Window.partitionBy("conv_id")
    begins = turns.withColumn("n", F.count("*").over(longest)).where("place < n").groupBy(F.col("place").alias("n_turns"), "h1", "h2").agg(F.lit(1).alias("_"))
    # One row of each group of copies before the anti-join, which then has no hot key.
    first = whole.groupBy("n_turns", "h1", "h2").agg(F.min(F.struct("conv_id", "rendered")).alias("first"))
    return first.join(begins, ["n_turns", "h1", "h2"], "left_anti").select("first.conv_id", "n_turns", "first.rendered")


#: The same result by comparing the conversations themselves.
COLLAPSE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list((role, text) ORDER BY place) AS turns,
      string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, rendered FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.turns[1] IS NOT DISTINCT FROM a.turns[1] AND (b.n_turns > a.n_turns OR b.n_turns = a.n_turns AND b.conv_id < a.conv_id) AND b.turns[1:a.n_turns] = a.turns)
"""
