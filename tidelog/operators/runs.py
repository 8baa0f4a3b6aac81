"""What a sorted run's writer computes: shared prefixes, restart points and block borders. A run is a bounded group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_run(rows: DataFrame, files: int, key: str = "key", lsn: str = "lsn") -> DataFrame:
    """Rows dealt into key ranges, each in the order of versions: key ascending, lsn descending."""
    return rows.repartitionByRange(files, key).sortWithinPartitions(F.col(key), F.col(lsn).desc())


def order_flags(rows: DataFrame, run: str, key: str, lsn: str, position: str) -> DataFrame:
    """rows with out_of_order: whether a record isn't strictly after the one before it; equal (key, lsn) aren't."""
    w = Window.partitionBy(run).orderBy(position)
    before_key, before_lsn = F.lag(key).over(w), F.lag(lsn).over(w)
    ok = before_key.isNull() | (before_key < F.col(key)) | ((before_key == F.col(key)) & (before_lsn > F.col(lsn)))
    return rows.withColumn("out_of_order", ~ok)


def check_order(rows: DataFrame, run: str, key: str, lsn: str, position: str) -> DataFrame:
    """The rows, unless a run isn't strictly in order by position."""
    flagged = order_flags(rows, run, key, lsn, position)
    return flagged.withColumn("_ok", F.assert_true(~F.col("out_of_order"), F.lit("record out of order"))).where("_ok IS NULL").drop("_ok", "out_of_order")


def prefix_delta(rows: DataFrame, run: str, key: str, tie: str) -> DataFrame:
    """rows with shared_len and delta: how many characters each key shares with the one before it in its run, and the rest."""
    before = F.coalesce(F.lag(key).over(Window.partitionBy(run).orderBy(key, tie)), F.lit(""))
    at = F.sequence(F.lit(1), F.least(F.length("_before"), F.length(key)))
    differ = F.array_position(F.transform(at, lambda i: F.substring(F.col(key), i, 1) == F.substring(F.col("_before"), i, 1)), False)
    shortest = F.least(F.length("_before"), F.length(key))
    shared = F.when(shortest == 0, 0).when(differ == 0, shortest).otherwise(differ - 1).cast("long")
    rows = rows.withColumn("_before", before).withColumn("shared_len", shared)
    return rows.withColumn("delta", F.substring(F.col(key), F.col("shared_len").cast("int") + 1, F.length(key))).drop("_before")


def restarts(rows: DataFrame, run: str, key: str, tie: str, interval: int = 16) -> DataFrame:
    """rows with is_restart: the first record of a run and every interval + 1 from there hold their whole key."""
    place = F.row_number().over(Window.partitionBy(run).orderBy(key, tie))
    return rows.withColumn("is_restart", (place - 1) % (interval + 1) == 0)


def blocks(rows: DataFrame, run: str, lsn: str, size: str, limit: int) -> DataFrame:
    """(run, lsn, block_id): a block ends with the record that brings it to the limit, so blocks overshoot."""
    kind = rows.schema[run].dataType.simpleString()

    def cut(pdf):
        pdf = pdf.sort_values("lsn")
        ids, block, held = [], 0, 0
        for n in pdf["size"]:
            ids.append(block)
            held += n
            if held >= limit:
                block, held = block + 1, 0
        return pd.DataFrame({"run": pdf["run"], "lsn": pdf["lsn"], "block_id": ids})

    named = rows.select(F.col(run).alias("run"), F.col(lsn).alias("lsn"), F.col(size).alias("size"))
    return named.groupBy("run").applyInPandas(cut, f"run {kind}, lsn long, block_id long")
