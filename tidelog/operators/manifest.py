"""Sorted runs and the versions that hold them: a manifest row per run, an edit per version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 6


def manifest(log: DataFrame, sst_id: Column, level: Column) -> DataFrame:
    """(sst_id, level, lsn_lo, lsn_hi, key_lo, key_hi, n) of the runs of a log."""
    runs = log.withColumn("sst_id", sst_id).groupBy("sst_id").agg(F.min("lsn").alias("lsn_lo"), F.max("lsn").alias("lsn_hi"), F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), F.count("*").alias("n"))
    return runs.withColumn("level", level)


def overlapping(runs: DataFrame, low, high, of: str = "key") -> DataFrame:
    """Runs that may hold something from low to high, both included; none if the range ends before it begins."""
    return runs.where((F.col(f"{of}_lo") <= F.lit(high)) & (F.col(f"{of}_hi") >= F.lit(low)) & F.lit(low <= high))


def levels(runs: DataFrame) -> DataFrame:
    """(level, n_runs, sst_ids) of all six levels, each by key_lo, then id; ids joined by commas, null in an empty level."""
    spark = runs.sparkSession
    ids = F.transform(F.array_sort(F.collect_list(F.struct("key_lo", "sst_id"))), lambda r: r["sst_id"].cast("string"))
    found = runs.groupBy("level").agg(F.count("*").alias("n_runs"), F.array_join(ids, ",").alias("sst_ids"))
    every = spark.range(LEVELS).select(F.col("id").alias("level"))
    return every.join(found.withColumn("level", F.col("level").cast("long")), "level", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0).cast("long")))


def live_at(edits: DataFrame, version: int) -> DataFrame:
    """(sst_id) of the runs of a version; edits are (version, sst_add, sst_del) with arrays of ids."""
    known = edits.where(F.col("version") <= version)
    added = known.select(F.explode("sst_add").alias("sst_id"))
    return added.join(known.select(F.explode("sst_del").alias("sst_id")), "sst_id", "left_anti").distinct()


def live_in(edits: DataFrame, versions: list[int]) -> DataFrame:
    """(sst_id) of the runs that any of some versions holds: what no collection may remove."""
    found = live_at(edits, versions[0])
    for v in versions[1:]:
        found = found.unionByName(live_at(edits, v))
    return found.distinct()
