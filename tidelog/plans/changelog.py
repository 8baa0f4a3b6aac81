"""The change log: one row (lsn, key, op, val) per write, from which all state is derived.

op is P (put) or D (delete); a null value never means a delete, and an empty one is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PUT, DELETE = "P", "D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as writes to their users' keys; an error deletes."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("key"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("value")).alias("val"))


def at_snapshot(log: DataFrame, lsn: int | None) -> DataFrame:
    """The log up to a snapshot. This stands below the resolution: a filter above it would find other versions."""
    return log if lsn is None else log.where(F.col("lsn") <= lsn)


def resolve(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, lsn, val) of the keys that are alive: the newest version of each key, unless it is a delete.

    An aggregate, so that a key that is written again and again is reduced to one row before the shuffle. A filter on key
    above goes below it and into the scan.
    """
    newest = at_snapshot(log, snapshot).groupBy("key").agg(F.max("lsn").alias("lsn"), F.max_by(F.col("op") == PUT, "lsn").alias("_alive"), F.max_by("val", "lsn").alias("val"))
    return newest.where("_alive").drop("_alive")


def history(log: DataFrame) -> DataFrame:
    """Every version with its rank in its key, the newest first."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("lsn").desc()))
    return log.withColumn("version_rank", rank.cast("long"))


class Bound:
    """One side of a key range: included, excluded or none."""

    def __init__(self, key=None, included: bool = True):
        self.key, self.included = key, included

    def above(self, col: Column) -> Column | None:
        return None if self.key is None else col >= F.lit(self.key) if self.included else col > F.lit(self.key)

    def below(self, col: Column) -> Column | None:
        return None if self.key is None else col <= F.lit(self.key) if self.included else col < F.lit(self.key)


def included(key) -> Bound:
    return Bound(key)


def excluded(key) -> Bound:
    return Bound(key, False)


UNBOUNDED = Bound()


def between(rows: DataFrame, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED, col: str = "key") -> DataFrame:
    """The rows in a range of keys. A range whose start is after its end, or that excludes the one key it names, is an error."""
    if low.key is not None and high.key is not None and (low.key > high.key or low.key == high.key and not low.included and not high.included):
        raise ValueError(f"no range begins at {low.key!r} and ends at {high.key!r}")
    for condition in (low.above(F.col(col)), high.below(F.col(col))):
        rows = rows if condition is None else rows.where(condition)
    return rows
