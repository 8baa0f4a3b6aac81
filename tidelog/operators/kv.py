"""Reads of the current state or of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.changelog import UNBOUNDED, Bound, between, resolve


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """One row if the key is alive, else none."""
    return resolve(log.where(F.col("key") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """probes with the value of each key, null where it isn't alive, and found."""
    state = resolve(log, snapshot).select("key", "val", F.lit(True).alias("found"))
    return probes.join(state, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(log: DataFrame, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED, snapshot: int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """The living keys of a range in order; with a limit, a top-k and no full sort."""
    rows = resolve(between(log, low, high), snapshot)
    rows = rows.orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return rows if limit is None else rows.limit(limit)


def last(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The largest living key and its value; no row if there is none."""
    found = resolve(log, snapshot).agg(F.max("key").alias("key"), F.max_by("val", "key").alias("val"))
    return found.where("key IS NOT NULL")
