"""The write-ahead log: replay, recovery, retention, framing and what survives corruption."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.changelog import resolve

# Fixed values of the record frame: a magic byte, a type byte, a 4-byte length, the payload and its CRC-32.
MAGIC, TYPE, FRAME_BYTES = 0xEF, 0, 10


def replay_from(log: DataFrame, start: int) -> DataFrame:
    """Records from an LSN on, never an earlier one; order them by lsn where order matters."""
    return log.where(F.col("lsn") >= start)


def recover(checkpoint: DataFrame, log: DataFrame, checkpoint_lsn: int) -> DataFrame:
    """State from a checkpoint (key, lsn, val), taken at checkpoint_lsn, and the log's records after it."""
    base = checkpoint.select("lsn", "key", F.lit("P").alias("op"), "val")
    return resolve(base.unionByName(replay_from(log, checkpoint_lsn + 1)))


def assert_contiguous(log: DataFrame, start: int) -> None:
    """The tail from start on has every LSN once, or the log isn't one that can be replayed."""
    low, high, n, distinct = replay_from(log, start).agg(F.min("lsn"), F.max("lsn"), F.count("*"), F.count_distinct("lsn")).first()
    if n and (low != start or high - low + 1 != n or distinct != n):
        raise ValueError(f"{n} records from {low} to {high} aren't the log's tail from {start}")


def kept_segments(segments: DataFrame, lsn: int) -> DataFrame:
    """Segments (start) that stay after all records up to an LSN were discarded.

    A segment goes only if the next one begins at or before that LSN: the one that holds the LSN stays, whole.
    """
    holds = segments.where(F.col("start") <= lsn).agg(F.max("start").alias("holds"))
    return segments.crossJoin(F.broadcast(holds)).where((F.col("start") > lsn) | (F.col("start") == F.col("holds"))).drop("holds")


def readable(log: DataFrame, bad: Column, mode: str = "global", segment: str = "seg") -> DataFrame:
    """Records before the first bad one: of the whole log (global), or of each segment by itself (per_segment).

    The first bad LSN is an aggregate, so nothing is put in order.
    """
    marked = log.withColumn("_bad", bad)
    if mode == "per_segment":
        first = marked.where("_bad").groupBy(segment).agg(F.min("lsn").alias("_first"))
        marked = marked.join(first, segment, "left")
    elif mode == "global":
        marked = marked.crossJoin(F.broadcast(marked.where("_bad").agg(F.min("lsn").alias("_first"))))
    else:
        raise ValueError(f"mode is global or per_segment, not {mode!r}")
    return marked.where(F.col("_first").isNull() | (F.col("lsn") < F.col("_first"))).drop("_bad", "_first")


def record_sizes(log: DataFrame, payload: Column, segment: str = "seg") -> DataFrame:
    """The framed size of each record and its offset in its segment."""
    rows = log.withColumn("record_bytes", (F.octet_length(payload) + FRAME_BYTES).cast("long"))
    before = Window.partitionBy(segment).orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("record_offset", F.coalesce(F.sum("record_bytes").over(before), F.lit(0)).cast("long"))


def little_endian(n: Column) -> Column:
    """A number below 2**32 as four bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def frame(payload: Column) -> Column:
    """The bytes of a record."""
    head = F.unhex(F.lit(f"{MAGIC:02X}{TYPE:02X}"))
    return F.concat(head, little_endian(F.octet_length(payload)), payload, little_endian(F.crc32(payload)))


def intact(record: Column) -> Column:
    """Whether a frame's magic, type, length and checksum agree with its payload."""
    n = F.octet_length(record)
    payload = F.substring(record, 7, n - FRAME_BYTES)
    return F.coalesce((n >= FRAME_BYTES) & (record == frame(payload)), F.lit(False))


def read_frames(data: bytes) -> tuple[list[bytes], bool]:
    """Payloads of the records at the beginning of a segment's bytes, and whether all of it could be read.

    What isn't a record, whole and with the right checksum, ends the segment: nothing after it can be trusted.
    """
    found, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at + 2 : at + 6], "little")
        end = at + FRAME_BYTES + n
        payload = data[at + 6 : at + 6 + n]
        if end > len(data) or data[at] != MAGIC or data[at + 1] != TYPE or zlib.crc32(payload) != int.from_bytes(data[end - 4 : end], "little"):
            return found, False
        found.append(payload)
        at = end
    return found, True


def decode(segments: DataFrame, mode: str = "global") -> DataFrame:
    """(start, lsn, payload) of framed segments (start, data): LSNs go on from a segment's start.

    Corruption ends its segment (per_segment), or the log from there on (global); a null data is an empty segment. A task holds
    one segment's bytes at a time.
    """
    if mode not in ("global", "per_segment"):
        raise ValueError(f"mode is global or per_segment, not {mode!r}")

    def run(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found, whole = read_frames(data.as_py() or b"")
                if not whole:  # where reading stopped, told by a record without payload
                    found.append(None)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([start] * len(found), pa.int64()), pa.array(range(start, start + len(found)), pa.int64()), pa.array(found, pa.binary()), pa.array([x is None for x in found])], ["start", "lsn", "payload", "bad"])

    rows = segments.select(F.col("start").cast("long").alias("start"), "data").mapInArrow(run, "start long, lsn long, payload binary, bad boolean")
    if mode == "per_segment":
        return rows.where("NOT bad").drop("bad")
    return readable(rows, F.col("bad"), "global").drop("bad")
