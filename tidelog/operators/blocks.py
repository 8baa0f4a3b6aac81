"""Data blocks of sorted runs: records with delta-coded keys and restart points, block indexes and per-block bloom filters.

A run's records are in the order of versions: key ascending, LSN descending. An internal key is the key and its LSN as eight
bytes, lowest first. A record is three varints (bytes shared with the internal key before, bytes that follow, bytes of value)
and those bytes. A block ends with the record that brings it to its limit; its first record shares nothing, nor does every
interval + 1st from there: reading can begin at these.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import bloom
from tidelog.functions.varint import read_varint, varint_bytes

LSN_BYTES = 8


class Corrupted(ValueError):
    """Bytes that no writer of blocks has written."""


def internal_key(key: bytes, lsn: int) -> bytes:
    return key + lsn.to_bytes(LSN_BYTES, "little")


def split_key(internal: bytes) -> tuple[bytes, int]:
    if len(internal) < LSN_BYTES:
        raise Corrupted("an internal key ends with an LSN")
    return internal[:-LSN_BYTES], int.from_bytes(internal[-LSN_BYTES:], "little")


def internal_key_of(key: Column, lsn: Column) -> Column:
    """internal_key() as a column."""
    digits = F.lpad(F.hex(lsn.cast("long")), 2 * LSN_BYTES, "0")
    return F.concat(key, F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(LSN_BYTES, 0, -1)])))


def encode(rows: DataFrame, run: str, key: str, lsn: str, val: str, limit: int = 4096, interval: int = 16, bits_per_key: int = 20) -> DataFrame:
    """(run, block_id, n, key_lo, key_hi, restarts, data, probes, bloom): the blocks of each run (a long) of rows.

    key and val are bytes, without nulls. restarts are offsets into data; the filter is of keys, without LSNs. Rows are streamed
    in order, so a task holds one block.
    """

    def run_blocks(batches):
        at, number, keys, parts, restarts, size, before = None, 0, [], [], [], 0, b""

        def block():
            probes, bits = bloom.build_local(sorted(set(keys)), bits_per_key)
            columns = [([at], pa.int64()), ([number], pa.int64()), ([len(keys)], pa.int64()), ([keys[0]], pa.binary()), ([keys[-1]], pa.binary()), ([restarts], pa.list_(pa.int32())), ([b"".join(parts)], pa.binary()), ([probes], pa.int32()), ([bits], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["run", "block_id", "n", "key_lo", "key_hi", "restarts", "data", "probes", "bloom"])

        for b in batches:
            for of, k, lsn, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if of != at or size >= limit:
                    if keys:
                        yield block()
                    number = number + 1 if of == at else 0
                    at, keys, parts, restarts, size = of, [], [], [], 0
                whole, shared = internal_key(k, lsn), 0
                if len(keys) % (interval + 1) == 0:
                    restarts.append(size)
                else:
                    shared = len(os.path.commonprefix([before, whole]))
                rest, before = whole[shared:], whole
                parts.append(varint_bytes(shared) + varint_bytes(len(rest)) + varint_bytes(len(value)) + rest + value)
                size += len(parts[-1])
                keys.append(k)
        if keys:
            yield block()

    named = rows.select(F.col(run).cast("long").alias("run"), F.col(key).alias("key"), F.col(lsn).alias("lsn"), F.col(val).alias("val"))
    dealt = named.repartition("run").sortWithinPartitions("run", "key", F.col("lsn").desc())
    return dealt.mapInArrow(run_blocks, "run long, block_id long, n long, key_lo binary, key_hi binary, restarts array<int>, data binary, probes int, bloom binary")


def read_block(data: bytes, at: int = 0):
    """(offset, shared, key, lsn, value) of a block's records from a restart point on."""
    before = b""
    while at < len(data):
        start = at
        try:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
        except ValueError as e:
            raise Corrupted("a block's record has no sizes") from e
        if shared > len(before) or at + rest + n > len(data):
            raise Corrupted("a block's record isn't as long as it says")
        before = before[:shared] + data[at : at + rest]
        key, lsn = split_key(before)
        yield start, shared, key, lsn, data[at + rest : at + rest + n]
        at += rest + n


def seek(data: bytes, restarts: list[int], key: bytes):
    """The records of a block from the first with that key or a larger one on: found among the restart points by halves."""
    low, high = 0, len(restarts) - 1
    while low < high:  # the last restart point with a smaller key
        middle = (low + high + 1) // 2
        if next(read_block(data, restarts[middle]))[2] < key:
            low = middle
        else:
            high = middle - 1
    for record in read_block(data, restarts[low] if restarts else 0):
        if record[2] >= key:
            yield record


def decode(blocks: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """(run, block_id, position, offset, shared, key, lsn, val) of blocks, of keys from low to high, both included.

    Blocks outside are pruned by key_lo and key_hi before their bytes are read, and in the first block reading begins at a
    restart point. position counts within the block, of the records that are returned.
    """
    if low is not None:
        blocks = blocks.where(F.col("key_hi") >= F.lit(bytearray(low)))
    if high is not None:
        blocks = blocks.where(F.col("key_lo") <= F.lit(bytearray(high)))

    def run(batches):
        for b in batches:
            for number, block_id, restarts, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found = []
                for record in seek(data, restarts, low) if low is not None else read_block(data):
                    if high is not None and record[2] > high:
                        break
                    found.append((number, block_id, len(found), *record))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    names = ["run", "block_id", "position", "offset", "shared", "key", "lsn", "val"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return blocks.select("run", "block_id", "restarts", "data").mapInArrow(run, "run long, block_id long, position long, offset long, shared long, key binary, lsn long, val binary")


def overlapping(blocks: DataFrame, low: bytes, high: bytes) -> DataFrame:
    """Blocks that may hold a key from low to high, both included."""
    return blocks.where((F.col("key_hi") >= F.lit(bytearray(low))) & (F.col("key_lo") <= F.lit(bytearray(high))))


def likely_contains(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (run, key) with `likely`: false only if the run doesn't hold the key, told by the filters of the blocks around it."""

    def run(batches):
        for b in batches:
            held = [bool(bloom.likely([k], n, bits)[0]) for k, n, bits in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held)], ["run", "_key", "_likely"])

    around = probes.select("run", F.col("key").alias("_key")).distinct().join(blocks, "run").where((F.col("_key") >= F.col("key_lo")) & (F.col("_key") <= F.col("key_hi")))
    found = around.select("run", "_key", "_key", "probes", "bloom").toDF("run", "_key", "k", "probes", "bloom").mapInArrow(run, "run long, _key binary, _likely boolean")
    found = found.groupBy("run", F.col("_key").alias("key")).agg(F.max("_likely").alias("likely"))
    return probes.join(found, ["run", "key"], "left").withColumn("likely", F.coalesce("likely", F.lit(False)))
