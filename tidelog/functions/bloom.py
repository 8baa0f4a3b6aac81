"""Bloom filters over key bytes, built in parallel and probed before an exact semi join."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the filter's hash and shape, which the test vectors rest on.
MULTIPLIER, SHIFT, SEED = 0xC6A4A793, 24, 0xBC9F1D3
ROTATE, LEAST_BITS, MOST_PROBES = 17, 64, 30
PROBES_PER_BIT = 0.69
#: Bytes of a filter that are ORed and sent at a time.
BLOCK_BYTES = 1 << 16
#: A filter is broadcast up to this many bytes; beyond, the semi join goes without it.
BROADCAST_BYTES = 64 << 20


def bloom_hash(keys: list[bytes]) -> np.ndarray:
    """32-bit hashes of keys, all keys at a time: a round per four bytes, on the keys that are long enough."""
    n = np.array([len(k) for k in keys], np.int64)
    width = max(4, int(-(-n.max(initial=0) // 4) * 4))
    raw = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(len(keys), width)
    words, m = raw.view("<u4"), np.uint32(MULTIPLIER)
    h = np.uint32(SEED) ^ (n.astype(np.uint32) * m)
    for i in range(width // 4):
        full = n >= 4 * (i + 1)
        step = (h + words[:, i]) * m
        h = np.where(full, step ^ (step >> np.uint32(16)), h)
    # What is left of a key, one to three bytes, is one little-endian number.
    rest = n % 4
    tail = np.take_along_axis(words, np.minimum(n // 4, width // 4 - 1)[:, None], 1)[:, 0]
    step = (h + tail) * m
    return np.where(rest > 0, step ^ (step >> np.uint32(SHIFT)), h)


def shape(n: int, bits_per_key: int) -> tuple[int, int]:
    """Probes per key and bytes of a filter for n keys."""
    probes = min(MOST_PROBES, max(1, int(bits_per_key * PROBES_PER_BIT)))
    return probes, -(-max(bits_per_key * n, LEAST_BITS) // 8)


def positions(hashes: np.ndarray, probes: int, size: int) -> np.ndarray:
    """Bit positions [key, probe]: a hash, and further ones at a distance that is the hash itself, rotated."""
    delta = (hashes >> np.uint32(ROTATE)) | (hashes << np.uint32(32 - ROTATE))
    return (hashes[:, None] + delta[:, None] * np.arange(probes, dtype=np.uint32)[None, :]) % np.uint32(size * 8)


def build_local(keys: list[bytes], bits_per_key: int) -> tuple[int, bytes]:
    probes, size = shape(len(keys), bits_per_key)
    bits = np.zeros(size, np.uint8)
    if keys:
        at = positions(bloom_hash(keys), probes, size).ravel()
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return probes, bits.tobytes()


def likely(keys: list[bytes], probes: int, bits: bytes) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    if not keys:
        return np.zeros(0, bool)
    at, held = positions(bloom_hash(keys), probes, len(bits)), np.frombuffer(bits, np.uint8)
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def set_bits(bits: np.ndarray, keys: list[bytes], probes: int) -> None:
    if keys:
        at = positions(bloom_hash(keys), probes, len(bits)).ravel()
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def build(keys: DataFrame, col: str, bits_per_key: int, n: int | None = None, block: int = BLOCK_BYTES) -> tuple[int, bytes]:
    """The filter of a column of bytes, without nulls. Each task ORs its keys' bits; the blocks of bytes that have any are
    ORed in tasks too, so the driver gets each byte of the filter once."""
    keys = keys.select(F.col(col).cast("binary").alias("k")).where("k IS NOT NULL")
    n = keys.count() if n is None else n
    probes, size = shape(n, bits_per_key)

    def own(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            set_bits(bits, b.column(0).to_pylist(), probes)
        for at in range(0, size, block):
            some = bits[at : at + block]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([some.tobytes()], pa.binary())], ["at", "bits"])

    def together(batches):
        held, bits = None, None
        for b in batches:
            for at, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at != held:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["at", "bits"])
                    held, bits = at, np.zeros(len(some), np.uint8)
                bits |= np.frombuffer(some, np.uint8)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["at", "bits"])

    rows = keys.mapInArrow(own, "at long, bits binary").repartition("at").sortWithinPartitions("at").mapInArrow(together, "at long, bits binary")
    bits = bytearray(size)
    for at, some in rows.toLocalIterator():
        bits[at : at + len(some)] = some
    return probes, bytes(bits)


def build_each(rows: DataFrame, group: str, col: str, bits_per_key: int, sizes: dict[int, int]) -> DataFrame:
    """(group, probes, bits): a filter for each group (a long) of rows, of the keys in a column of bytes; sizes has their
    numbers of keys. A task holds one group's filter at a time."""

    def run(batches):
        at, probes, bits = None, 0, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([probes], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["group", "probes", "bits"])

        for b in batches:
            numbers = b.column(0).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for i, j in zip(borders, borders[1:], strict=False):
                if i == j:
                    continue
                if numbers[i] != at:
                    if at is not None:
                        yield row()
                    at = int(numbers[i])
                    probes, size = shape(sizes[at], bits_per_key)
                    bits = np.zeros(size, np.uint8)
                set_bits(bits, b.column(1)[i:j].to_pylist(), probes)
        if at is not None:
            yield row()

    some = rows.select(F.col(group).cast("long").alias("group"), F.col(col).cast("binary").alias("k")).where("k IS NOT NULL").where(F.col("group").isin([int(g) for g in sizes]) if len(sizes) < 1000 else F.lit(True))
    return some.repartition("group").sortWithinPartitions("group").mapInArrow(run, "group long, probes int, bits binary")


def probe(rows: DataFrame, col: str, probes: int, bits: bytes) -> DataFrame:
    """The rows whose key may be in the filter."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_hold(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series(False, index=keys.index)
        out[known] = likely([bytes(k) for k in keys[known]], probes, held.value)
        return out

    return rows.where(may_hold(F.col(col).cast("binary")))


def semi_join(rows: DataFrame, col: str, keys: DataFrame, key_col: str, bits_per_key: int = 10) -> DataFrame:
    """The rows whose key is among keys, exactly. The filter, if it is small enough to broadcast, spares the others the shuffle."""
    named = keys.select(F.col(key_col).alias(col)).distinct()
    n = named.count()
    if shape(n, bits_per_key)[1] <= BROADCAST_BYTES:
        rows = probe(rows, col, *build(named, col, bits_per_key, n))
    return rows.join(named, col, "left_semi")


@F.pandas_udf(LongType())
def bloom_hash_of(keys: pd.Series) -> pd.Series:
    """The hashes of keys as a column function."""
    known = keys.notna()
    out = pd.Series(None, index=keys.index, dtype="Int64")
    if known.any():
        out[known] = bloom_hash([bytes(k) for k in keys[known]]).astype(np.int64)
    return out
