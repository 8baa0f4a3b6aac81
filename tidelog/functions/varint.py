"""Variable-length integers: seven bits a byte, the lowest first, the high bit on all bytes but the last."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Seven bits a byte, five bytes for 32 bits.
BITS, MOST_BYTES = 7, 5


def varint_size(n: Column) -> Column:
    """Bytes of a number below 2**32; null for what has no encoding."""
    size = F.lit(None).cast("int")
    for i in range(MOST_BYTES, 0, -1):
        size = F.when(n < 1 << min(32, BITS * i), i).otherwise(size)
    return F.when(n >= 0, size)


def varint_encode(n: Column) -> Column:
    """The bytes; null for what has no encoding."""
    size = varint_size(n)
    parts = []
    for i in range(MOST_BYTES):
        low = F.shiftright(n.cast("long"), BITS * i).bitwiseAND(127)
        more = F.when(size > i + 1, 128).otherwise(0)
        parts.append(F.when(size > i, F.lpad(F.hex((low + more).cast("long")), 2, "0")).otherwise(""))
    return F.when(size.isNotNull(), F.unhex(F.concat(*parts)))


def varint_bytes(n: int) -> bytes:
    """The bytes of a number from 0 on, of any size."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= BITS
    return bytes((*out, n))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number that begins at a place of some bytes, and the place after it."""
    n = 0
    for i, byte in enumerate(data[at : at + MOST_BYTES]):
        n |= (byte & 127) << BITS * i
        if byte < 128:
            return n, at + i + 1
    raise ValueError("corrupted varint")


@F.pandas_udf(LongType())
def varint_decode(data: pd.Series) -> pd.Series:
    """The number that begins the bytes; an error if they end before it does, or if it has more than five bytes."""

    def one(b):
        if b is None:
            return None
        n = 0
        for i, byte in enumerate(b):
            if i == MOST_BYTES:
                break
            n |= (byte & 127) << BITS * i
            if byte < 128:
                return n
        raise ValueError("corrupted varint")

    return data.map(one).astype("Int64")
