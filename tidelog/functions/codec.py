"""Writes as bytes: a tag, the size and bytes of the key, and of a put those of the value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tidelog.functions.varint import read_varint, varint_encode

#: Fixed values of the format: the tags of a put and a delete.
TAGS = {"P": 1, "D": 2}


class Corrupted(ValueError):
    """Bytes that aren't a write."""


def encode_op(op: Column, key: Column, val: Column) -> Column:
    """The bytes of a write; null if its key is, or a put's value."""
    sized = lambda c: F.concat(varint_encode(F.octet_length(c)), c)
    tag = lambda name: F.unhex(F.lit(f"{TAGS[name]:02X}"))
    return F.when(op == "P", F.concat(tag("P"), sized(key), sized(val))).when(op == "D", F.concat(tag("D"), sized(key)))


def read_op(data: bytes) -> tuple[str, bytes, bytes | None]:
    try:
        op = {tag: name for name, tag in TAGS.items()}[data[0]]
        parts, at = [], 1
        for _ in range(2 if op == "P" else 1):
            n, at = read_varint(data, at)
            parts.append(data[at : at + n])
            at += n
        if at != len(data):
            raise ValueError("it isn't as long as it says")
    except (KeyError, IndexError, ValueError) as e:
        raise Corrupted(f"no write: {data[:20]!r}") from e
    return op, parts[0], parts[1] if op == "P" else None


@F.pandas_udf(StructType([StructField("op", StringType()), StructField("key", BinaryType()), StructField("val", BinaryType())]))
def decode_op(data: pd.Series) -> pd.DataFrame:
    """The write that some bytes are; an error for bytes that aren't one."""
    rows = [(None, None, None) if b is None else read_op(bytes(b)) for b in data]
    return pd.DataFrame(rows, columns=["op", "key", "val"])
