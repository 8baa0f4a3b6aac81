import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import bloom, varint


def test_hash_vectors():
    want = {b"": 0x0BC9F1D3, b"a": 0x4E6FC53D, b"abc": 0xF3D12C62, b"abcd": 0x9F900990, b"test11": 0x8785F3E2, b"test12": 0x2C2D8649}
    assert bloom.bloom_hash(list(want)).tolist() == list(want.values())
    for k, h in want.items():
        assert bloom.bloom_hash([k]).tolist() == [h]


def test_filter_vector():
    assert bloom.build_local([b"test11", b"test12"], 5) == (3, bytes.fromhex("0002008054002000"))


@given(st.lists(st.binary(max_size=20), max_size=50), st.integers(1, 20))
def test_no_false_negative(keys, bits):
    assert bloom.likely(keys, *bloom.build_local(keys, bits)).all()


def test_false_positives():
    """The expected rate is 0.092 with a spread of 0.0065 for 2000 probes, so the bound of 0.1 is for the mean of many."""
    rnd, rates = random.Random(3), []
    for _ in range(20):
        words = list(dict.fromkeys("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(1, 100))).encode() for _ in range(4000)))[:3000]
        probes, bits = bloom.build_local(words[:1000], 5)
        assert bloom.likely(words[:1000], probes, bits).all()
        rates.append(bloom.likely(words[1000:], probes, bits).mean())
    assert sum(rates) / len(rates) < 0.1


def test_built_in_parts_is_the_same(spark):
    keys = [str(i).encode() for i in range(500)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").repartition(5)
    assert bloom.build(df, "k", 5) == bloom.build_local(keys, 5)
    assert bloom.build(df.limit(0), "k", 5) == bloom.build_local([], 5)


def test_semi_join_is_exact_with_nulls(spark):
    rows = spark.createDataFrame([("1",), ("2",), (None,), ("1",)], "k string")
    keys = spark.createDataFrame([("1",), (None,), ("9",)], "k string")
    assert [r[0] for r in bloom.semi_join(rows, "k", keys, "k").collect()] == ["1", "1"]


def test_varint(spark):
    rnd = random.Random(4)
    some = [0, 60, 127, 128, 130, 16383, 16384, 17000, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 32) - 1] + [rnd.randrange(1 << 32) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in some], "n long")
    e = varint.varint_encode(F.col("n"))
    rows = df.select("n", e.alias("e"), varint.varint_size(F.col("n")).alias("size"), varint.varint_decode(e).alias("d")).collect()
    assert all(r["n"] == r["d"] and len(r["e"]) == r["size"] for r in rows)
    sizes = {r["n"]: r["size"] for r in rows}
    assert [sizes[n] for n in (0, 127, 16383, 17000, (1 << 32) - 1)] == [1, 1, 2, 3, 5]
    none = spark.createDataFrame([(-1,), (1 << 32,), (None,)], "n long").select(varint.varint_encode(F.col("n"))).collect()
    assert [r[0] for r in none] == [None] * 3


def test_corrupt_varint(spark):
    with pytest.raises(Exception, match="corrupted varint"):
        spark.createDataFrame([(bytearray(b"\xff\xff"),)], "e binary").select(varint.varint_decode("e")).collect()
