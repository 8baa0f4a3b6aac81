import random

import pytest

from tidelog.functions import bloom, codec
from tidelog.operators import blocks

KIND = "run long, key binary, lsn long, val binary"


def some_rows(n=400):
    rnd = random.Random(2)
    return [(i % 3, bytearray(rnd.choice((b"", b"a", b"common/")) + bytes(rnd.choices(b"abc\xff", k=rnd.randrange(6)))), i, bytearray(bytes(rnd.choices(b"xyz", k=rnd.choice((0, 3, 200)))))) for i in range(n)]


def test_round_trip_and_ranges(spark):
    rows = some_rows()
    held = blocks.encode(spark.createDataFrame(rows, KIND), "run", "key", "lsn", "val", 300, 3).cache()
    want = sorted((r, bytes(k), -n, bytes(v)) for r, k, n, v in rows)
    read = lambda *bounds: [(r["run"], bytes(r["key"]), -r["lsn"], bytes(r["val"])) for r in blocks.decode(held, *bounds).orderBy("run", "block_id", "offset").collect()]
    assert read() == want
    keys = sorted({k for _, k, _, _ in want})
    for low, high in ((keys[0], keys[-1]), (keys[5], keys[20]), (b"b", b"common/"), (b"zz", b"\xff\xff\xff\xff\xff\xff\xff"), (None, keys[9]), (keys[9], None)):
        assert read(low, high) == [x for x in want if (low is None or x[1] >= low) and (high is None or x[1] <= high)]
    for b in held.collect():
        # All blocks but a run's last reach the limit with their last record, restarts stand at every fourth.
        places = [(at, shared) for at, shared, *_ in blocks.read_block(bytes(b["data"]))]
        assert [at for at, _ in places[::4]] == b["restarts"] and all(shared == 0 for _, shared in places[::4])
        assert places[-1][0] < 300
        assert bloom.likely([k for _, _, k, _, _ in blocks.read_block(bytes(b["data"]))], b["probes"], bytes(b["bloom"])).all()


def test_broken_blocks_say_so():
    for data in (b"\x80", b"\x05\x08\x00" + b"x" * 8, b"\x00\x20\x00abc", b"\x00\x02\x00ab", b"\xff" * 6):
        with pytest.raises(blocks.Corrupted):
            list(blocks.read_block(data))
    assert blocks.split_key(blocks.internal_key(b"k", 1 << 40)) == (b"k", 1 << 40)
    with pytest.raises(blocks.Corrupted):
        blocks.split_key(b"short")


def test_broken_writes_say_so():
    assert codec.read_op(b"\x01\x01k\x00") == ("P", b"k", b"") and codec.read_op(b"\x02\x00") == ("D", b"", None)
    for data in (b"", b"\x03\x00", b"\x01\x05k", b"\x02\x01kx", b"\x01\x01k", b"\x02\xff"):
        with pytest.raises(codec.Corrupted):
            codec.read_op(data)


def test_filters_built_in_blocks_and_groups(spark):
    keys = [(i % 3, f"key{i}".encode()) for i in range(500)]
    table = spark.createDataFrame([(g, bytearray(k)) for g, k in keys], "g long, k binary").repartition(5)
    assert bloom.build(table, "k", 7, block=16) == bloom.build_local([k for _, k in keys], 7)
    sizes = {g: sum(x == g for x, _ in keys) for g in range(3)}
    got = {r["group"]: (r["probes"], bytes(r["bits"])) for r in bloom.build_each(table, "g", "k", 7, sizes).collect()}
    assert got == {g: bloom.build_local([k for x, k in keys if x == g], 7) for g in range(3)}
    assert bloom.build(table.limit(0), "k", 7) == bloom.build_local([], 7)
