import math
import zlib
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import cas, kv, manifest, runs, wal
from tidelog.plans.changelog import UNBOUNDED, between, excluded, history, included, resolve

KIND = "lsn long, key binary, op string, val binary"


def log_of(spark, ops):
    return spark.createDataFrame([(i + 1, bytearray(k), "D" if v is None else "P", None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops)], KIND)


def state_of(df):
    return {bytes(r["key"]): bytes(r["val"]) for r in df.collect()}


def test_put_then_delete_and_the_older_snapshot(spark):
    log = log_of(spark, [(b"test", b"Hello world!"), (b"test", None)])
    assert state_of(resolve(log)) == {}
    assert state_of(resolve(log, 1)) == {b"test": b"Hello world!"}


def test_half_open_range(spark):
    log = log_of(spark, [(b"test1", b"1"), (b"test2", b"2")])
    assert state_of(kv.range_scan(log, included(bytearray(b"test0")), excluded(bytearray(b"test2")))) == {b"test1": b"1"}


def test_empty_values_are_there_and_bytes_are_unsigned(spark):
    log = log_of(spark, [(b"\xff", b"a"), (b"\x7f\x00", b"b"), (b"\x7f", b""), (b"", b"c"), (b"\x80", b"d")])
    rows = kv.range_scan(log).collect()
    assert [bytes(r["key"]) for r in rows] == [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    assert state_of(kv.get(log, bytearray(b"\x7f"))) == {b"\x7f": b""}
    assert bytes(kv.last(log).first()["key"]) == b"\xff"
    assert [bytes(r["key"]) for r in kv.range_scan(log, reverse=True, limit=2).collect()] == [b"\xff", b"\x80"]


def test_ranges_that_are_none(spark):
    log = log_of(spark, [(b"a", b"1")])
    with pytest.raises(ValueError):
        between(log, included(b"b"), included(b"a"))
    with pytest.raises(ValueError):
        between(log, excluded(b"a"), excluded(b"a"))
    assert kv.range_scan(log, included(bytearray(b"a")), excluded(bytearray(b"a"))).count() == 0
    assert kv.last(log.limit(0)).count() == 0


def test_against_a_dict(spark):
    rnd = random.Random(1)
    keys = [bytes([rnd.randrange(256) for _ in range(rnd.randrange(3))]) for _ in range(12)]
    ops = [(rnd.choice(keys), None if rnd.random() < 0.3 else bytes([rnd.randrange(4)])) for _ in range(150)]
    log = log_of(spark, ops).cache()
    for upto in (0, 40, 150):
        model = {}
        for k, v in ops[:upto]:
            model.pop(k, None) if v is None else model.update({k: v})
        assert state_of(resolve(log, upto)) == model
    a, b = sorted(rnd.sample(sorted(set(keys)), 2))
    for low, above in ((included(bytearray(a)), lambda k: k >= a), (excluded(bytearray(a)), lambda k: k > a), (UNBOUNDED, lambda k: True)):
        for high, below in ((included(bytearray(b)), lambda k: k <= b), (excluded(bytearray(b)), lambda k: k < b), (UNBOUNDED, lambda k: True)):
            rows = kv.range_scan(log, low, high).collect()
            assert [bytes(r["key"]) for r in rows] == sorted(k for k in model if above(k) and below(k))


def test_key_filter_reaches_the_scan_and_hot_keys_shrink_before_the_shuffle(spark, sf_dir):
    from tidelog.plans.changelog import events_log

    plan = kv.get(events_log(spark, sf_dir), 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan
    plan = resolve(events_log(spark, sf_dir), 10)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_history_is_newest_first(spark):
    rows = history(log_of(spark, [(b"a", b"1"), (b"b", b"2"), (b"a", None)])).orderBy("key", "version_rank").collect()
    assert [(bytes(r["key"]), r["lsn"]) for r in rows] == [(b"a", 3), (b"a", 1), (b"b", 2)]


@pytest.mark.parametrize(
    ("actual", "expected", "new", "done", "found", "after"),
    [(1, 1, 2, True, None, 2), (1, 1, None, True, None, None), (1, 2, 3, False, 1, 1), (1, None, 3, False, 1, 1), (None, None, 2, True, None, 2), (None, None, None, True, None, None), (None, 1, 2, False, None, None)],
)
def test_truth_table(spark, actual, expected, new, done, found, after):
    ops = [(1, 7, None, actual), (2, 7, expected, new), (3, 7, 99, 99)]
    rows = {r["lsn"]: r for r in cas.compare_and_swap(spark.createDataFrame(ops, "lsn long, key long, cur long, new long")).collect()}
    assert (rows[2]["succeeded"], rows[2]["cur_value"]) == (done, found)
    assert (rows[3]["succeeded"], rows[3]["cur_value"]) == (False, after)


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_spans_change_nothing(spark, span):
    rnd = random.Random(2)
    some = [None, 1, 2, 3]
    ops = [(i + 1, rnd.randrange(3), rnd.choice(some), rnd.choice(some)) for i in range(120)]
    state, want = {}, []
    for lsn, k, cur, new in ops:
        have = state.get(k)
        want.append((lsn, have == cur, None if have == cur else have))
        if have == cur:
            state[k] = new
    rows = cas.compare_and_swap(spark.createDataFrame(ops, "lsn long, key long, cur long, new long"), span).orderBy("lsn").collect()
    assert [(r["lsn"], r["succeeded"], r["cur_value"]) for r in rows] == want


def test_recovery_needs_the_whole_tail(spark):
    log = log_of(spark, [(b"a", b"1"), (b"b", b"2"), (b"a", None), (b"c", b"3")])
    assert state_of(wal.recover(resolve(log, 2), log, 2)) == state_of(resolve(log))
    wal.assert_contiguous(log, 2)
    with pytest.raises(ValueError):
        wal.assert_contiguous(log.where("lsn != 3"), 2)
    assert [r["lsn"] for r in wal.replay_from(log, 3).orderBy("lsn").collect()] == [3, 4]


def test_discard_keeps_the_segment_that_holds_the_lsn(spark):
    starts = spark.createDataFrame([(1,), (11,), (21,), (31,)], "start long")
    assert sorted(r[0] for r in wal.kept_segments(starts, 25).collect()) == [21, 31]
    assert sorted(r[0] for r in wal.kept_segments(starts, 0).collect()) == [1, 11, 21, 31]


def test_one_flipped_bit_ends_the_segment(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abcdefgh")), (2, bytearray(b"ijklmnop"))], "lsn long, p binary").select("lsn", F.lit(0).alias("seg"), wal.frame(F.col("p")).alias("record"))
    broken = bytearray(rows.collect()[0]["record"])
    broken[7] ^= 1
    rows = spark.createDataFrame([(1, 0, broken), (2, 0, rows.collect()[1]["record"])], "lsn long, seg int, record binary")
    for mode in ("global", "per_segment"):
        assert wal.readable(rows, ~wal.intact(F.col("record")), mode).count() == 0
    with pytest.raises(ValueError):
        wal.readable(rows, F.lit(False), "some")


def test_out_of_order_run(spark):
    good = spark.createDataFrame([(0, 0, b"a", 5), (0, 1, b"a", 3), (0, 2, b"b", 9)], "run int, at int, key binary, lsn long")
    assert runs.check_order(good, "run", "key", "lsn", "at").count() == 3
    bad = spark.createDataFrame([(0, 0, b"hello2", 3), (0, 1, b"hello1", 4)], "run int, at int, key binary, lsn long")
    with pytest.raises(Exception, match="record out of order"):
        runs.check_order(bad, "run", "key", "lsn", "at").collect()


def test_pruning_an_inverted_range_finds_nothing(spark):
    m = spark.createDataFrame([(0, 1, 9)], "sst_id int, key_lo int, key_hi int")
    assert manifest.overlapping(m, 9, 1).count() == 0
    assert manifest.overlapping(m, 9, 12).count() == 1
    edits = spark.createDataFrame([(1, [1], []), (2, [2], [1])], "version long, sst_add array<int>, sst_del array<int>")
    assert [r[0] for r in manifest.live_at(edits, 2).collect()] == [2]
    assert sorted(r[0] for r in manifest.live_in(edits, [1, 2]).collect()) == [1, 2]


def swaps(spark, rows, kind, span=cas.SPAN, key="long"):
    table = spark.createDataFrame(rows, f"lsn long, key {key}, cur {kind}, new {kind}")
    return {r["lsn"]: (r["succeeded"], r["cur_value"]) for r in cas.compare_and_swap(table, span).collect()}


def test_swaps_of_exact_values(spark):
    """Longs that no double holds, NaN, empty bytes, null keys: each is itself, and only null is absent."""
    big = (1 << 53) + 1
    for span in (cas.SPAN, 2):  # all at once, and as a hot key in spans
        got = swaps(spark, [(1, 1, None, big), (2, 1, big - 1, 5), (3, 1, big, None), (4, 1, None, None)], "long", span)
        assert got == {1: (True, None), 2: (False, big), 3: (True, None), 4: (True, None)}
        nan = float("nan")
        got = swaps(spark, [(1, 1, None, nan), (2, 1, None, 1.0), (3, 1, nan, 2.0), (4, 1, nan, 3.0)], "double", span)
        assert got[1][0] and not got[2][0] and math.isnan(got[2][1]) and got[3][0] and got[4] == (False, 2.0)
        got = swaps(spark, [(1, None, None, bytearray(b"")), (2, None, None, bytearray(b"x")), (3, None, bytearray(b""), None), (4, "b", None, bytearray(b"y"))], "binary", span, "string")
        assert got == {1: (True, None), 2: (False, b""), 3: (True, None), 4: (True, None)}


def test_a_hot_key_in_spans_is_as_in_one(spark):
    rnd = random.Random(9)
    value = lambda: rnd.choice([None, *range(4)])
    rows = [(i, rnd.choice([7, 7, 7, i % 9]), value(), value()) for i in range(1, 2000)]
    assert swaps(spark, rows, "long", 50) == swaps(spark, rows, "long")


def test_framed_segments(spark):
    def record(payload):
        return b"\xef\x00" + len(payload).to_bytes(4, "little") + payload + zlib.crc32(payload).to_bytes(4, "little")

    some = [b"", b"a", b"bc" * 500]
    data = b"".join(map(record, some))
    assert wal.read_frames(data) == (some, True)
    for at in range(len(data)):  # a bit that flips, or an end that comes early, ends the reading at its record
        whole = 0 if at < 10 else 1 if at < 21 else 2
        flipped = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        assert wal.read_frames(flipped) == (some[:whole], False)
        found, ok = wal.read_frames(data[:at])
        assert found == some[:whole] and ok == (at in (0, 10, 21))
    table = spark.createDataFrame([(1, bytearray(data)), (4, bytearray(data[:-1])), (7, bytearray(data)), (10, None)], "start long, data binary")
    assert sorted(r["lsn"] for r in wal.decode(table).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["lsn"] for r in wal.decode(table, "per_segment").collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
