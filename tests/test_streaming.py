import time

import pytest

from tidelog.plans.changelog import resolve
from tidelog.streaming import apply
from tidelog.streaming.tasks import BackgroundTask

KIND = "lsn long, key long, op string, val double"
WRITES = [(1, 1, "P", 1.0), (2, 2, "P", 2.0), (3, 1, "D", None), (4, 3, "P", 3.0), (5, 2, "P", 4.0)]


@pytest.fixture
def source(spark, tmp_path):
    for i in range(0, 5, 2):
        spark.createDataFrame(WRITES[i : i + 2], KIND).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.05)
    return lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_appended_log_resolves(spark, source, tmp_path):
    for checkpoint in ("one", "two"):  # all batches again, into the same folders
        q = apply.append_batches(source(), f"file://{tmp_path}/log", f"file://{tmp_path}/{checkpoint}")
        q.awaitTermination()
    log = spark.read.schema(KIND).parquet(f"file://{tmp_path}/log")
    assert log.count() == 5
    assert {r["key"]: r["val"] for r in resolve(log).collect()} == {2: 4.0, 3: 3.0}


def test_latest(spark, source):
    q = apply.latest(source()).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: (r["lsn"], r["alive"], r["val"]) for r in spark.table("latest").collect()} == {1: (3, False, None), 2: (5, True, 4.0), 3: (4, True, 3.0)}


def test_state_machine(spark, source):
    counted = apply.fold(source(), lambda n, op, lsn: n + (1 if op == "P" else -1), 10, "long", "string", "long")
    q = counted.writeStream.outputMode("update").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("counted").orderBy("lsn").collect():
        last[r["key"]] = (r["lsn"], r["state"])
    assert last == {1: (3, 10), 2: (5, 12), 3: (4, 11)}


def test_a_failed_stream_says_so(source):
    def fail(state, op, lsn):
        raise ValueError("no such op")

    q = apply.fold(source(), fail, 0, "long", "string", "long").writeStream.outputMode("update").format("memory").queryName("failed").start()
    with pytest.raises(Exception, match="no such op"):
        q.processAllAvailable()
    assert q.exception() is not None


def until(condition):
    for _ in range(200):
        if condition():
            return True
        time.sleep(0.01)
    return False


def test_task_polls_wakes_and_stops():
    pending, ran = [True], []

    def should_run():
        return True if pending[0] else 30.0

    def run():
        pending[0] = False
        ran.append(1)

    t = BackgroundTask(should_run, run)
    assert until(lambda: len(ran) == 1)
    pending[0] = True
    t.check_should_run()
    assert until(lambda: len(ran) == 2)
    t.stop()
    assert not t.failed


def test_task_gives_its_error():
    def run():
        raise OSError("disk")

    t = BackgroundTask(lambda: True, run)
    assert until(lambda: t.failed)
    with pytest.raises(OSError, match="disk"):
        t.stop()
