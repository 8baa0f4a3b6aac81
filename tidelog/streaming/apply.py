"""The log as a stream: appended batch by batch, and resolved as it comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_batches(writes: DataFrame, log_dir: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of (lsn, key, op, val) to a log, a folder for each batch.

    A batch that is replayed after a failure overwrites its own folder, so no record comes twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["lsn"]).write.mode("overwrite").parquet(f"{log_dir}/batch={number:012d}")

    return writes.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(append).start()


def fold(writes: DataFrame, machine: Callable, start, key: str, op: str, state: str) -> DataFrame:
    """A user's state machine over a stream of (lsn, key, op): state = machine(state, op, lsn), in order of LSN in each batch.

    key, op and state are SQL types. Gives (key, lsn, state) for each key of each batch; a record at or below the last LSN
    that its key has seen is a replay and ignored.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen, value = held.get if held.exists else (0, start)
        for lsn, o in sorted((x for f in frames for x in zip(f["lsn"], f["op"], strict=True)), key=lambda x: x[0]):
            if lsn > seen:
                seen, value = int(lsn), machine(value, o, int(lsn))
        held.update((seen, value))
        yield pd.DataFrame({"key": [k[0]], "lsn": [seen], "state": [value]})

    return writes.groupBy("key").applyInPandasWithState(step, f"key {key}, lsn long, state {state}", f"lsn long, state {state}", "update", GroupStateTimeout.NoTimeout)


def latest(writes: DataFrame) -> DataFrame:
    """(key, lsn, alive, val) of a stream, in update mode, by a built-in aggregate: no Python and one row of state per key."""
    newest = writes.groupBy("key").agg(F.max("lsn").alias("lsn"), F.max_by(F.col("op") == "P", "lsn").alias("alive"), F.max_by("val", "lsn").alias("val"))
    return newest
