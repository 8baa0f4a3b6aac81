"""What the operators share: the shared folder, staged tables and exact order statistics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidelog"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there: a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    rows._staged_at = path
    return rows


def discard(*tables: DataFrame) -> None:
    """Deletes what staged() wrote for tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes that a Python worker gets at a time. Spark's defaults are for narrow rows; these hold whole texts.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of ARROW_ROWS rows and about ARROW_BYTES at most.

    The plan reads these settings when it runs, so they stay set in the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(run, schema)


def with_id(docs: DataFrame, id_col: str, more: str) -> StructType:
    """The schema of a function's rows: the id as it is in docs (a struct of other columns, say), then more."""
    return StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(more).fields])


#: Keys of kth_largest lie within 48 bits and are found 16 bits at a time, so that the driver sees 65536 counts at most.
KEY_BITS, LEVEL_BITS = 48, 16


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a long column within +-2**47, exactly; None if there are fewer rows or k < 1.

    Each round counts the rows by the next 16 bits of the key and goes into the one bucket that holds the k-th.
    """
    if k < 1:
        return None
    shifted, prefix, left = F.col(key) + F.lit(1 << (KEY_BITS - 1)), 0, k
    for done in range(0, KEY_BITS, LEVEL_BITS):
        rest = KEY_BITS - done - LEVEL_BITS
        rows = df.where(F.shiftright(shifted, rest + LEVEL_BITS) == prefix) if done else df
        counts = rows.groupBy(F.shiftright(shifted, rest).alias("bucket")).count().collect()
        for bucket, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if left <= n:
                prefix = bucket
                break
            left -= n
        else:
            return None
    return prefix - (1 << (KEY_BITS - 1))
