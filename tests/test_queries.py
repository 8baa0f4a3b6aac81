import pytest

from tidelog.plans import more_queries  # noqa: F401
from tidelog.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, against_sql):
    against_sql(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_other_queries_stay_where_an_import_fails(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tidelog.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_crc_of_known_values(spark, sf_dir):
    from pyspark.sql import functions as F

    from tidelog.operators import wal

    row = spark.createDataFrame([(bytearray(b"123456789"),)], "p binary").select(F.crc32("p").alias("crc"), wal.frame(F.col("p")).alias("f")).first()
    assert row["crc"] == 0xCBF43926
    assert bytes(row["f"]) == b"\xef\x00\x09\x00\x00\x00123456789" + (0xCBF43926).to_bytes(4, "little")
    assert QUERIES["wal_crc"](spark, sf_dir).where("NOT is_intact").count() == 0
