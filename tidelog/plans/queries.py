"""The key-value engine's operators as queries over the whole tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import bloom, varint
from tidelog.operators import cas, kv, manifest, runs, wal
from tidelog.plans.changelog import UNBOUNDED, events_log, excluded, history, included, resolve, table

#: Keys and LSNs that the queries name.
LOW, HIGH, LIVE_TOP, SNAPSHOT = 11, 20, 9, 5000
RUN, SEGMENT = 500, 700

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_SQL = "log AS (SELECT event_id + 1 AS lsn, user_id AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, CASE WHEN event_type <> 'error' THEN value END AS val FROM events)"


def state_sql(where: str = "true", name: str = "state") -> str:
    return f"{name} AS (SELECT key, lsn, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM log WHERE {where}) WHERE r = 1 AND op = 'P')"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def state_query(name: str, f: Callable[[DataFrame], DataFrame], where: str = "true", then: str = "SELECT key, val FROM state") -> None:
    query(f"WITH {LOG_SQL}, {state_sql(where)} {then}", name)(lambda spark, sf_dir: f(events_log(spark, sf_dir)))


state_query("kv_scan", lambda log: resolve(log), then="SELECT key, lsn, val FROM state")
state_query("kv_get", lambda log: kv.get(log, LOW).select("key", "val"), f"key = {LOW}")
state_query("kv_snapshot_scan", lambda log: resolve(log, SNAPSHOT), f"lsn <= {SNAPSHOT}", "SELECT key, lsn, val FROM state")
state_query("kv_snapshot_get", lambda log: kv.get(log, LOW, SNAPSHOT).select("key", "val"), f"lsn <= {SNAPSHOT} AND key = {LOW}")
state_query("kv_range_reverse_topk", lambda log: kv.range_scan(log, reverse=True, limit=10).select("key", "val"), then="SELECT key, val FROM state ORDER BY key DESC LIMIT 10")
state_query("kv_last", lambda log: kv.last(log), then="SELECT key, val FROM state ORDER BY key DESC LIMIT 1")
state_query("kv_count", lambda log: resolve(log).agg(F.count("*").alias("n")), then="SELECT count(*) AS n FROM state")
state_query("kv_range_snapshot", lambda log: kv.range_scan(log, included(LOW), UNBOUNDED, SNAPSHOT).select("key", "val"), f"lsn <= {SNAPSHOT} AND key >= {LOW}")
for _name, _low, _high, _where in (
    ("ii", included(LOW), included(HIGH), f"key >= {LOW} AND key <= {HIGH}"),
    ("ie", included(LOW), excluded(HIGH), f"key >= {LOW} AND key < {HIGH}"),
    ("ei", excluded(LOW), included(HIGH), f"key > {LOW} AND key <= {HIGH}"),
    ("ee", excluded(LOW), excluded(HIGH), f"key > {LOW} AND key < {HIGH}"),
    ("iu", included(LOW), UNBOUNDED, f"key >= {LOW}"),
    ("eu", excluded(LOW), UNBOUNDED, f"key > {LOW}"),
    ("ui", UNBOUNDED, included(LIVE_TOP), f"key <= {LIVE_TOP}"),
    ("ue", UNBOUNDED, excluded(LIVE_TOP), f"key < {LIVE_TOP}"),
    ("uu", UNBOUNDED, UNBOUNDED, "true"),
):
    state_query(f"kv_range_{_name}", lambda log, low=_low, high=_high: kv.range_scan(log, low, high).select("key", "val"), _where)


@query(f"WITH {LOG_SQL}, {state_sql()}, p AS (SELECT DISTINCT user_id + 100 AS key FROM events) SELECT p.key, val, state.key IS NOT NULL AS found FROM p LEFT JOIN state ON p.key = state.key")
def kv_multi_get(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select((F.col("user_id") + 100).alias("key")).distinct()
    return kv.multi_get(events_log(spark, sf_dir), probes)


@query(f"WITH {LOG_SQL} SELECT lsn, key, op, val, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS version_rank FROM log")
def kv_history(spark, sf_dir):
    return history(events_log(spark, sf_dir))


def cas_log(spark, sf_dir):
    """Operations from the events' numbers k: expected k % 3 and new k % 4, each absent where that is 0."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    absent = lambda n: F.when(k % n != 0, k % n)
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("key"), absent(3).alias("cur"), absent(4).alias("new"))


@query("""
WITH RECURSIVE e AS (SELECT event_id + 1 AS lsn, user_id AS key, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
o AS (SELECT lsn, key, CASE WHEN k % 3 <> 0 THEN k % 3 END AS cur, CASE WHEN k % 4 <> 0 THEN k % 4 END AS new, row_number() OVER (PARTITION BY key ORDER BY lsn) AS i FROM e),
f AS (SELECT key, i, lsn, CAST(NULL AS BIGINT) IS NOT DISTINCT FROM cur AS succeeded, CAST(NULL AS BIGINT) AS cur_value, CASE WHEN cur IS NULL THEN new END AS state FROM o WHERE i = 1
UNION ALL
SELECT o.key, o.i, o.lsn, f.state IS NOT DISTINCT FROM o.cur, CASE WHEN f.state IS DISTINCT FROM o.cur THEN f.state END, CASE WHEN f.state IS NOT DISTINCT FROM o.cur THEN o.new ELSE f.state END
FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
SELECT lsn, key, succeeded, cur_value FROM f
""")
def kv_cas(spark, sf_dir):
    return cas.compare_and_swap(cas_log(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT * FROM log WHERE lsn >= 9000")
def wal_replay_from(spark, sf_dir):
    return wal.replay_from(events_log(spark, sf_dir), 9000)


@query(f"WITH {LOG_SQL}, {state_sql()} SELECT key, lsn, val FROM state")
def wal_recover(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return wal.recover(resolve(log, SNAPSHOT), log, SNAPSHOT)


def corrupt_log(spark, sf_dir):
    """Segments of 1000 records; an error whose number ends in 77 is corrupt."""
    bad = (F.col("event_type") == "error") & F.col("props").endswith("77}")
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), F.floor(F.col("event_id") / 1000).alias("seg"), bad.alias("is_bad"))


CORRUPT_SQL = "c AS (SELECT event_id + 1 AS lsn, event_id // 1000 AS seg, event_type = 'error' AND props LIKE '%77}' AS bad FROM events)"


@query(f"WITH {CORRUPT_SQL}, m AS (SELECT *, max(bad::INT) OVER (PARTITION BY seg ORDER BY lsn) AS b FROM c) SELECT lsn, seg FROM m WHERE b = 0")
def wal_read_prefix(spark, sf_dir):
    return wal.readable(corrupt_log(spark, sf_dir), F.col("is_bad"), "per_segment").select("lsn", "seg")


@query(f"WITH {CORRUPT_SQL}, m AS (SELECT *, max(bad::INT) OVER (ORDER BY lsn) AS b FROM c) SELECT lsn, seg FROM m WHERE b = 0")
def wal_read_prefix_global(spark, sf_dir):
    return wal.readable(corrupt_log(spark, sf_dir), F.col("is_bad"), "global").select("lsn", "seg")


@query(f"WITH s AS (SELECT DISTINCT (event_id // {SEGMENT}) * {SEGMENT} + 1 AS start FROM events) SELECT start FROM s WHERE start > {SNAPSHOT} OR start = (SELECT max(start) FROM s WHERE start <= {SNAPSHOT})")
def wal_discard(spark, sf_dir):
    starts = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / SEGMENT) * SEGMENT + 1).alias("start")).distinct()
    return wal.kept_segments(starts, SNAPSHOT)


@query(
    f"""WITH s AS (SELECT event_id + 1 AS lsn, event_id // {SEGMENT} AS seg, 10 + strlen(props) AS record_bytes FROM events)
    SELECT lsn, seg, record_bytes, CAST(coalesce(sum(record_bytes) OVER (PARTITION BY seg ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM s"""
)
def wal_record_size(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), F.floor(F.col("event_id") / SEGMENT).alias("seg"), "props")
    return wal.record_sizes(rows, F.col("props")).drop("props")


@query(f"SELECT event_id // {SEGMENT} AS seg, min(event_id) + 1 AS start, max(event_id) + 1 AS last, CAST(sum(10 + strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def wal_segments(spark, sf_dir):
    """The segments with their first and last LSN and their framed size."""
    return wal_record_size(spark, sf_dir).groupBy("seg").agg(F.min("lsn").alias("start"), F.max("lsn").alias("last"), F.sum("record_bytes").alias("bytes"))


@query()
def wal_crc(spark, sf_dir):
    """Records with their checksums; the SQL, which folds bytes by a table, is beside the other queries of bytes."""
    payload = F.col("props").cast("binary")
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), F.crc32(payload).alias("crc"), F.hex(wal.frame(payload)).alias("record"), wal.intact(wal.frame(payload)).alias("is_intact"))


def lsn_runs(spark, sf_dir):
    """Runs of 500 LSNs each, as flushes of the log make them."""
    chunk = F.floor((F.col("lsn") - 1) / RUN)
    return manifest.manifest(events_log(spark, sf_dir), chunk, F.col("sst_id") % 6)


MANIFEST_SQL = f"m AS (SELECT (lsn - 1) // {RUN} AS sst_id, ((lsn - 1) // {RUN}) % 6 AS level, min(lsn) AS lsn_lo, max(lsn) AS lsn_hi, min(key) AS key_lo, max(key) AS key_hi, count(*) AS n FROM log GROUP BY ALL)"


@query(f"WITH {LOG_SQL}, {MANIFEST_SQL} SELECT * FROM m")
def sst_manifest(spark, sf_dir):
    return lsn_runs(spark, sf_dir)


@query(f"WITH {LOG_SQL}, {MANIFEST_SQL} SELECT * FROM m WHERE lsn_lo <= 2600 AND lsn_hi >= 1200")
def sst_prune_lsn(spark, sf_dir):
    return manifest.overlapping(lsn_runs(spark, sf_dir), 1200, 2600, "lsn")


@query(
    f"""WITH {LOG_SQL}, m AS (SELECT key // 8 AS sst_id, 5 AS level, min(lsn) AS lsn_lo, max(lsn) AS lsn_hi, min(key) AS key_lo, max(key) AS key_hi, count(*) AS n FROM log GROUP BY 1)
    SELECT sst_id, level, lsn_lo, lsn_hi, key_lo, key_hi, n FROM m WHERE key_lo <= 60 AND key_hi >= 40"""
)
def sst_prune_key(spark, sf_dir):
    """Runs of key ranges, as compaction makes them."""
    return manifest.overlapping(manifest.manifest(events_log(spark, sf_dir), F.floor(F.col("key") / 8), F.lit(5)), 40, 60)


@query(
    f"""WITH {LOG_SQL}, {MANIFEST_SQL}, g AS (SELECT level, count(*) AS n_runs, string_agg(CAST(sst_id AS VARCHAR), ',' ORDER BY key_lo, sst_id) AS sst_ids FROM m GROUP BY 1)
    SELECT l.level, coalesce(n_runs, 0) AS n_runs, sst_ids FROM (SELECT unnest(range(6)) AS level) l LEFT JOIN g ON l.level = g.level"""
)
def sst_levels(spark, sf_dir):
    return manifest.levels(lsn_runs(spark, sf_dir))


@query("WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 0 AND 150) SELECT id AS sst_id FROM a WHERE id NOT IN (SELECT c_custkey - 10 FROM customer WHERE c_custkey BETWEEN 10 AND 150)")
def version_live(spark, sf_dir):
    """Edit n, for each customer's number, adds run n and deletes run n - 10; the runs of version 150."""
    n = F.col("c_custkey")
    edits = table(spark, sf_dir, "customer").select(n.alias("version"), F.array(n).alias("sst_add"), F.when(n >= 10, F.array(n - 10)).alias("sst_del"))
    return manifest.live_at(edits, 150)


PART_RUN = 5000


def part_runs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / PART_RUN).alias("run"))


@query(
    f"""WITH l AS (SELECT p_partkey, p_name, p_partkey // {PART_RUN} AS run, coalesce(lag(p_name) OVER (PARTITION BY p_partkey // {PART_RUN} ORDER BY p_name, p_partkey), '') AS b FROM part),
    s AS (SELECT *, CAST(coalesce(list_max(list_filter(range(1, least(length(p_name), length(b)) + 1), lambda i: p_name[1:i] = b[1:i])), 0) AS BIGINT) AS shared_len FROM l)
    SELECT p_partkey, p_name, run, shared_len, substring(p_name, CAST(shared_len AS INT) + 1) AS delta FROM s"""
)
def sst_prefix_delta(spark, sf_dir):
    return runs.prefix_delta(part_runs(spark, sf_dir), "run", "p_name", "p_partkey")


@query(f"SELECT p_partkey, p_name, p_partkey // {PART_RUN} AS run, (row_number() OVER (PARTITION BY p_partkey // {PART_RUN} ORDER BY p_name, p_partkey) - 1) % 17 = 0 AS is_restart FROM part")
def sst_restarts(spark, sf_dir):
    return runs.restarts(part_runs(spark, sf_dir), "run", "p_name", "p_partkey")


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id // {RUN} AS run, event_id + 1 AS lsn, event_id % {RUN} + 1 AS i, 20 + strlen(props) AS size FROM events),
    f AS (SELECT run, lsn, i, 0::BIGINT AS block_id, size AS held FROM e WHERE i = 1
    UNION ALL
    SELECT e.run, e.lsn, e.i, CASE WHEN f.held >= 400 THEN f.block_id + 1 ELSE f.block_id END, CASE WHEN f.held >= 400 THEN e.size ELSE f.held + e.size END FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1)
    SELECT run, lsn, block_id FROM f"""
)
def sst_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / RUN).alias("run"), (F.col("event_id") + 1).alias("lsn"), (F.octet_length("props") + 20).alias("size"))
    return runs.blocks(rows, "run", "lsn", "size", 400)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def bloom_semi(spark, sf_dir):
    """Orders of every third customer: filtered by their keys' bloom filter, then joined."""
    keys = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("k"))
    return bloom.semi_join(orders, "k", keys, "k", 5).drop("k")


@query(
    """SELECT o_orderkey, o_orderkey * 977 AS n, CASE WHEN o_orderkey * 977 < 128 THEN 1 WHEN o_orderkey * 977 < 16384 THEN 2 WHEN o_orderkey * 977 < 2097152 THEN 3 WHEN o_orderkey * 977 < 268435456 THEN 4 ELSE 5 END AS n_bytes,
    CAST(o_orderkey * 977 AS BIGINT) AS decoded FROM orders"""
)
def varint_size(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 977).alias("n"))
    return rows.withColumn("n_bytes", varint.varint_size(F.col("n"))).withColumn("decoded", varint.varint_decode(varint.varint_encode(F.col("n"))))
