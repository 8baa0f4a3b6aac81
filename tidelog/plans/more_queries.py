"""Queries of what the store, its files and its log do: each runs the part itself over a whole table or a script of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import bloom
from tidelog.operators import blocks, runs, wal
from tidelog.plans.changelog import PUT, resolve, table
from tidelog.plans.queries import CORRUPT_SQL, LOG_SQL, ORACLE_SQL, SEGMENT, query
from tidelog.sources.files import scratch
from tidelog.sources.store import Edit, KvStore, Run, StoreError
from tidelog.streaming.apply import append_batches, fold
from tidelog.streaming.tasks import BackgroundTask

BLOCK_LIMIT, INTERVAL, BLOCK_RUN = 300, 4, 500


def key_bytes(n):
    """Numbers as keys whose order as bytes is theirs."""
    return F.encode(F.lpad(n.cast("string"), 8, "0"), "utf-8")


def texts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.decode(c, "utf-8") for c, t in rows.dtypes if t == "binary"})


# Store

STORE_SQL = "SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, props AS val FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events {where}) WHERE r = 1 AND {alive}"


def store_of(spark: SparkSession, sf_dir: str, deletes: bool) -> KvStore:
    """The events' puts (and deletes) in a store: the first half in runs, the rest in the log."""
    gone = F.col("event_type") == "error"
    events = table(spark, sf_dir, "events").select("event_id", F.when(gone, "D").otherwise("P").alias("op"), key_bytes(F.col("user_id")).alias("key"), F.when(~gone, F.encode("props", "utf-8")).alias("val"))
    events = events if deletes else events.where("op = 'P'")
    middle = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    store = KvStore(spark, scratch(spark))
    store.write_all(events.where(F.col("event_id") <= middle), ["event_id"], 8)
    store.compact(4)
    store.write_all(events.where(F.col("event_id") > middle), ["event_id"], 8)
    return store


@query(STORE_SQL.format(where="WHERE event_type <> 'error'", alive="true"))
def store_put(spark, sf_dir):
    """Puts into a store; read from runs and log together."""
    return texts(store_of(spark, sf_dir, False).range())


@query(STORE_SQL.format(where="", alive="event_type <> 'error'"))
def store_delete(spark, sf_dir):
    """The same with deletes, some of missing keys."""
    return texts(store_of(spark, sf_dir, True).range())


@query("SELECT i AS lsn, i - i % 20 + CASE WHEN i % 20 < 8 THEN 0 WHEN i % 20 < 16 THEN 8 ELSE 16 END AS durable FROM (SELECT unnest(range(1, 41)) AS i)")
def store_sync(spark, sf_dir):
    """After each of 40 writes, of which every 20th asks for a sync, the last LSN that is durable: eight may wait."""
    store, out = KvStore(spark, scratch(spark), max_pending=8), []
    for i in range(1, 41):
        lsn = store.put(b"k", str(i).encode(), sync=i % 20 == 0)
        out.append((lsn, lsn - len(store.pending)))
    return spark.createDataFrame(out, "lsn long, durable long")


@query("SELECT i AS lsn, i <= 16 AS found FROM (SELECT unnest(range(1, 21)) AS i)")
def store_lost(spark, sf_dir):
    """Which of 20 writes without a sync a reopened store finds, when eight may wait: the last ones are lost."""
    store, root = KvStore(spark, root := scratch(spark), max_pending=8), root
    for _ in range(20):
        store.put(b"k", b"v", sync=False)
    held = {r[0] for r in KvStore(spark, root).replay(1).select("lsn").collect()}
    return spark.createDataFrame([(i, i in held) for i in range(1, 21)], "lsn long, found boolean")


@query("""
WITH RECURSIVE w AS (SELECT unnest(range(1, 13)) AS i), s AS (SELECT i, 11 + 10 * (i % 3) AS bytes FROM w),
f AS (SELECT i, i AS segment, bytes AS held FROM s WHERE i = 1
UNION ALL SELECT s.i, CASE WHEN f.held >= 50 THEN s.i ELSE f.segment END, CASE WHEN f.held >= 50 THEN s.bytes ELSE f.held + s.bytes END FROM f JOIN s ON s.i = f.i + 1)
SELECT i AS lsn, segment FROM f
""")
def wal_rotate(spark, sf_dir):
    """The segment that each of twelve synced records is in: one is switched at the sync that brings it to 50 bytes."""
    store, out = KvStore(spark, scratch(spark), switch_bytes=50), []
    for i in range(1, 13):
        out.append((store.put(b"k", b"x" * (10 * (i % 3))), store.segments[-1]))
    return spark.createDataFrame(out, "lsn long, segment long")


@query("SELECT * FROM (VALUES (1, 'written'), (2, 'failed'), (3, 'failed')) AS t(step, said)")
def wal_sync_failure(spark, sf_dir):
    """A sync that fails (another writer has the segment) fails the writes after it as well."""
    store, other = KvStore(spark, root := scratch(spark)), KvStore(spark, root)
    other.put(b"a", b"1")
    out = [(1, "written")]
    for step in (2, 3):
        try:
            store.put(b"b", b"2")
            out.append((step, "written"))
        except Exception:  # noqa: BLE001
            out.append((step, "failed"))
    return spark.createDataFrame(out, "step int, said string")


@query("SELECT i AS start FROM (SELECT unnest([21, 31]) AS i)")
def wal_checkpoint(spark, sf_dir):
    """The segments that stay after a checkpoint at LSN 25 of four segments of ten records."""
    store = KvStore(spark, scratch(spark))
    for i in range(4):
        store.write([(bytes([i]), b"v")] * 10)
    store.log_and_apply(Edit(flushed=25))
    store.checkpoint()
    return spark.createDataFrame([(s,) for s in store.segments], "start long")


# Log bytes


@query(f"""
WITH {CORRUPT_SQL}, e AS (SELECT event_id + 1 AS lsn, event_id // {SEGMENT} AS seg, props FROM events), m AS (SELECT lsn, max(bad::INT) OVER (PARTITION BY (lsn - 1) // {SEGMENT} ORDER BY lsn) AS b FROM c)
SELECT seg * {SEGMENT} + 1 AS start, lsn, props AS payload FROM e JOIN m USING (lsn) WHERE b = 0
""")
def wal_decode(spark, sf_dir):
    """The records of framed segments as bytes, of which those of corrupt_log have a wrong checksum, up to the first of these."""
    bad = (F.col("event_type") == "error") & F.col("props").endswith("77}")
    frame = F.hex(wal.frame(F.encode("props", "utf-8")))
    last = F.length(frame)
    flipped = F.concat(F.substring(frame, F.lit(1), last - 1), F.when(F.substring(frame, last, F.lit(1)) == "0", "1").otherwise("0"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.floor(F.col("event_id") / SEGMENT) * SEGMENT + 1).alias("start"), F.when(bad, flipped).otherwise(frame).alias("frame"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "")
    return wal.decode(rows.groupBy("start").agg(F.unhex(whole).alias("data")), "per_segment").withColumn("payload", F.decode("payload", "utf-8"))


#: CRC-32 in SQL: a table of 256 entries by eight steps each, then a fold over a text's bytes.
CRC_SQL = """
WITH RECURSIVE t AS (SELECT i, i AS c, 0 AS n FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM t WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE n = 8),
e AS (SELECT event_id + 1 AS lsn, props, strlen(props) AS n, list_reduce(list_prepend(4294967295, list_transform(range(strlen(props)), lambda i: CAST(ord(props[i + 1]) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])) AS c FROM events, tab),
x AS (SELECT lsn, props, lpad(printf('%X', n), 8, '0') AS n, xor(c, 4294967295) AS crc, lpad(printf('%X', xor(c, 4294967295)), 8, '0') AS h FROM e)
SELECT lsn, crc, 'EF00' || n[7:8] || n[5:6] || n[3:4] || n[1:2] || hex(encode(props)) || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS record, true AS is_intact FROM x
"""

ORACLE_SQL["wal_crc"] = CRC_SQL

# Versions

SCRIPT = 12


def scripted(spark: SparkSession, sf_dir: str) -> tuple[KvStore, list]:
    """A store with edits for the first customers' numbers n: run n is added to level n % 6, run n - 4 deleted."""
    store, seen = KvStore(spark, scratch(spark)), []
    for (n,) in table(spark, sf_dir, "customer").where(f"c_custkey BETWEEN 1 AND {SCRIPT}").select("c_custkey").distinct().orderBy("c_custkey").collect():
        held = {r.id for r in store.version.runs}
        version = store.log_and_apply(Edit([Run(n, n % 6, 10 * n, 10 * n + 9, f"{n:02d}", f"{n + 3:02d}")], [n - 4] if n - 4 in held else []))
        seen.append((version.number, len(version.runs), ",".join(str(i) for i in sorted(r.id for r in version.runs))))
        if n in (6, 8):
            store.pin()
        if n == 9:
            store.checkpoint()
    return store, seen


N_SQL = f"n AS (SELECT DISTINCT c_custkey AS n FROM customer WHERE c_custkey BETWEEN 1 AND {SCRIPT})"


@query(f"WITH {N_SQL} SELECT a.n AS version, count(*) AS n_runs, string_agg(CAST(b.n AS VARCHAR), ',' ORDER BY b.n) AS runs FROM n a JOIN n b ON b.n <= a.n AND b.n > a.n - 4 GROUP BY 1")
def version_edits(spark, sf_dir):
    return spark.createDataFrame(scripted(spark, sf_dir)[1], "version long, n_runs long, runs string")


@query(f"WITH {N_SQL} SELECT n AS run, n % 6 AS level, 10 * n AS lsn_lo, 10 * n + 9 AS lsn_hi FROM n WHERE n > {SCRIPT} - 4")
def version_recover(spark, sf_dir):
    """The runs of a store that is opened again, from its checkpoint and the edits after it."""
    store = KvStore(spark, scripted(spark, sf_dir)[0].files.root)
    return spark.createDataFrame([(r.id, r.level, r.lsn_lo, r.lsn_hi) for r in store.version.runs], "run long, level long, lsn_lo long, lsn_hi long")


@query(f"SELECT * FROM (VALUES (0, '{','.join(map(str, range(3, 13)))}'), (1, '{','.join(map(str, range(3, 13)))}'), (2, '{','.join(map(str, range(5, 13)))}'), (3, '9,10,11,12')) AS t(unpinned, live)")
def version_pins(spark, sf_dir):
    """Live runs while versions 6 (pinned twice) and 8 are unpinned one by one."""
    store, _ = scripted(spark, sf_dir)
    (six, _), (eight, _) = store.pinned[6], store.pinned[8]
    store.pinned[6] = six, 2
    out = [(0, store.live_runs())]
    for i, version in enumerate((six, six, eight)):
        store.unpin(version)
        out.append((i + 1, store.live_runs()))
    return spark.createDataFrame([(i, ",".join(map(str, live))) for i, live in out], "unpinned int, live string")


@query(f"WITH {N_SQL} SELECT l.level, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n), '') AS runs FROM (SELECT unnest(range(6)) AS level) l LEFT JOIN n ON n % 6 = l.level AND n > {SCRIPT} - 4 GROUP BY 1")
def version_levels(spark, sf_dir):
    levels = scripted(spark, sf_dir)[0].levels()
    return spark.createDataFrame([(i, ",".join(str(r.id) for r in some)) for i, some in enumerate(levels)], "level long, runs string")


@query(f"WITH {N_SQL} SELECT max(n) + 1 AS id FROM n")
def version_new_id(spark, sf_dir):
    return spark.createDataFrame([(scripted(spark, sf_dir)[0].new_run_id(),)], "id long")


@query(f"WITH {N_SQL} SELECT n AS edit FROM n WHERE n > 9")
def version_checkpoint(spark, sf_dir):
    """The edits that are kept beside the checkpoint."""
    names = scripted(spark, sf_dir)[0].files.names("versions")
    return spark.createDataFrame([(int(n[2:-5]),) for n in names], "edit long")


@query("SELECT * FROM (VALUES (1, 'not a new run'), (2, 'no such run'), (3, 'no such level'), (4, 'fine')) AS t(step, said)")
def version_validate(spark, sf_dir):
    store, run = KvStore(spark, scratch(spark)), lambda i, level=0: Run(i, level, 1, 2, "00", "ff")
    store.log_and_apply(Edit([run(1)]))
    out = []
    for step, said, edit in ((1, "not a new run", Edit([run(1)])), (2, "no such run", Edit(delete=[7])), (3, "no such level", Edit([run(2, 6)])), (4, "", Edit([run(2)], [1]))):
        try:
            store.log_and_apply(edit)
            said = "fine"
        except StoreError:
            pass
        out.append((step, said))
    return spark.createDataFrame(out, "step int, said string")


@query("SELECT * FROM (VALUES ('flushed', 0, 4, 40), ('compacted', 1, 1, 40), ('collected', 1, 1, 40)) AS t(step, level, n_runs, n_rows)")
def version_compact(spark, sf_dir):
    """Four flushes fill level 0, which is picked and rewritten as one run of level 1; then the old runs are collected."""
    store, out = KvStore(spark, scratch(spark)), []

    def said(step):
        level = next(i for i, some in enumerate(store.levels()) if some)
        files = [f"{store.files.root}/runs/{n}" for n in (store.files.names("runs") if step == "collected" else [r.id for r in store.version.runs])]
        out.append((step, level, len(files), spark.read.parquet(*files).count()))

    for i in range(4):
        store.write([(f"k{j:02d}".encode(), b"v") for j in range(i, 10 + i)])
        store.flush()
    said("flushed")
    store.compact_picked()
    said("compacted")
    store.gc()
    said("collected")
    return spark.createDataFrame(out, "step string, level long, n_runs long, n_rows long")


# Sorted runs: blocks


def part_blocks(spark, sf_dir) -> DataFrame:
    """The parts' names as values by number of supplier-like keys, several versions of each, in blocks."""
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / BLOCK_RUN).alias("run"), key_bytes(F.floor(F.col("p_partkey") / 3)).alias("key"), F.col("p_partkey").alias("lsn"), F.encode("p_name", "utf-8").alias("val"))
    return blocks.encode(rows, "run", "key", "lsn", "val", BLOCK_LIMIT, INTERVAL, 10)


#: Records in the order of their run, with internal keys in hex, then their blocks by an ordered fold.
BLOCKS_SQL = f"""r AS (SELECT p_partkey // {BLOCK_RUN} AS run, lpad(CAST(p_partkey // 3 AS VARCHAR), 8, '0') AS key, p_partkey AS lsn, p_name AS val, lpad(printf('%X', p_partkey), 16, '0') AS h FROM part),
k AS (SELECT run, key, lsn, val, hex(encode(key)) || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS ikey, row_number() OVER (PARTITION BY run ORDER BY key, lsn DESC) AS i FROM r),
b AS (SELECT *, coalesce(lag(ikey) OVER (PARTITION BY run ORDER BY i), '') AS before FROM k),
p AS (SELECT *, CAST(coalesce(list_max(list_filter(range(1, 17), lambda n: ikey[1:2 * n] = before[1:2 * n])), 0) AS BIGINT) AS common FROM b),
f AS (SELECT run, i, 0::BIGINT AS block_id, 0::BIGINT AS place, 0::BIGINT AS shared, 0::BIGINT AS begun, 19 + strlen(val) AS held FROM p WHERE i = 1
UNION ALL
SELECT p.run, p.i, f.block_id + CAST(f.held >= {BLOCK_LIMIT} AS BIGINT), CASE WHEN f.held >= {BLOCK_LIMIT} THEN 0 ELSE f.place + 1 END,
  CASE WHEN f.held >= {BLOCK_LIMIT} OR (f.place + 1) % {INTERVAL + 1} = 0 THEN 0 ELSE p.common END, CASE WHEN f.held >= {BLOCK_LIMIT} THEN 0 ELSE f.held END,
  CASE WHEN f.held >= {BLOCK_LIMIT} THEN 19 + strlen(p.val) ELSE f.held + 19 - CASE WHEN (f.place + 1) % {INTERVAL + 1} = 0 THEN 0 ELSE p.common END + strlen(p.val) END
FROM f JOIN p ON p.run = f.run AND p.i = f.i + 1),
d AS (SELECT p.*, f.block_id, f.place, f.shared, f.begun FROM p JOIN f ON p.run = f.run AND p.i = f.i)"""


@query(f"WITH RECURSIVE {BLOCKS_SQL} SELECT run, block_id, count(*) AS n, min(key) AS key_lo, max(key) AS key_hi, CAST(count(*) FILTER (place % {INTERVAL + 1} = 0) AS BIGINT) AS n_restarts FROM d GROUP BY 1, 2")
def block_index(spark, sf_dir):
    """Each block with its records, first and last key and restart points."""
    return texts(part_blocks(spark, sf_dir).select("run", "block_id", "n", "key_lo", "key_hi", F.size("restarts").cast("long").alias("n_restarts")))


@query(f"""WITH RECURSIVE {BLOCKS_SQL} SELECT run, block_id, string_agg(lpad(printf('%X', shared), 2, '0') || lpad(printf('%X', 16 - shared), 2, '0') || lpad(printf('%X', strlen(val)), 2, '0') || ikey[2 * shared + 1:] || hex(encode(val)), '' ORDER BY i) AS data FROM d GROUP BY 1, 2""")
def block_bytes(spark, sf_dir):
    """The bytes of each block: record layout, prefixes of internal keys and restarts."""
    return part_blocks(spark, sf_dir).select("run", "block_id", F.hex("data").alias("data"))


@query(f"WITH RECURSIVE {BLOCKS_SQL} SELECT run, block_id, place AS position, begun AS \"offset\", shared, key, lsn, val FROM d")
def block_decode(spark, sf_dir):
    """All records, read back from the blocks' bytes."""
    return texts(blocks.decode(part_blocks(spark, sf_dir)))


BLOCK_LOW, BLOCK_HIGH = 40, 90
RANGE_SQL = f"key >= '{BLOCK_LOW:08d}' AND key <= '{BLOCK_HIGH:08d}'"


@query(f"WITH RECURSIVE {BLOCKS_SQL} SELECT run, block_id, key, lsn, val FROM d WHERE {RANGE_SQL}")
def block_scan(spark, sf_dir):
    """A range of keys: blocks pruned, then read from the restart point before the range on."""
    low, high = (f"{n:08d}".encode() for n in (BLOCK_LOW, BLOCK_HIGH))
    return texts(blocks.decode(part_blocks(spark, sf_dir), low, high).select("run", "block_id", "key", "lsn", "val"))


@query(f"WITH RECURSIVE {BLOCKS_SQL} SELECT run, block_id FROM d GROUP BY 1, 2 HAVING max(key) >= '{BLOCK_LOW:08d}' AND min(key) <= '{BLOCK_HIGH:08d}'")
def block_prune(spark, sf_dir):
    low, high = (f"{n:08d}".encode() for n in (BLOCK_LOW, BLOCK_HIGH))
    return blocks.overlapping(part_blocks(spark, sf_dir), low, high).select("run", "block_id")


@query(f"WITH RECURSIVE {BLOCKS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS back FROM d) SELECT run, back, key, lsn FROM o WHERE back <= 10")
def block_scan_back(spark, sf_dir):
    """The last ten records of each run, from the end."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("run").orderBy(F.col("key").desc(), "lsn")).cast("long")
    return texts(blocks.decode(part_blocks(spark, sf_dir)).select("run", back.alias("back"), "key", "lsn").where("back <= 10"))


@query(f"SELECT p_partkey AS lsn, hex(encode(lpad(CAST(p_partkey // 3 AS VARCHAR), 8, '0'))) || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS internal, lpad(CAST(p_partkey // 3 AS VARCHAR), 8, '0') AS key, p_partkey AS back FROM (SELECT *, lpad(printf('%X', p_partkey), 16, '0') AS h FROM part)")
def internal_keys(spark, sf_dir):
    """Keys and LSNs as internal keys, and taken apart again."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lsn"), key_bytes(F.floor(F.col("p_partkey") / 3)).alias("k"))
    rows = rows.withColumn("i", blocks.internal_key_of(F.col("k"), F.col("lsn")))
    n = F.octet_length("i") - blocks.LSN_BYTES
    tail = F.hex(F.substring(F.col("i"), n + 1, F.lit(blocks.LSN_BYTES)))
    back = F.conv(F.concat(*[F.substring(tail, 2 * j - 1, 2) for j in range(blocks.LSN_BYTES, 0, -1)]), 16, 10).cast("long")
    return rows.select("lsn", F.hex("i").alias("internal"), F.decode(F.substring(F.col("i"), F.lit(1), n), "utf-8").alias("key"), back.alias("back"))


@query("SELECT run, key, position, position > 1 AND key <= before AS out_of_order FROM (SELECT *, lag(key) OVER (PARTITION BY run ORDER BY position) AS before FROM (SELECT event_id // 500 AS run, user_id AS key, event_id AS position_, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS position FROM events))")
def sst_order(spark, sf_dir):
    """Which records of runs in the order of events a writer of sorted runs would refuse."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).alias("run"), F.col("user_id").alias("key"), F.lit(0).alias("lsn"), (F.col("event_id") % 500 + 1).alias("position"))
    return runs.order_flags(rows, "run", "key", "lsn", "position").select("run", "key", "position", "out_of_order")


# Bloom filters

#: A filter's hash of an eight-byte key: two words of four bytes, the lowest first. All in unsigned 64 bits.
HASH_SQL = """w AS (SELECT *, list_transform([1, 5], lambda j: CAST(ord(key[j]) + 256 * ord(key[j + 1]) + 65536 * ord(key[j + 2]) + 16777216::BIGINT * ord(key[j + 3]) AS UBIGINT)) AS w FROM keys),
h0 AS (SELECT *, xor(198046163::UBIGINT, (8::UBIGINT * 3332679571::UBIGINT) % 4294967296::UBIGINT) AS h FROM w),
h1 AS (SELECT * REPLACE (((h + w[1]) % 4294967296::UBIGINT * 3332679571::UBIGINT) % 4294967296::UBIGINT AS h) FROM h0), h2 AS (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM h1),
h3 AS (SELECT * REPLACE (((h + w[2]) % 4294967296::UBIGINT * 3332679571::UBIGINT) % 4294967296::UBIGINT AS h) FROM h2), hashed AS (SELECT * EXCLUDE (w) REPLACE (xor(h, h >> 16) AS h) FROM h3)""".replace("198046163", str(bloom.SEED)).replace("3332679571", str(bloom.MULTIPLIER))
CUSTOMER_KEYS_SQL = "keys AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)"
#: Places of a key's bits in a filter of 5 bits a key, three probes: the hash, and steps of itself rotated by 17.
PLACES_SQL = "places AS (SELECT *, ((h + p * ((h >> 17) + (h << 15) % 4294967296::UBIGINT)) % 4294967296::UBIGINT) % (8 * size) AS place FROM hashed, (SELECT unnest(range(3))::UBIGINT AS p), (SELECT (greatest(5 * count(*), 64) + 7) // 8 AS size FROM keys {held}))"


def customer_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", key_bytes(F.col("c_custkey")).alias("k"))


@query(f"WITH {CUSTOMER_KEYS_SQL}, {HASH_SQL} SELECT c_custkey, CAST(h AS BIGINT) AS hash FROM hashed")
def bloom_hash(spark, sf_dir):
    return customer_keys(spark, sf_dir).select("c_custkey", bloom.bloom_hash_of("k").alias("hash"))


@query(f"""WITH {CUSTOMER_KEYS_SQL}, {HASH_SQL}, {PLACES_SQL.format(held="")}, s AS (SELECT any_value(size) AS size FROM places),
y AS (SELECT place // 8 AS at, sum(DISTINCT 1 << CAST(place % 8 AS INT)) AS bits FROM places GROUP BY 1)
SELECT 3 AS probes, string_agg(lpad(printf('%X', CAST(coalesce(bits, 0) AS BIGINT)), 2, '0'), '' ORDER BY i) AS bits FROM (SELECT unnest(range(CAST(size AS BIGINT))) AS i FROM s) LEFT JOIN y ON y.at = i""")
def bloom_build(spark, sf_dir):
    """The filter of all customers' keys, built in parallel."""
    probes, bits = bloom.build(customer_keys(spark, sf_dir), "k", 5)
    return spark.createDataFrame([(probes, bits.hex().upper())], "probes int, bits string")


PROBED_SQL = f"WITH {CUSTOMER_KEYS_SQL}, {HASH_SQL}, {PLACES_SQL.format(held='WHERE c_custkey % 3 = 0')}, held AS (SELECT DISTINCT place FROM places WHERE c_custkey % 3 = 0), probed AS (SELECT c_custkey, count(held.place) = 3 AS likely FROM places LEFT JOIN held USING (place) GROUP BY 1)"


def probed(spark, sf_dir):
    keys = customer_keys(spark, sf_dir)
    return keys, bloom.probe(keys, "k", *bloom.build(keys.where("c_custkey % 3 = 0"), "k", 5))


@query(f"{PROBED_SQL} SELECT c_custkey FROM probed WHERE likely")
def bloom_probe(spark, sf_dir):
    """Customers that the filter of every third one may hold."""
    return probed(spark, sf_dir)[1].select("c_custkey")


@query(f"{PROBED_SQL} SELECT count(*) FILTER (NOT likely AND c_custkey % 3 = 0) AS false_negatives, count(*) FILTER (likely AND c_custkey % 3 <> 0) AS false_positives FROM probed")
def bloom_guarantee(spark, sf_dir):
    """No held key is missed; others pass by chance."""
    keys, likely = probed(spark, sf_dir)
    missed = keys.where("c_custkey % 3 = 0").join(likely, "c_custkey", "left_anti").agg(F.count("*").alias("false_negatives"))
    return missed.crossJoin(likely.where("c_custkey % 3 != 0").agg(F.count("*").alias("false_positives")))


@query(f"WITH RECURSIVE {BLOCKS_SQL}, x AS (SELECT run, block_id, min(key) AS lo, max(key) AS hi FROM d GROUP BY 1, 2), q AS (SELECT DISTINCT run, key FROM r) SELECT q.run, q.key, true AS likely FROM q UNION ALL SELECT DISTINCT run, '99999999', false FROM x")
def block_likely(spark, sf_dir):
    """Whether a run may hold its own keys, and one that is outside of all its blocks."""
    held = part_blocks(spark, sf_dir)
    keys = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / BLOCK_RUN).alias("run"), key_bytes(F.floor(F.col("p_partkey") / 3)).alias("key")).distinct()
    return texts(blocks.likely_contains(held, keys.unionByName(held.select("run", F.encode(F.lit("99999999"), "utf-8").alias("key")).distinct())))


# Streaming and tasks


def event_stream(spark, sf_dir) -> DataFrame:
    gone = F.col("event_type") == "error"
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select((F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("key"), F.when(gone, "D").otherwise(PUT).alias("op"), F.when(~gone, F.col("value")).alias("val"))


@query(f"WITH {LOG_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM log) SELECT key, lsn, val FROM s WHERE r = 1 AND op = 'P'")
def stream_apply(spark, sf_dir):
    """The events as a stream, appended to a log batch by batch, then resolved."""
    root = scratch(spark)
    append_batches(event_stream(spark, sf_dir), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return resolve(spark.read.parquet(f"{root}/log").select("lsn", "key", "op", "val"))


def puts_less_deletes(state, op, lsn):
    return state + (1 if op == "P" else -1)


@query(f"WITH {LOG_SQL} SELECT key, max(lsn) AS lsn, CAST(sum(CASE WHEN op = 'P' THEN 1 ELSE -1 END) AS BIGINT) AS state FROM log GROUP BY 1")
def stream_fold(spark, sf_dir):
    """A state machine of a user's own over the stream: puts less deletes of each key, the last state of each."""
    root = scratch(spark)
    rows = fold(event_stream(spark, sf_dir).select("lsn", "key", "op"), puts_less_deletes, 0, "long", "string", "long")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("key").agg(F.max("lsn").alias("lsn"), F.max_by("state", "lsn").alias("state"))


@query("SELECT * FROM (VALUES (1, 'asked 7 times'), (2, 'ran 3 times'), (3, 'failed'), (4, 'third run')) AS t(step, said)")
def task_script(spark, sf_dir):
    """A task that is asked, waits for 0 and for some seconds, is woken, runs three times and fails."""
    answers, asked, ran = iter([0, True, 0.001, True, None, 0, True]), [], []

    def should_run():
        asked.append(1)
        return next(answers)

    def run():
        ran.append(1)
        if len(ran) == 3:
            raise ValueError("third run")

    task = BackgroundTask(should_run, run)
    while not task.failed:
        task.check_should_run()
        task.join(0.01)
    try:
        task.stop()
        error = ""
    except ValueError as e:
        error = str(e)
    said = [f"asked {len(asked)} times", f"ran {len(ran)} times", "failed" if task.failed else "fine", error]
    return spark.createDataFrame(list(enumerate(said, 1)), "step int, said string")


# Scalar functions


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY encode(n_name), n_nationkey) AS place FROM nation")
def key_order(spark, sf_dir):
    """Names in the order of their bytes: keys compare byte by byte, unsigned, the shorter first."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.encode("n_name", "utf-8"), "n_nationkey")).cast("long")
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", place.alias("place"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '02' || '08' || hex(encode(k)) ELSE '01' || '08' || hex(encode(k)) || lpad(printf('%X', strlen(props)), 2, '0') || hex(encode(props)) END AS bytes, event_type <> 'error' AS is_put, CASE WHEN event_type <> 'error' THEN props END AS val FROM (SELECT *, lpad(CAST(user_id AS VARCHAR), 8, '0') AS k FROM events)")
def op_codec(spark, sf_dir):
    """Writes as bytes (a tag, then sizes and bytes of key and value) and read back."""
    from tidelog.functions.codec import decode_op, encode_op

    put = F.col("event_type") != "error"
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), encode_op(F.when(put, "P").otherwise("D"), key_bytes(F.col("user_id")), F.encode("props", "utf-8")).alias("b"))
    rows = rows.withColumn("o", decode_op("b"))
    return rows.select("id", F.hex("b").alias("bytes"), (F.col("o.op") == "P").alias("is_put"), F.decode("o.val", "utf-8").alias("val"))
