"""WARC archives: records in segments, chunked transfer framing, revisits; written and read back by Spark alone.

The text writer puts CRLF CRLF behind each row, which is how a WARC record ends, so archives go to any store that Spark
writes to. Reading frames records by their Content-Length, so payloads may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import map_arrow, shared_dir, staged

#: The format's line end, and the head of the archived HTTP answers.
CRLF = "\r\n"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Payloads from this many bytes on may be revisits of equal ones.
REVISIT_BYTES = 1000
#: Rows that share a payload are dealt to so many tasks by their ids, however many they are.
SALTS = 1024


def salt(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")


def chunked(payload: Column, size: int) -> Column:
    """The payload in chunked transfer framing."""
    n = F.octet_length(payload)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))

    def chunk(at):
        part = F.substring(payload, at + 1, F.lit(size))
        return F.concat(F.hex(F.octet_length(part)).cast("binary"), F.lit(CRLF).cast("binary"), part, F.lit(CRLF).cast("binary"))

    body = F.aggregate(F.transform(starts, chunk), F.lit(b""), lambda a, b: F.concat(a, b))
    return F.concat(body, F.lit("0\r\n\r\n").cast("binary"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which pages repeat the payload of a page with a larger id.

    A digest's rows meet by salt, and the salts that it has, SALTS at most, bring its largest id to each.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("_salt", salt(F.col("page_id")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    by_salt = rows.where(large).groupBy("digest", "_salt").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    latest = by_salt.groupBy("digest").agg(F.max("_last").alias("_last"), F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts")).where("_n > 1 AND _last IS NOT NULL")
    rows = rows.join(latest.select("digest", F.explode("_salts").alias("_salt"), "_last"), ["digest", "_salt"], "left")
    again = F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))
    return rows.select("page_id", "url", "payload", "digest", F.when(again, F.col("_last")).alias("refers_to"))


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def write_archives(pages: DataFrame, path: str, segment: int = 16_384, chunk: int = 8_192, per_file: int = 4_000) -> None:
    """A record for each page, in segments of at most `segment` bytes of block, to gzip-compressed archives at path.

    A null html is an empty payload. Equal rows give equal records. A line end in a url is left out.
    """
    rows = with_revisits(pages)
    block = F.when(F.col("refers_to").isNull(), F.concat(F.lit(HEAD).cast("binary"), chunked(F.col("payload"), chunk))).otherwise(F.lit(HEAD).cast("binary"))
    rows = rows.withColumn("block", block).withColumn("length", F.octet_length("block")).withColumn("last", F.ceil(F.col("length") / segment).cast("int"))
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("last"))))
    part = F.substring(F.col("block"), (F.col("segment") - 1) * segment + 1, F.lit(segment))
    own, first = record_id(F.col("page_id"), F.col("digest")), F.col("segment") == 1

    def line(name, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.when(first, own).otherwise(F.concat(F.lit("<urn:x-segment:"), F.col("segment").cast("string"), F.lit(":"), F.substring(own, 6, 1 << 20)))),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & F.col("refers_to").isNotNull()),
        line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("digest")), first & F.col("refers_to").isNotNull()),
        line("WARC-Segment-Number", F.col("segment"), F.col("last") > 1),
        line("WARC-Segment-Origin-ID", own, ~first),
        line("WARC-Segment-Total-Length", F.col("length"), ~first & (F.col("segment") == F.col("last"))),
        line("Content-Length", F.octet_length("part")),
        F.lit(CRLF),
    )
    rows = rows.withColumn("part", part).select(F.concat(header.cast("binary"), F.col("part")).cast("string").alias("value"))
    rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and block of each record; a record that the archive's end cuts off is an error."""
    raw = io.BytesIO(archive)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if archive[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if "content-length" not in headers:
            raise ValueError(f"record {headers.get('warc-record-id')} has no length")
        n = int(headers["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].partition(b";")[0], 16)
        if not n:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk isn't as long as it says")
        out.append(part)
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP answer; of anything else, the block."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if body and b"transfer-encoding: chunked" in head.lower() else body


def finished(head: tuple, block: bytes, keep_payload: bool) -> tuple:
    """(status, payload_bytes, payload_sha1, payload) of a record's whole block; head begins with its type."""
    if head[0] == "revisit":
        return "ok", None, None, None
    try:
        payload = payload_of(block)
    except ValueError:
        return "bad_chunks", None, None, None
    return "ok", len(payload), hashlib.sha1(payload).hexdigest(), payload if keep_payload else None


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


RECORD = [("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("status", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary())]
SEGMENT = [*RECORD, ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
RECORD_DDL = "record_id string, type string, refers_to string, digest string, status string, payload_bytes long, payload_sha1 string, payload binary"


def read_segments(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row per record, a continuation by the id of the record that it continues.

    A record that isn't segmented is decoded here and has a status; one that is has its number, its block and, in the last
    one, the total length, and a null status. An archive file is held by one task.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for h, block in records(content.as_py()):
                    digest = h.get("warc-payload-digest")
                    head = h.get("warc-type"), h.get("warc-refers-to"), digest and digest.removeprefix("sha1:")
                    if "warc-segment-number" in h:
                        total = h.get("warc-segment-total-length")
                        rows.append((h.get("warc-segment-origin-id", h.get("warc-record-id")), *head, None, None, None, None, int(h["warc-segment-number"]), total and int(total), block))
                    else:
                        rows.append((h.get("warc-record-id"), *head, *finished(head, block, keep_payload), None, None, None))
                    size += len(block)
                    if len(rows) == 1000 or size > 1 << 24:
                        yield batch_of(rows, SEGMENT)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows, SEGMENT)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return map_arrow(files, run, RECORD_DDL + ", segment int, total long, block binary")


def reassemble(segments: DataFrame, keep_payload: bool = True) -> DataFrame:
    """(record_id, type, refers_to, digest, status, payload_bytes, payload_sha1[, payload]): a row per whole record.

    Segments are dealt by origin and sorted by number, and a task holds those of one record at a time; records that came
    whole bring no block with them. Segments that come several times with equal bytes are copies of one record, which comes
    as often as its first segment; of different bytes for one number the largest counts. status is ok, missing_segment, length_mismatch (against the total length) or
    bad_chunks; the payload is null unless ok.
    """

    def whole(parts):
        """A record's row, and how often it came."""
        first, copies = parts[0], sum(p["copies"] for p in parts if p["segment"] == 1)
        by_number = {p["segment"]: p for p in parts}
        blocks = [by_number[k]["block"] for k in sorted(by_number)]
        total = max((p["total"] for p in parts if p["total"] is not None), default=None)
        head = first["type"], first["refers_to"], first["digest"]
        if sorted(by_number) != list(range(1, len(by_number) + 1)) or total is None:
            end = "missing_segment", None, None, None
        elif sum(map(len, blocks)) != total:
            end = "length_mismatch", None, None, None
        else:
            end = finished(head, b"".join(blocks), keep_payload)
        return (first["record_id"], *head, *end), max(1, copies)

    def found_in(batches):
        held = []
        for b in batches:
            for row in b.to_pylist():
                if held and row["record_id"] != held[0]["record_id"]:
                    yield whole(held)
                    held = []
                if row["status"] is not None:
                    yield tuple(row[n] for n, _ in RECORD), 1
                elif held and (row["segment"], row["block"]) == (held[-1]["segment"], held[-1]["block"]):
                    # A copy is counted, not held: one record may come any number of times.
                    held[-1]["copies"] += 1
                    held[-1]["total"] = row["total"] if held[-1]["total"] is None else held[-1]["total"]
                else:
                    held.append({**row, "copies": 1})
        if held:
            yield whole(held)

    def run(batches):
        out, size = [], 0
        for row, copies in found_in(batches):
            for _ in range(copies):
                out.append(row)
                size += len(row[-1] or b"")
                if len(out) >= 5000 or size > 1 << 25:
                    yield batch_of(out, RECORD)
                    out, size = [], 0
        if out:
            yield batch_of(out, RECORD)

    dealt = segments.repartition("record_id").sortWithinPartitions("record_id", "segment", "block")
    found = map_arrow(dealt, run, RECORD_DDL)
    return found if keep_payload else found.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, status) of pages, as the archives have them.

    status adds digest_mismatch where the payload's SHA-1 isn't the declared one. A null or empty html has an empty
    payload; repeated rows come as often as they are there, those with the largest page_id all as responses; other
    columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_archives(pages, path)
    found = staged(reassemble(read_segments(spark, path, keep_payload=False), keep_payload=False))
    page = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("null")).cast("long")
    said = found.where("type = 'response'").groupBy(F.col("record_id").alias("_origin")).agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_sha1").alias("_sha1"))
    rows = found.where("type = 'response'").withColumn("_bytes", F.col("payload_bytes")).withColumn("_sha1", F.col("payload_sha1"))
    again = found.where("type = 'revisit'").withColumn("_salt", salt(F.col("record_id")))
    # What a response says goes to each salt of its revisits, and they fetch it there: one response may have a third of all rows.
    told = again.select("refers_to", "_salt").distinct().join(said, F.col("refers_to") == F.col("_origin")).drop("_origin")
    again = again.join(told, ["refers_to", "_salt"], "left").select(*found.columns, "_bytes", "_sha1")
    both = rows.unionByName(again)
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_sha1") == F.col("digest"), "ok").otherwise("digest_mismatch")
    return both.select(page("record_id").alias("page_id"), F.col("_bytes").alias("payload_bytes"), F.col("_sha1").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), status.alias("status"))


#: The same rows straight from the table.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS latest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN latest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest > page_id THEN latest END AS refers_to, 'ok' AS status FROM m
"""
