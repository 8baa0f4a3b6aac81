"""I-Match fingerprints: of the terms within a band of document frequency, several random lexicons' shares are hashed.

DataFrame functions only. A term's number is its hash. A text's distinct terms are sorted, and a slot of its
fingerprint is the 64-bit hash of the sorted terms that are in the slot's lexicon; the first slot's lexicon is the whole band,
the others are random parts of it, from a sixteenth to a thousandth.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import staged

#: There are 1 << SPLIT lexicons of each rate. One holds the terms whose number begins with its own SPLIT bits and then has
#: zeros up to the rate: a random share 1 / (1 << rate) of the band.
SPLIT, RATES = 4, (4, 6, 7, 8, 10)
SLOTS = 1 + (len(RATES) << SPLIT)
#: A text with less than this share of its terms in the band (copies and templates that many share) is told by all its terms.
SPARSE = 1 / 8
#: The lexicon is broadcast up to this many terms (16 bytes each); beyond, terms meet it in a shuffle. So are the hashes of
#: the texts that come more than once.
BROADCAST_TERMS = 1_000_000
#: Rows of a part of the ids, about, and parts for a partition at least: they are dealt out evenly by ranges.
PART_ROWS, PARTS = 50_000, 4


def terms(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes: runs of letters and digits in lower case."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def different(docs: DataFrame) -> tuple[DataFrame, int]:
    """(text) of each different text once, and their number. Only texts that come more than once are shuffled, if few."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    counts = staged(rows.groupBy("_h").agg(F.count("*").alias("_n")))
    again = counts.where("_n > 1").select("_h")
    if again.count() > BROADCAST_TERMS:
        return rows.groupBy("_h").agg(F.first("text").alias("text")).select("text"), counts.count()
    once = rows.join(F.broadcast(again), "_h", "left_anti").select("text")
    return once.unionByName(rows.join(F.broadcast(again), "_h", "left_semi").groupBy("_h").agg(F.first("text").alias("text")).select("text")), counts.count()


def lexicon(docs: DataFrame, least: float = 0.001, most: float = 0.1) -> DataFrame:
    """(term) of the terms in least to most of all different texts, and in two at least.

    Copies count once: a text that a third of the rows repeat has its terms in the band as any other. A text of t terms adds
    t to the sum of document frequencies, so there are at most mean(t) / least such terms.
    """
    texts, n = different(docs)
    df = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= max(2.0, least * n)) & (F.col("df") <= max(2.0, most * n))).select("term")


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def lexicon_hashes(numbers: Column) -> Column:
    """The slots of an array of terms' numbers: a hash of the sorted ones in each lexicon, 0 where it has none of them.

    A lexicon is a range of numbers. The ranges' borders (multiples of a power of two, which no number is) are sorted in among
    the numbers, so that one look at the sorted array finds all ranges. Borders inside a range are hashed with it.
    """
    steps = [0, *(1 << 64 - rate for rate in reversed(RATES[1:]))]
    borders = [-(1 << 63) + (i << 64 - SPLIT) + step for i in range(1 << SPLIT) for step in steps]
    is_border = lambda x: x.bitwiseAND(F.lit(min(steps[1:]) - 1).cast("long")) == 0

    def cut(x: Column) -> Column:
        each, at = x["sorted"], x["at"]

        def slot(i: Column) -> Column:
            first, inner = F.floor(i / len(steps)) * len(steps), i % len(steps)
            start, n = F.get(at, first.cast("int")), F.get(at, (first + inner + 1).cast("int")) - F.get(at, first.cast("int")) - 1
            return F.when(n > inner, F.xxhash64(F.slice(each, start + 1, n))).otherwise(F.lit(0).cast("long"))

        return F.transform(F.sequence(F.lit(0), F.lit(len(borders) - 1)), slot)

    def places(each: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(each)), lambda i: is_border(F.get(each, i - 1)))
        return bound(F.struct(each.alias("sorted"), F.concat(at, F.array(F.size(each) + 1)).alias("at")), cut)

    slots = bound(F.sort_array(F.concat(numbers, F.array(*[F.lit(x).cast("long") for x in borders]))), places)
    return F.concat(F.array(F.when(F.size(numbers) > 0, F.xxhash64(F.sort_array(numbers))).otherwise(F.lit(0).cast("long"))), slots)


def fingerprints(rows: DataFrame, texts: dict[str, str], lexicon: DataFrame, keys: list[str], carried: list[str] | None = None, size: int | None = None) -> DataFrame:
    """keys, carried columns and, for each name in texts, the slots of that column of rows, SLOTS numbers.

    keys (not null) tell rows apart; what is dealt by one of them already isn't shuffled again. A text with less than SPARSE
    of its terms in the band is told by all its terms, so that likeness to its near copies is graded too; one without any
    term by a hash of the text. Equal texts have equal slots.
    """
    size = lexicon.count() if size is None else size
    side = lexicon.withColumn("_in", F.lit(1).cast("long"))
    side = F.broadcast(side) if size <= BROADCAST_TERMS else side
    whole = {f"_whole_{i}": F.xxhash64(col) for i, col in enumerate(texts.values())}
    as_of = lambda i: lambda t: F.struct(F.lit(i).alias("which"), t.alias("term"))
    said = [F.transform(terms(F.col(col)), as_of(i)) for i, col in enumerate(texts.values())]
    # What belongs to the row as a whole is on the first of its rows only.
    first = F.array(F.struct(F.lit(-1).alias("which"), F.lit(None).cast("long").alias("term")))
    some = [*(carried or []), *whole]
    each = rows.withColumns(whole).select(*keys, *some, F.explode(F.concat(first, *said)).alias("_x"))
    each = each.select(*keys, *[F.when(F.col("_x.which") < 0, F.col(c)).alias(c) for c in some], F.col("_x.which").alias("_which"), F.col("_x.term").alias("term"))
    each = each.join(side, "term", "left")
    # The last bit of a term's number says whether it is in the band; the last but one keeps it apart from the borders.
    number = F.col("term").bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(F.coalesce("_in", F.lit(0).cast("long")) + 2)
    lists = [F.collect_list(F.when(F.col("_which") == i, number)).alias(f"_all_{i}") for i in range(len(texts))]
    held = each.groupBy(*keys).agg(*[F.max(c).alias(c) for c in some], *lists)
    held = held.withColumns({f"_band_{i}": F.filter(f"_all_{i}", lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1) for i in range(len(texts))})
    held = held.withColumns({f"_some_{i}": F.when(F.size(f"_band_{i}") < SPARSE * F.size(f"_all_{i}"), F.col(f"_all_{i}")).otherwise(F.col(f"_band_{i}")) for i in range(len(texts))})
    slots = [F.when(F.size(f"_some_{i}") > 0, lexicon_hashes(F.col(f"_some_{i}"))).otherwise(F.concat(F.array(f"_whole_{i}"), F.array_repeat(F.lit(0).cast("long"), SLOTS - 1))).alias(name) for i, name in enumerate(texts)]
    return held.select(*keys, *(carried or []), *slots)


def printed(slots: Column) -> Column:
    """A fingerprint as text: the slots in hex, joined by points, nothing for an empty one."""
    return F.array_join(F.transform(slots, lambda x: F.when(x == 0, "").otherwise(F.lower(F.hex(x)))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of slots, the share of equal ones among those that either fills; 1 if all are equal."""
    told = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != 0), 2).when((x != 0) | (y != 0), 1).otherwise(0))
    equal, filled = F.size(F.filter(told, lambda c: c == 2)), F.size(F.filter(told, lambda c: c > 0))
    return F.when(a == b, 1.0).when(filled == 0, 0.0).otherwise(equal / filled)


def small_table(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """A broadcast table of a few rows from the driver, as one literal."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>"))))


def in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """rows (doc_id, text) with `part`, larger for larger ids, and `tie`, which orders null ids; null ids have negative parts.

    Borders are quantiles of the ids. A row finds its part by the cell that its id is in: cells are equally wide, four for each
    part, and a cell's row of a small broadcast table has the borders that lie in it.
    """
    n, ids, low, high, borders = rows.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()
    # Null ids follow each other by a hash of their texts, in 64 parts.
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")) if ids < n else F.lit(None).cast("long")
    rows = rows.withColumn("tie", tie)
    null = F.lit(-33) - F.shiftright("tie", 58)
    if not ids:
        return rows.withColumn("part", null.cast("long"))
    borders = sorted(set(borders)) if parts > 1 else []
    width = (high - low) // (4 * parts) + 1
    cell = lambda x: abs(x) // width * (1 if x >= 0 else -1)
    held: dict[int, list[int]] = {c: [] for c in range(cell(low), cell(high) + 1)}
    for b in borders:
        held[cell(b)].append(b)
    table, base = [], 0
    for c, some in held.items():
        table.append({"cell": c, "base": base, "borders": some})
        base += len(some)
    cells = small_table(rows.sparkSession, table, "cell: bigint, base: bigint, borders: array<bigint>")
    rows = rows.withColumn("cell", F.expr(f"doc_id div {width}")).join(cells, "cell", "left")
    part = F.col("base") + F.size(F.filter("borders", lambda b: b <= F.col("doc_id")))
    return rows.select("doc_id", "text", "tie", F.coalesce(part, null).cast("long").alias("part"))


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, last, doc_id, tie, text) by ranges of doc_id, each part with the row that follows it in descending order.

    Within a part rows are to be read by last, then descending doc_id, tie and text; rows with last true belong to another part
    (or, after the smallest doc_id, are the table's first). The driver sees one row of numbers for each part.
    """
    rows = in_parts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    # The first of a part in order: the largest id, or of null ids the smallest tie.
    heads = sorted(((r[0], r[1], r[2]) for r in rows.groupBy("part").agg(F.max("doc_id"), F.min("tie")).collect()), key=lambda h: -h[0])
    table = [{"head": i, "head_tie": t, "also": heads[k - 1][0]} for k, (_, i, t) in enumerate(heads)]
    also = small_table(rows.sparkSession, table, "head: bigint, head_tie: bigint, also: bigint")
    rows = rows.join(also, F.col("doc_id").eqNullSafe(F.col("head")) & F.col("tie").eqNullSafe(F.col("head_tie")), "left")
    both = F.array(F.struct(F.col("part"), F.lit(False).alias("last")), F.struct(F.col("also").alias("part"), F.lit(True).alias("last")))
    return rows.select(F.explode(both).alias("to"), "doc_id", "tie", "text").select("to.part", "to.last", "doc_id", "tie", "text").where("part IS NOT NULL")


def against_edited(docs: DataFrame, least: float = 0.001, most: float = 0.1, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document, in
    descending doc_id, after the last the first. A null text is empty; equal texts have equal fingerprints; rows of equal
    doc_id follow each other by text, null ids come last; an empty table gives no rows; other columns are ignored. The number
    of parts, by default from the rows and the session's partitions, changes nothing but how rows are dealt.
    """
    words = staged(lexicon(docs, least, most))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(PARTS * partitions, -(-docs.count() // PART_ROWS))
    rows = beside_next(docs, parts).repartitionByRange(partitions, "part")
    order = Window.partitionBy("part").orderBy("last", F.col("doc_id").desc_nulls_last(), "tie", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = fingerprints(rows, {"fingerprint": "text", "edited_fingerprint": "edited"}, words, ["part", "place"], ["last", "doc_id", "n_chars", "edited_sha256"])
    found = found.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("place"))).where("NOT last")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other)).cast("double")
    text = [printed(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", "edited_sha256", *text, near("edited_fingerprint").alias("near_edited"), near("_next").alias("near_next"))
