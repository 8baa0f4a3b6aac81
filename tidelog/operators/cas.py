"""Compare-and-swap over a log, in LSN order within each key.

Rows are dealt by key and sorted, and a task reads them as a stream: it holds one value, however long a key's history is. Only
a key of more than a span of operations (a hot one) is cut by LSN, so that it is many tasks: what a run of operations does to a
key is a function of the value before it, so each span is first summed up as a function, the functions are applied one after
the other to find the value that each span begins with, then all spans are replayed at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: LSNs of a span, and operations from which a key is hot.
SPAN = 1_000_000
#: A NaN is a value that equals itself, as in Spark's own comparisons.
NAN = object()


def values(column: pa.Array) -> list:
    """The values with None for null, exactly as they are stored."""
    return [NAN if x != x else x for x in column.to_pylist()]  # noqa: PLR0124


def array(some: list, kind: pa.DataType) -> pa.Array:
    return pa.array([float("nan") if x is NAN else x for x in some], kind)


def span_function(ops) -> dict:
    """start value -> end value of the operations (cur, new), for the start values that don't stay what they are."""
    #: Start values by the value they have become; one that isn't named yet is still itself.
    become: dict = {}
    moved: set = set()
    for cur, new in ops:
        starts = become.pop(cur, [])
        if cur not in moved:
            moved.add(cur)
            starts.append(cur)
        if starts:
            if new not in moved and new not in become:
                moved.add(new)
                starts.append(new)
            held = become.setdefault(new, [])
            if len(held) < len(starts):
                held, starts = starts, held
                become[new] = held
            held += starts
    return {s: end for end, starts in become.items() for s in starts if s != end}


def replayed(rows: DataFrame, by: list[str]) -> DataFrame:
    """(lsn, key, succeeded, cur_value) of rows (lsn, key, span, cur, new, begin), each group of `by` from its value begin on."""
    kind, key, n = rows.schema["cur"].dataType.simpleString(), rows.schema["key"].dataType.simpleString(), len(by)

    def run(batches):
        at, state = None, None
        for b in batches:
            cols = {name: values(b.column(name)) for name in ("key", "span", "cur", "new", "begin")}
            done, found = [], []
            for group, cur, new, begin in zip(zip(cols["key"], cols["span"], strict=True), cols["cur"], cols["new"], cols["begin"], strict=True):
                if group[:n] != at:
                    at, state = group[:n], begin
                ok = state == cur
                done.append(ok)
                found.append(None if ok else state)
                state = new if ok else state
            yield pa.RecordBatch.from_arrays([b.column("lsn"), b.column("key"), pa.array(done, pa.bool_()), array(found, b.schema.field("cur").type)], ["lsn", "key", "succeeded", "cur_value"])

    dealt = rows.select("lsn", "key", "span", "cur", "new", "begin").repartition(*by).sortWithinPartitions(*by, "lsn")
    return dealt.mapInArrow(run, f"lsn long, key {key}, succeeded boolean, cur_value {kind}")


def begins(rows: DataFrame) -> DataFrame:
    """(key, span, begin): the value that each span of rows begins with, null if the key is absent then."""
    kind, key = rows.schema["cur"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()

    def summed(batches):
        at, ops, types = None, [], None

        def row():
            ends = span_function(ops)
            return pa.RecordBatch.from_arrays([array([at[0]], types[0]), pa.array([at[1]], pa.int64()), pa.array([array(list(ends), types[1])], pa.list_(types[1])), pa.array([array(list(ends.values()), types[1])], pa.list_(types[1]))], ["key", "span", "start", "end"])

        for b in batches:
            types = b.schema.field("key").type, b.schema.field("cur").type
            for group, op in zip(zip(values(b.column("key")), values(b.column("span")), strict=True), zip(values(b.column("cur")), values(b.column("new")), strict=True), strict=True):
                if group != at:
                    if ops:
                        yield row()
                    at, ops = group, []
                ops.append(op)
        if ops:
            yield row()

    def chained(batches):
        at, state = None, None
        for b in batches:
            found = []
            for i, k in enumerate(values(b.column("key"))):
                if i == 0 and at is None or (k,) != at:
                    at, state = (k,), None
                found.append(state)
                # One function is looked at, at a time, and of it one value is kept.
                ends = dict(zip(values(b.column("start")[i].values), values(b.column("end")[i].values), strict=True))
                state = ends.get(state, state)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("span"), array(found, b.schema.field("start").type.value_type)], ["key", "span", "begin"])

    functions = rows.repartition("key", "span").sortWithinPartitions("key", "span", "lsn").mapInArrow(summed, f"key {key}, span long, start array<{kind}>, end array<{kind}>")
    return functions.repartition("key").sortWithinPartitions("key", "span").mapInArrow(chained, f"key {key}, span long, begin {kind}")


def compare_and_swap(log: DataFrame, span: int = SPAN) -> DataFrame:
    """(lsn, key, succeeded, cur_value) for rows (lsn, key, cur, new): null means absent, as expectation and as new value.

    An operation succeeds if the key's value is what it expects; cur_value is the value found by one that doesn't. NaN is a
    value as any other. Keys may be null; LSNs are distinct within a key.
    """
    rows = log.select("lsn", "key", "cur", "new").withColumn("span", F.floor(F.col("lsn") / span).cast("long"))
    none = F.lit(None).cast(log.schema["cur"].dataType)
    hot = rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > span).select(F.col("key").alias("_hot"), F.lit(True).alias("_is_hot"))
    if hot.isEmpty():
        return replayed(rows.withColumn("begin", none), ["key"])
    marked = rows.join(hot, F.col("key").eqNullSafe(F.col("_hot")), "left")
    cold = replayed(marked.where("_is_hot IS NULL").select("lsn", "key", "span", "cur", "new", none.alias("begin")), ["key"])
    cut = marked.where("_is_hot").select("lsn", "key", "span", "cur", "new")
    found = begins(cut).select(F.col("key").alias("_key"), F.col("span").alias("_span"), "begin")
    begun = cut.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("span") == F.col("_span"))).select("lsn", "key", "span", "cur", "new", "begin")
    return cold.unionByName(replayed(begun, ["key", "span"]))
