"""Packing into length buckets whose boundaries waste least, and into batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, staged

#: Rows of a bucket that are numbered in one task, about.
PART_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most that many of the lengths (distinct, ascending) as bucket tops, with least padding in all.

    cost[b][j], the least padding of the lengths up to the j-th in b buckets, is the minimum over i of cost[b-1][i] plus
    the padding of the lengths after the i-th to the j-th. Of equal minima the smallest i counts. That i never falls as j
    grows, so it is found for the middle j first and bounds it for those on either side: n log n steps a bucket. Whole
    numbers, so minima are exact.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    size = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = np.concatenate([[0], np.full(n, 1 << 62)])
    came = []
    for _ in range(min(buckets, n)):
        new, back = np.zeros(n + 1, np.int64), np.zeros(n + 1, int)
        todo = [(1, n, 0, n - 1)]
        while todo:
            first, last, low, high = todo.pop()
            j = (first + last) // 2
            i = slice(low, min(high, j - 1) + 1)
            padded = cost[i] + lengths[j - 1] * (size[j] - size[i]) - (mass[j] - mass[i])
            k = int(np.argmin(padded))
            new[j], back[j] = padded[k], low + k
            if first < j:
                todo.append((first, j - 1, low, low + k))
            if j < last:
                todo.append((j + 1, last, low + k, high))
        cost = new
        came.append(back)
    tops, j = [], n
    for back in reversed(came):
        if j:
            tops.append(int(lengths[j - 1]))
            j = back[j]
    return tops[::-1]


def pack(docs: DataFrame, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding) of each document.

    A batch holds floor(budget / bucket_len) documents of one bucket, at least one (so a text longer than the budget is a
    batch by itself), and only a bucket's last batch holds fewer. Null and empty texts have no tokens and are packed all
    the same. The boundaries are those of least padding over the lengths that occur; all of these go to the driver, and as d
    different lengths take d * d / 2 words at least, they are few. Documents of a bucket are numbered part by part, and in a part by doc_id, then length; parts are by the
    hash of the id, so no bucket is numbered in one task. Ties of equal rows go either way and give equal columns.
    """
    lengths = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("_h"))
    # Written once: the optimiser would put the count of words into every expression that asks for it.
    lengths = staged(lengths)
    hist = lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")
    tops = boundaries(hist["n_tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), buckets)
    if not tops:
        tops = [0]
    place = np.searchsorted(tops, hist["n_tokens"].to_numpy(np.int64)) if len(hist) else np.zeros(0, int)
    held = [int(hist["n"].to_numpy()[place == b].sum()) for b in range(len(tops))]
    bucket = F.lit(0)
    for b, top in enumerate(tops[:-1]):
        bucket = F.when(F.col("n_tokens") > top, b + 1).otherwise(bucket)
    parts = F.get(F.array(*[F.lit(-(-n // PART_ROWS) or 1) for n in held]), F.col("bucket"))
    lengths = lengths.withColumn("bucket", bucket).withColumn("_part", F.pmod(F.col("_h"), parts))
    # Offsets: one row per part; the parts of a bucket are a twenty-thousandth of its rows.
    starts = lengths.groupBy("bucket", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("bucket", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("bucket", "_part").orderBy("doc_id", "n_tokens", "_h")
    rows = lengths.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["bucket", "_part"])
    top = F.get(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("bucket"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    number = F.col("_start") + F.col("_row")
    return rows.withColumn("bucket_len", top).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.concat_ws("-", "bucket", F.floor(number / room)).alias("batch_id"), (number % room).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )
