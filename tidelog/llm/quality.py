"""Quality by importance resampling: how much likelier a text is under the target's hashed n-grams than under the corpus's.

Two generative models, of texts that are labelled good and of all texts, are bags of hashed words and word pairs. A
document's log importance weight is the log ratio of its likelihoods; adding Gumbel noise and taking the k largest draws k
documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import KEY_BITS, kth_largest, map_arrow, staged, with_id

#: Buckets of words and of word pairs, together the size of a model. Few, so that a small corpus fills them: a bucket that
#: holds little but one document's words says that the document isn't labelled, not that it is bad.
WORDS, PAIRS = 1 << 10, 1 << 10
#: The target model is smoothed by the corpus's own: it is a part MIX of the mixture, and counts as PRIOR features beside those
#: of the target's texts, so that a target of few texts says little against what it doesn't hold.
MIX, PRIOR = 0.6, 1 << 11
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words of which a worker remembers the hash.
MEMO = 100_000
#: Texts above so many characters are read token by token: slower, but with four bytes of memory a token.
SPAN = 1 << 22


class Hashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


_hashes = Hashes()


def features(text: str) -> np.ndarray:
    """Bucket of each word, then of each pair of neighbours; a word next to itself has a bucket of its own."""
    text = text.lower()
    if len(text) <= SPAN:
        words = TOKEN.findall(text)
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))
    else:
        h = np.fromiter((_hashes[m[0]] for m in TOKEN.finditer(text)), np.uint32)
    pair = ((h[:-1] * np.uint32(0x9E3779B1) ^ h[1:]) * np.uint32(0x85EBCA77) >> np.uint32(16)) % np.uint32(PAIRS - 1) + np.uint32(1)
    return np.concatenate([h % np.uint32(WORDS), np.where(h[:-1] == h[1:], 0, pair) + np.uint32(WORDS)])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in a column `text`, over all rows; as many numbers as the model has buckets."""

    def run(batches):
        total = np.zeros(WORDS + PAIRS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    total += np.bincount(features(text), minlength=WORDS + PAIRS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    rows = map_arrow(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(WORDS + PAIRS)
    total[rows["bucket"].to_numpy(int)] = rows["n"]
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw by bucket; words and pairs are a distribution each. Without target text it is 0."""
    if not target.any():
        return np.zeros(WORDS + PAIRS)
    parts = []
    for part in (slice(None, WORDS), slice(WORDS, None)):
        r = (raw[part] + 1e-9) / (raw[part] + 1e-9).sum()
        t = (target[part] + PRIOR * r) / (target[part].sum() + PRIOR)
        parts.append(np.log((1 - MIX) * t + MIX * r) - np.log(r))
    return np.concatenate(parts)


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id, log_weight): the sum of the log ratios of a text's features; 0 for a text that is null or has none."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for b in batches:
            w = [float(np.round(model.value[features(t)].sum(), 6)) if t else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64())], ["id", "log_weight"])

    return map_arrow(docs.select(id_col, "text"), run, with_id(docs, id_col, "log_weight double")).withColumnRenamed("id", id_col)


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from the hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def gumbel_key(doc_id: Column, seed: int) -> Column:
    return F.col("log_weight") + gumbel_noise(doc_id, seed)


def steps(key: Column) -> Column:
    """A key in whole millionths, within what kth_largest can hold."""
    limit = float((1 << KEY_BITS - 1) - 1)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.round(key * 1e6))).cast("long")


def resampling_cut(weighted: DataFrame, k: int | None, slack: float, seed: int) -> int | None:
    """steps() of the k-th largest key; None if k is no less than the number of rows.

    k None: the expected number that acceptance sampling would keep, the sum of min(1, weight x e**slack).
    """
    if k is None:
        k = weighted.agg(F.sum(F.exp(F.least(F.lit(0.0), F.col("log_weight") + slack)))).first()[0]
        k = int((k or 0) + 0.5)
    if k < 1:
        return (1 << KEY_BITS - 1) - 1
    return kth_largest(weighted.select(steps(gumbel_key(F.col("doc_id"), seed)).alias("key")), "key", k)


def resample(weighted: DataFrame, k: int | None = None, slack: float = 3.0, seed: int = 17) -> DataFrame:
    """weighted with gumbel_key and selected: k documents drawn without replacement in proportion to their weights.

    The k-th key is found exactly by counting; rows that tie with it (repeated rows, say) are all selected. weighted is read
    several times.
    """
    cut = resampling_cut(weighted, k, slack, seed)
    keyed = weighted.withColumn("gumbel_key", gumbel_key(F.col("doc_id"), seed))
    return keyed.withColumn("selected", F.lit(True) if cut is None else steps(F.col("gumbel_key")) >= cut)


def model(docs: DataFrame, labels: DataFrame, fit_ids: int) -> np.ndarray:
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(fit_ids)
    raw = counts(docs)
    target = counts(docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi"))
    return log_ratio(target, raw)


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, slack: float = 3.0, seed: int = 17, fit_ids: int = 200_000) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) of each document.

    The target model is fitted on the documents with label quality 1, or on fit_ids of their ids by hash if there are more
    (the bound on what is broadcast); the raw model counts all documents. Documents that share an id share a label. A null
    or empty text has weight 0, a null id never has a label.
    """
    return resample(staged(weights(docs, model(docs, labels, fit_ids))), k, slack, seed)


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, slack: float = 3.0, seed: int = 17, fit_ids: int = 200_000) -> DataFrame:
    """The rows of docs, all columns, that classify() selects. The weights are computed again instead of joined: no shuffle."""
    ratio = model(docs, labels, fit_ids)
    cut = resampling_cut(staged(weights(docs, ratio)), k, slack, seed)
    rows = weights(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text"), ratio, "row")
    if cut is not None:
        rows = rows.where(steps(gumbel_key(F.col("row.doc_id"), seed)) >= cut)
    return rows.select("row.*")
