"""Language identification as a mixture: which languages a document holds, and in what proportions.

Each language is a distribution over hashed letter trigrams. Expectation-maximisation estimates a document's language
proportions from its trigrams' likelihoods under each; a language joins the document's set only if the likelihood it
adds pays a penalty (BIC) for its proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_arrow, with_id

#: Buckets of trigrams; a model has this many floats per language, whatever the corpus holds.
BUCKETS = 1 << 15
#: Odd multipliers that spread the three letters of a trigram over 32 bits.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Code points hashed at a time: a very long text needs no more memory than this many.
SPAN = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Counts by bucket. Letters are in lower case, all else is one space; a trigram of no letter doesn't count."""
    counts = np.zeros(BUCKETS, np.int64)
    carry = np.array([32], np.uint32)
    for at in range(0, len(text), SPAN):
        c = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le"), np.uint32)
        c = np.concatenate([carry, np.where(letters()[c], c, np.uint32(32))])
        if at + SPAN >= len(text):
            c = np.append(c, np.uint32(32))
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        carry = c[-2:]
        if len(c) > 2:
            h = c[:-2] * MULTIPLIERS[0] ^ c[1:-1] * MULTIPLIERS[1] ^ c[2:] * MULTIPLIERS[2]
            counts += np.bincount((h * MULTIPLIERS[0]) >> np.uint32(17), minlength=BUCKETS)
    return counts


def fit(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-likelihoods of buckets, [language, bucket], from rows with text and lang.

    All rows count. Rows without text or language are ignored; with none left the model has no language.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[lang] = trigrams(text) + sums.get(lang, 0)
        for lang, counts in sums.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int32)), pa.array(counts[found])], ["lang", "bucket", "n"])

    rows = map_arrow(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"), run, "lang string, bucket int, n long")
    # At most BUCKETS rows per language come to the driver.
    sums = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.full((len(langs), BUCKETS), smoothing)
    place = {lang: i for i, lang in enumerate(langs)}
    np.add.at(counts, (sums["lang"].map(place).to_numpy(int), sums["bucket"].to_numpy(int)), sums["n"].to_numpy(float))
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def proportions(likelihood: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """EM from equal proportions: each trigram is shared out by likelihood x proportion, the shares' means are the next."""
    share = np.full(len(likelihood), 1 / len(likelihood))
    total = n.sum()
    for _ in range(rounds):
        mixed = share @ likelihood
        new = share * (likelihood @ (n / mixed)) / total
        if np.abs(new - share).max() < 1e-3:
            return new
        share = new
    return share


def infer(logs: np.ndarray, counts: np.ndarray, penalty: float = 0.5) -> tuple[list[int], list[float]]:
    """The languages of one document, the largest share first, and their shares; both empty if it has no letter.

    The nested sets of languages by share are compared by log-likelihood - penalty * log(trigrams) for each further one.
    Equal shares go to the language that comes first by name.
    """
    found = np.flatnonzero(counts)
    if not len(found) or not len(logs):
        return [], []
    n, part = counts[found], logs[:, found]
    likelihood = np.exp(part - part.max(0))
    share = proportions(likelihood, n)
    order = np.argsort(-share, kind="stable")
    best, best_share, top = order[:1], np.ones(1), n @ np.log(np.maximum(likelihood[order[0]], 1e-300))
    for k in range(2, len(order) + 1):
        if share[order[k - 1]] < 0.02:
            break
        some = order[:k]
        of = proportions(likelihood[some], n)
        value = n @ np.log(np.maximum(of @ likelihood[some], 1e-300)) - penalty * (k - 1) * np.log(n.sum())
        if value <= top:
            break
        best, best_share, top = some, of, value
    first = np.argsort(-best_share, kind="stable")
    return [int(best[i]) for i in first], [float(best_share[i]) for i in first]


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs, shares) of each text.

    lang_pred has the largest share of the chosen set and score is that share; a text that is null, empty or without a
    letter is `und` with score 0 and no languages. Equal texts get equal rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))

    def run(batches):
        logs = model.value.astype(np.float64)
        for b in batches:
            out = [infer(logs, trigrams(t)) if t else ([], []) for t in b.column(1).to_pylist()]
            names = [[langs[i] for i in some] for some, _ in out]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] if x else "und" for x in names]), pa.array([min(1.0, s[0]) if s else 0.0 for _, s in out], pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array([s for _, s in out], pa.list_(pa.float64()))],
                ["id", "lang_pred", "score", "langs", "shares"],
            )

    return map_arrow(docs.select(id_col, text_col), run, with_id(docs, id_col, "lang_pred string, score double, langs array<string>, shares array<double>")).withColumnRenamed("id", id_col)


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
