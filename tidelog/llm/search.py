"""Exact BM25 top-k: an inverted index per shard, block-max WAND inside it, and a merge of the shards' results.

Statistics (documents, mean length, document frequencies) are those of the whole corpus, so a shard's scores are final and
its top k are all it can add to the result. Scores are sums of whole millionths, so they don't depend on the order of
addition and ties are ties.

A list keeps, for each block of documents that it has any of, where its postings begin and the largest of their scores. The
bound of a block is the sum of these over the query's lists. The threshold is the k-th best score so far, at first that of the
blocks of largest bounds. The cursor then goes through the blocks in order of documents, a window at a time: its pivots are the
blocks whose bounds reach the threshold; all others are skipped without a look at their postings. After each window the threshold
is raised, and a task hands it on to its next shard.

Alike queries go through this together, a tile of them: for the few lists that hold most of the postings, bounds and the scores of
pivots are products of matrices, in single precision. Where these and the block maxima of the other lists can't reach the
threshold, a pivot is dropped; elsewhere the other lists' postings are added. What may be among the k best after that, by the
error that single precision can have, is scored again exactly.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import discard, map_arrow, shared_dir, staged

TERM = re.compile(r"\w+")
K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Documents of a shard, about, and of a block of it.
SHARD, BLOCK = 8_192, 64
#: Blocks that are scored for a first threshold, and blocks of the first window; each window is four times the one before.
FIRST, PIVOTS = 4, 32
#: Queries of a tile, and words of them at most (or one query); lists that are kept as a matrix. Sums of DENSE single-precision
#: numbers are off by DENSE / 2**24 of themselves at most, a quarter of SLACK. Whole numbers below EXACT are exact in it.
TILE, TILE_WORDS, DENSE, SLACK, EXACT = 256, 65_536, 1024, 2.0**-12, 2**24
#: Entries whose postings are added at a time: what fits a processor's cache.
CHUNK = 4096
#: Queries that meet the shards in one job, about, and words of them: what is broadcast at a time.
QUERIES, QUERY_WORDS = 4096, 1_600_000
#: Words of which a worker remembers the hash.
MEMO = 100_000


class Hashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


_hashes = Hashes()


def terms(text: str | None) -> np.ndarray:
    """63-bit hashes of the words of a text, in order."""
    words = TERM.findall(text.lower()) if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0] up to end[0], then start[1] up to end[1], and so on, without the ends."""
    n = end - start
    before = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(start - before, n)


#: The columns of an index: a shard's documents (ids, whether they have one, words), its terms with their lists' beginnings, and
#: the lists' documents and term frequencies, each as the bytes of an array.
INDEX = {"ids": np.int64, "named": np.bool_, "length": np.int64, "term": np.int64, "start": np.int64, "doc": np.uint32, "tf": np.uint32}


def index_of(ids: list[int | None], bags: list[tuple[np.ndarray, np.ndarray]], length: list[int]) -> dict[str, np.ndarray]:
    """The inverted index of some documents, given as their distinct terms and frequencies.

    Neighbours should be alike, for tight block maxima: they are ordered by their most frequent term (much the language), then
    length.
    """
    order = sorted(range(len(ids)), key=lambda i: (bags[i][0][np.argmax(bags[i][1])] if len(bags[i][0]) else -1, length[i]))
    term = np.concatenate([*(bags[i][0] for i in order), np.zeros(0, np.int64)])
    by_term = np.argsort(term, kind="stable")
    term = term[by_term]
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(bags[i][0]) for i in order])[by_term]
    tf = np.concatenate([*(bags[i][1] for i in order), np.zeros(0, np.uint32)])[by_term]
    found = {"ids": [ids[i] or 0 for i in order], "named": [ids[i] is not None for i in order], "length": [length[i] for i in order], "term": term[start], "start": np.append(start, len(term)), "doc": doc, "tf": tf}
    return {name: np.asarray(x).astype(INDEX[name]) for name, x in found.items()}


class Shard:
    """An index with the scores and block maxima of some terms, those of a block of queries, which it answers by tiles."""

    def __init__(self, index: dict[str, np.ndarray], documents: int, mean: float, term: np.ndarray, df: np.ndarray, asked: np.ndarray | None = None):
        """term (ascending) and df are those of all queries to come; asked is how many of these have each term, one by default."""
        self.ids = index["ids"]
        self.n, self.blocks, start = len(self.ids), -(-len(self.ids) // BLOCK), index["start"]
        #: Of the terms asked for, those that the shard has; their lists are all that is kept.
        at = np.minimum(np.searchsorted(index["term"], term), max(len(index["term"]) - 1, 0))
        known = index["term"][at] == term if len(index["term"]) else np.zeros(len(term), bool)
        #: The place in self.term of each term asked for, -1 if the shard doesn't have it.
        self.place = np.where(known, np.cumsum(known) - 1, -1)
        at, df, self.term = at[known], df[known].astype(np.float64), term[known]
        self.size = start[at + 1] - start[at]
        first = np.append(0, np.cumsum(self.size))
        posting = ranges(start[at], start[at + 1])
        doc, tf = index["doc"][posting].astype(np.int32), index["tf"][posting].astype(np.float64)
        del posting
        norm = K1 * (1 - B + B * index["length"] / (mean or 1))
        idf = UNIT * np.log(1 + (documents - df + 0.5) / (df + 0.5))
        # Scores of postings, in whole millionths: sums of them are exact. Documents without an id have none.
        score = tf * (K1 + 1)
        tf += norm[doc]
        score /= tf
        del tf
        score *= np.repeat(idf, self.size)
        np.rint(score, out=score)
        score *= index["named"][doc]
        # Entries of lists: the first posting, the block and the largest score of each block that a list has any of.
        block = doc // BLOCK
        new = np.append(True, block[1:] != block[:-1])[: len(block)]
        new[first[:-1]] = True
        entry = np.append(np.flatnonzero(new), len(block))
        block, count = block[entry[:-1]], np.diff(entry)
        most = np.maximum.reduceat(score, entry[:-1]) if len(block) else score
        first_entry = np.searchsorted(entry, first)
        # The lists of most work are matrices: scores by document, block maxima and numbers of postings by block.
        some = np.sort(np.argsort(-self.size * (1 if asked is None else asked[known]), kind="stable")[:DENSE])
        if len(some):
            some = some[np.maximum.reduceat(most, first_entry[:-1])[some] < EXACT]
        self.column = np.full(len(self.term), -1)
        self.column[some] = np.arange(len(some))
        self.weight = np.zeros((self.blocks * BLOCK, len(some)), np.float32)
        at = ranges(first[some], first[some + 1])
        self.weight[doc[at], np.repeat(np.arange(len(some)), self.size[some])] = score[at]
        self.high, self.count = np.zeros((2, len(some), self.blocks), np.float32)
        at, entries = ranges(first_entry[some], first_entry[some + 1]), np.diff(first_entry)
        to = np.repeat(np.arange(len(some)), entries[some]), block[at]
        self.high[to], self.count[to] = most[at], count[at]
        # Of the others, postings hold the score and the place in the block: scores are below 2**26, and a block's places below 2**6.
        other = np.repeat(self.column < 0, self.size)
        self.posting = (score[other] * BLOCK + doc[other] % BLOCK).astype(np.uint32)
        entries[some] = 0
        other = other[entry[:-1]]
        self.block, self.most, self.first_entry = block[other], most[other], np.append(0, np.cumsum(entries))
        self.entry = np.append(0, np.cumsum(count[other])).astype(np.int32)
        #: Postings that were scored, of how many in the lists of the queries so far.
        self.scored = self.listed = 0

    def top(self, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents with a positive score; of equal scores the smaller ids."""
        at = np.flatnonzero(np.isin(self.term, term, assume_unique=True))
        return self.answer([at], k, np.zeros(1))[1:]

    def answer(self, asked: list[np.ndarray], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best documents of a tile of queries, given as places in self.term: numbers of queries, ids and scores.

        Documents with less than a query's floor may be left out, so there may be less than k.
        """
        q, (row, doc, score) = len(asked), self.wand(asked, k, floor)
        order = np.lexsort((self.ids[doc], -score, row))
        row, doc, score = row[order], doc[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(q))[row]
        kept = rank < k
        return row[kept], self.ids[doc[kept]], score[kept].astype(np.int64)

    def wand(self, asked: list[np.ndarray], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, documents and exact scores of all documents that may be among the k best of a query."""
        q, threshold = len(asked), np.maximum(floor, 1.0)
        row, at = np.repeat(np.arange(q), [len(a) for a in asked]), np.concatenate(asked)
        if not len(at) or k < 1:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self.listed += int(self.size[at].sum())
        column, has = self.column[at], np.zeros((q, self.weight.shape[1]), np.float32)
        has[row[column >= 0], column[column >= 0]] = 1
        row, at = row[column < 0], at[column < 0]
        # The entries of the other lists.
        entry = ranges(self.first_entry[at], self.first_entry[at + 1])
        place = np.repeat(row * self.blocks, self.first_entry[at + 1] - self.first_entry[at]) + self.block[entry]
        others = np.bincount(place, self.most[entry], q * self.blocks).reshape(q, self.blocks)
        bound, count = (has @ self.high + others) * (1 + SLACK), has @ self.count
        done = np.zeros((q, self.blocks), bool)

        def evaluate(pivots: np.ndarray) -> list[np.ndarray]:
            """Scores the documents of some blocks, by query: queries, blocks, scores and the other lists' part of them.

            Blocks that can't reach the threshold are left out.
            """
            self.scored += int(count[pivots].sum())
            done[pivots] = True
            rows, blocks, dense = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros((0, BLOCK), np.float32)]
            for b in np.flatnonzero(pivots.any(0)):
                at = np.flatnonzero(pivots[:, b])
                part = has[at] @ self.weight[b * BLOCK : (b + 1) * BLOCK].T
                reach = (part.max(1) + others[at, b]) * (1 + SLACK) >= threshold[at]
                rows.append(at[reach])
                blocks.append(np.full(len(rows[-1]), b))
                dense.append(part[reach])
            rows, blocks, dense = np.concatenate(rows), np.concatenate(blocks), np.concatenate(dense)
            slot = np.full(q * self.blocks, -1)
            slot[rows * self.blocks + blocks] = np.arange(len(rows))
            at = slot[place]
            some = np.flatnonzero(at >= 0)
            rare = np.zeros((len(rows), BLOCK), np.int64)
            for i in range(0, len(some), CHUNK):
                part = entry[some[i : i + CHUNK]]
                start, size = self.entry[part], self.entry[part + 1] - self.entry[part]
                before = np.cumsum(size)
                self.scored += int(before[-1])
                posting = np.repeat(start - before + size, size)
                posting += np.arange(before[-1])
                posting = self.posting[posting]
                np.add.at(rare.ravel(), np.repeat(at[some[i : i + CHUNK]] * BLOCK, size) + posting % BLOCK, (posting // BLOCK).astype(np.int64))
            return [rows, blocks, dense + rare, rare]

        best = [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)]

        def keep(rows: np.ndarray, blocks: np.ndarray, found: np.ndarray, rare: np.ndarray) -> None:
            """Adds the documents that reach the threshold to the best ones, and raises it."""
            at, doc = np.nonzero(found >= (threshold * (1 - SLACK))[rows][:, None])
            best[:] = [np.concatenate(x) for x in zip(best, (rows[at], blocks[at] * BLOCK + doc, found[at, doc], rare[at, doc]), strict=True)]
            order = np.lexsort((-best[2], best[0]))
            first = np.searchsorted(best[0][order], np.arange(q + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            threshold[full] = np.maximum(threshold[full], best[2][order[first[full] + k - 1]] * (1 - SLACK))
            order = order[best[2][order] >= (threshold * (1 - SLACK))[best[0][order]]]
            best[:] = [x[order] for x in best]

        n = min(FIRST, self.blocks)
        pivots = np.zeros((q, self.blocks), bool)
        pivots[np.arange(q)[:, None], np.argpartition(-bound, n - 1, axis=1)[:, :n]] = True
        keep(*evaluate(pivots & (bound >= threshold[:, None])))
        cursor, window = 0, PIVOTS
        while cursor < self.blocks:
            pivots = (bound >= threshold[:, None]) & ~done
            pivots[:, :cursor] = pivots[:, cursor + window :] = False
            keep(*evaluate(pivots))
            cursor, window = cursor + window, window * 4
        at, doc, _, rare = best
        exact = rare + (self.weight[doc] * has[at]).sum(1, dtype=np.float64)
        kept = exact >= np.maximum(floor, 1.0)[at]
        return at[kept], doc[kept], exact[kept]


def build(docs: DataFrame, shard: int) -> DataFrame:
    """The index of all documents, a row per shard, written to the shared folder: what follows reads it without a shuffle."""
    shards = max(1, -(-docs.count() // shard))

    def run(batches):
        at, ids, bags, length = None, [], [], []

        def row():
            index = index_of(ids, bags, length)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in index.values()], list(index))

        for b in batches:
            for number, id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if number != at:
                    if ids:
                        yield row()
                    at, ids, bags, length = number, [], [], []
                t = terms(text.as_py())
                ids.append(id_)
                bags.append(np.unique(t, return_counts=True))
                length.append(len(t))
        if ids:
            yield row()

    # Ranges are borders in a sample: with four to a shard, no two shards share a task.
    held = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "text")
    return staged(map_arrow(held.repartitionByRange(4 * shards, "shard").sortWithinPartitions("shard"), run, ", ".join(f"{n} binary" for n in INDEX)))


def statistics(index: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of documents, mean length, and (term, df) of all terms."""

    def run(batches):
        for b in batches:
            for term, start, length in zip(*[b.column(n).to_pylist() for n in ("term", "start", "length")], strict=True):
                length = np.frombuffer(length, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.frombuffer(term, np.int64), [-1, -2])), pa.array(np.append(np.diff(np.frombuffer(start, np.int64)), [len(length), length.sum()]))], ["term", "df"])

    rows = staged(map_arrow(index.select("term", "start", "length"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")))
    whole = dict(rows.where("term < 0").collect())
    n = whole.get(-1, 0)
    return n, whole.get(-2, 0) / n if n else 0.0, rows.where("term >= 0")


def tile_order(queries: pa.Table) -> tuple[np.ndarray, ...]:
    """Queries (query_id, term, df), the alike beside each other: by their most frequent term (much the language), then length.

    Returned as ids, where each one's terms begin, the terms as places among the distinct ones, these (ascending), their document
    frequencies, and how many queries have each.
    """
    ids, size = queries["query_id"].to_numpy(), np.array([len(t) for t in queries["term"]], int)
    term, df = (np.concatenate([c.flatten().to_numpy().astype(np.int64) for c in queries[n].chunks] or [np.zeros(0, np.int64)]) for n in ("term", "df"))
    start = np.cumsum(size) - size
    top = np.lexsort((term, -df, np.repeat(np.arange(len(ids)), size)))[start]
    order = np.lexsort((ids, size, term[top]))
    every, first, at, asked = np.unique(term, return_index=True, return_inverse=True, return_counts=True)
    at = at[ranges(start[order], start[order] + size[order])].astype(np.int32)
    return ids[order], np.append(0, np.cumsum(size[order])), at, every, df[first], asked


def tiles(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where tiles of queries begin and end, given where the words of each query begin, and the last one's end."""
    t = 0
    while t < len(first) - 1:
        end = max(t + 1, min(t + TILE, int(np.searchsorted(first, first[t] + TILE_WORDS, "right")) - 1))
        yield t, end
        t = end


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each of queries (query_id, text), exactly.

    A query is the set of all its text's words; a document scores by BM25 with corpus-wide statistics, and only documents
    with a positive score are returned, ties by the smaller doc_id. Null and empty texts are documents of no words, and as
    queries find nothing. Documents with a null doc_id count for the statistics but can't be named in a result; repeated
    rows are each a document; a repeated query_id is one query of the words of all its texts; null query ids are left out.
    Other columns are ignored; empty tables give no rows.

    Documents are dealt by hash, and the texts are shuffled once. Queries go in blocks of about QUERIES, a job each, that is
    broadcast to the shards: no task's work or memory grows with the corpus, nor does what the driver holds at a time.
    """
    index = build(docs, shard)
    documents, mean, df = statistics(index)

    def asked(batches):
        for b in batches:
            found = [np.unique(terms(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["query_id", "term"])

    words = map_arrow(queries.where("query_id IS NOT NULL").select("query_id", "text"), asked, "query_id long, term array<long>").select("query_id", F.explode("term").alias("term")).distinct()
    words = words.join(df, "term").groupBy("query_id").agg(F.collect_list("term").alias("term"), F.collect_list("df").alias("df"))
    words = staged(words.withColumn("h", F.xxhash64("query_id")))
    count, held = words.agg(F.count("*"), F.coalesce(F.sum(F.size("term")), F.lit(0))).first()
    blocks = max(1, -(-count // QUERIES), -(-held // QUERY_WORDS))

    def answer(block):
        def run(batches):
            ids, first, at, term, df, asked = block.value
            best = np.zeros((len(ids), max(k, 1)))
            for b in batches:
                for i in range(len(b)):
                    index = {n: np.frombuffer(b.column(n)[i].as_buffer(), kind) for n, kind in INDEX.items()}
                    shard, out = Shard(index, documents, mean, term, df, asked), []
                    for t, end in tiles(first):
                        some = [shard.place[at[i:j]] for i, j in itertools.pairwise(first[t : end + 1])]
                        number, found, score = shard.answer([x[x >= 0] for x in some], k, best[t:end, -1])
                        out.append((ids[t + number], found, score))
                        new = np.zeros((len(some), best.shape[1]))
                        new[number, np.arange(len(number)) - np.searchsorted(number, number)] = score
                        best[t:end] = -np.sort(-np.append(best[t:end], new, axis=1))[:, : best.shape[1]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["query_id", "doc_id", "micro"])

        return run

    path, kind = shared_dir(docs.sparkSession), "query_id long, doc_id long, micro long"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("micro").desc(), "doc_id"))
    for number in range(blocks):
        block = docs.sparkSession.sparkContext.broadcast(tile_order(words.where(F.pmod("h", F.lit(blocks)) == number).select("query_id", "term", "df").toArrow()))
        found = map_arrow(index, answer(block), kind)
        found.withColumn("rank", rank).where(F.col("rank") <= k).write.mode("append").parquet(path)
        block.unpersist()
    discard(index, words)
    found = docs.sparkSession.read.schema(f"{kind}, rank int").parquet(path)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", (F.col("micro") / UNIT).alias("score"))


#: All scores of all pairs that share a word.
TOP_K_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents),
s AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
l AS (SELECT doc_id, count(*)::DOUBLE AS dl FROM w GROUP BY 1),
t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2),
d AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, s GROUP BY 1),
i AS (SELECT doc_id, term, CAST(round(1000000::DOUBLE * idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))) AS BIGINT) AS micro
      FROM t JOIN d USING (term) JOIN l USING (doc_id), s),
p AS (SELECT q.doc_id AS query_id, i.doc_id, CAST(sum(micro) AS BIGINT) AS micro FROM t q JOIN i USING (term) WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY micro DESC, doc_id) AS rank FROM p)
SELECT query_id, rank, doc_id, micro / 1000000 AS score FROM r WHERE rank <= 10
"""
