import math
import random
import re

import numpy as np
import pytest

from tidelog.llm import search
from tidelog.llm.queries import ORACLE_SQL, QUERIES


def brute(docs, queries, k):
    bags = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in docs]
    n, mean = len(bags), sum(len(b) for _, b in bags) / len(bags)
    df = {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, text in queries:
        found = []
        for i, b in bags:
            score = 0
            for w in set(re.findall(r"\w+", (text or "").lower())) & set(b):
                tf, idf = b.count(w), math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                score += round(1e6 * idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(b) / mean))))
            if score:
                found.append((-score, i))
        out |= {(q, r + 1, i, -s / 1e6) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize(("shard", "k"), [(7, 3), (10_000, 10), (40, 1)])
def test_top_k_is_exact(spark, docs, shard, k):
    rnd = random.Random(shard)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rnd.randrange(30))) for _ in range(120)]
    texts += texts[:5] + [None, ""]
    table = docs(texts)
    asked = [(i, t) for i, t in enumerate(texts) if i % 10 == 0]
    got = search.top_k(table, spark.createDataFrame(asked, "query_id long, text string"), k, shard).collect()
    assert {tuple(r) for r in got} == brute(list(enumerate(texts)), asked, k)


def test_pruned_and_whole_evaluation_agree(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "PIVOTS", 2)
    rnd = np.random.default_rng(1)
    bags, lengths = [], []
    for i in range(2000):  # topics have words of their own, and all share some
        t = np.unique(np.concatenate([rnd.zipf(1.3, 20) % 500, 1000 + 40 * (i % 50) + rnd.integers(0, 40, 12)]))
        bags.append((t.astype(np.int64), rnd.integers(1, 4, len(t))))
        lengths.append(int(bags[-1][1].sum()))
    named = [None if i % 37 == 5 else i for i in range(2000)]
    terms, df = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True)
    index = search.Shard(search.index_of(named, bags, lengths), 2000, 30.0, terms, df)
    for q in (terms[:3], terms[::7], terms[-20:], terms, *(bags[i][0] for i in range(0, 2000, 100))):
        n = df[np.searchsorted(terms, q)]
        for k in (1, 10):
            ids, score = index.top(q, k)
            full = np.zeros(2000, np.int64)
            idf = dict(zip(q.tolist(), (1_000_000 * np.log(1 + (2000 - n + 0.5) / (n + 0.5))).tolist(), strict=True))
            for i, (b, tf) in enumerate(bags):
                norm = 1.2 * (1 - 0.75 + 0.75 * np.float64(lengths[i]) / 30.0)
                full[i] = sum(int(np.rint(idf[t] * (f * 2.2 / (f + norm)))) for t, f in zip(b.tolist(), tf.astype(float), strict=True) if t in idf and named[i] is not None)
            want = sorted((-s, i) for i, s in enumerate(full.tolist()) if s)[:k]
            assert list(zip((-score).tolist(), ids.tolist(), strict=True)) == want
    index.scored = index.listed = 0
    for i in range(0, 2000, 50):
        index.top(bags[i][0], 5)
    assert 0 < index.scored < 0.7 * index.listed


def halves(monkeypatch):
    """Two indexes of 600 documents each, the whole of them, and queries; lists of both kinds, matrices and others."""
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "DENSE", 30)
    rnd = np.random.default_rng(2)
    bags = []
    for i in range(1200):
        t = np.unique(np.concatenate([rnd.zipf(1.3, 20) % 300, 1000 + 40 * (i % 30) + rnd.integers(0, 40, 12)])).astype(np.int64)
        bags.append((t, rnd.integers(1, 4, len(t))))
    named, lengths = [None if i % 37 == 5 else i for i in range(1200)], [int(n.sum()) for _, n in bags]
    terms, df, asked = *np.unique(np.concatenate([b[0] for b in bags]), return_counts=True), np.ones(1, int)
    made = [search.Shard(search.index_of(named[a:b], bags[a:b], lengths[a:b]), 1200, 30.0, terms, df, asked.repeat(len(terms))) for a, b in ((0, 600), (600, 1200), (0, 1200))]
    assert all(0 < (s.column >= 0).sum() < len(s.term) for s in made)
    return made, [np.searchsorted(terms, bags[i][0]) for i in range(0, 1200, 40)] + [np.zeros(0, int)], terms


def answers(shard, queries, floor, k=10):
    places = [shard.place[q] for q in queries]
    return [x.tolist() for x in shard.answer([x[x >= 0] for x in places], k, floor)]


def test_a_tile_answers_as_its_queries_one_by_one(monkeypatch):
    (_, _, whole), queries, terms = halves(monkeypatch)
    number, ids, score = answers(whole, queries, np.zeros(len(queries)))
    for i, q in enumerate(queries):
        one = [x.tolist() for x in whole.top(terms[q], 10)]
        assert one == [[x for n, x in zip(number, some, strict=True) if n == i] for some in (ids, score)]


def test_a_threshold_is_handed_on_to_the_next_shard(monkeypatch):
    (first, second, whole), queries, _ = halves(monkeypatch)
    none = np.zeros(len(queries))
    before = list(zip(*answers(first, queries, none), strict=True))
    floor = np.array([min((s for n, _, s in before if n == i), default=0) for i in range(len(queries))], float)
    answers(second, queries, none)
    alone, second.scored = second.scored, 0
    after = list(zip(*answers(second, queries, floor), strict=True))
    assert second.scored < alone and len(after) < len(before)
    merged = sorted((n, -s, i) for n, i, s in before + after)
    kept = [(n, i, -s) for j, (n, s, i) in enumerate(merged) if j < 10 or merged[j - 10][0] != n]
    assert kept == list(zip(*answers(whole, queries, none), strict=True))


def test_tiles_hold_all_queries_and_few_words(monkeypatch):
    monkeypatch.setattr(search, "TILE", 3)
    monkeypatch.setattr(search, "TILE_WORDS", 10)
    sizes = [2, 2, 2, 2, 9, 1, 1, 50, 0, 0, 4]
    made = list(search.tiles(np.append(0, np.cumsum(sizes))))
    assert [i for t, end in made for i in range(t, end)] == list(range(len(sizes)))
    assert all(end - t <= 3 and (end - t == 1 or sum(sizes[t:end]) <= 10) for t, end in made)
    assert list(search.tiles(np.zeros(1, int))) == []


def test_the_index_is_read_once_for_a_thousand_queries(spark, docs, monkeypatch):
    calls, plain = [], search.map_arrow
    monkeypatch.setattr(search, "map_arrow", lambda df, run, schema: calls.append(schema) or plain(df, run, schema))
    asked = spark.createDataFrame([(i, f"a w{i % 7}") for i in range(1000)], "query_id long, text string")
    assert search.top_k(docs(["a b", "w1 w2", "w3"]), asked, 1).count() == 1000
    assert sum("micro" in schema for schema in calls) == 1


def test_a_repeated_query_is_one(spark, docs):
    table = docs(["a b c", "b c d", "x y", "a x"])
    kind = "query_id long, text string"
    once = sorted(map(tuple, search.top_k(table, spark.createDataFrame([(1, "a b x")], kind)).collect()))
    assert sorted(map(tuple, search.top_k(table, spark.createDataFrame([(1, "a b"), (1, "x a"), (1, "a b")], kind)).collect())) == once


def test_queries_go_in_blocks(spark, docs, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(30)}" for _ in range(12)) for _ in range(60)]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    one = sorted(map(tuple, search.top_k(docs(texts), asked, 4).collect()))
    monkeypatch.setattr(search, "QUERIES", 25)
    assert sorted(map(tuple, search.top_k(docs(texts), asked, 4, shard=20).collect())) == one


def test_odd_rows(spark, odd):
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "one END"), (4, "nowhere"), (None, "one")], "query_id long, text string")
    rows = search.top_k(odd, asked).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows if r["rank"] <= 3] == [(3, 7), (3, 7), (3, 8)]
    assert {r["query_id"] for r in rows} == {3} and {r["doc_id"] for r in rows} == {7, 8, 9}
    assert search.top_k(odd.limit(0), asked).count() == 0
    assert search.top_k(odd, asked.limit(0)).count() == 0


def test_sql(against_sql):
    against_sql(QUERIES["op1_block_max_wand"], ORACLE_SQL["op1_block_max_wand"])
