import random
from itertools import combinations

import numpy as np
from brute_force import least_padding, words

from tidelog.llm import packing
from tidelog.llm.queries import QUERIES


def padding(tops, lengths, counts):
    return sum((min(t for t in tops if t >= n) - n) * c for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rnd = random.Random(1)
    for _ in range(30):
        lengths = sorted(rnd.sample(range(100), rnd.randrange(1, 9)))
        counts = [rnd.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3, 8):
            tops = packing.boundaries(np.array(lengths), np.array(counts), k)
            best = min(padding([*some, lengths[-1]], lengths, counts) for n in range(k) for some in combinations(lengths[:-1], min(n, len(lengths) - 1)))
            assert len(tops) <= k and padding(tops, lengths, counts) == best
    assert packing.boundaries(np.zeros(0), np.zeros(0), 3) == []


def check(rows, table, buckets, budget):
    assert len(rows) == table.count()
    tops = sorted({r["bucket_len"] for r in rows})
    assert len(tops) <= buckets
    batches = {}
    for r in rows:
        assert r["bucket_len"] == min(t for t in tops if t >= r["n_tokens"])
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r["slot"])
    per = {}
    for (bucket, batch), slots in batches.items():
        room = max(1, budget // max(1, tops[bucket]))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room
        per.setdefault(bucket, []).append(len(slots) < room)
    assert all(sum(short) <= 1 for short in per.values())


def test_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 20)
    rnd = random.Random(3)
    table = docs([" ".join(["w"] * rnd.choice([3, 3, 3, 40, rnd.randrange(200)])) for _ in range(400)])
    check(packing.pack(table, 4, 300).collect(), table, 4, 300)


def test_long_texts_waste_least(docs):
    lengths = [3, 900, 4097, 4099, 5003, 5129, 8193, 9001, 20_021]
    counts = [5, 2, 3, 1, 4, 2, 3, 1, 1]
    rows = packing.pack(docs(["w " * n for n, c in zip(lengths, counts, strict=True) for _ in range(c)]), 4).collect()
    best = min(padding([*some, lengths[-1]], lengths, counts) for some in combinations(lengths[:-1], 3))
    assert sum(r["padding"] for r in rows) == best and {r["bucket_len"] for r in rows} <= set(lengths)


def test_the_whole_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op3_length_buckets"](spark, sf_dir).collect()
    check(rows, docs, 8, 65_536)
    n = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == n
    assert sum(r["padding"] for r in rows) == least_padding(list(n.values()), 8)


def test_many_lengths_as_by_all_splits():
    rnd = np.random.default_rng(2)
    lengths, counts = np.sort(rnd.choice(9000, 300, replace=False)), rnd.integers(1, 50, 300)
    cost = [0] + [float("inf")] * 300
    for _ in range(5):
        cost = [0] + [min(cost[i] + int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum()) for i in range(j)) for j in range(1, 301)]
    assert padding(packing.boundaries(lengths, counts, 5), lengths.tolist(), counts.tolist()) == cost[300]


def test_odd_rows(odd):
    rows = packing.pack(odd, 3, 50).collect()
    check(rows, odd, 3, 50)
    assert {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"]} == {5: 0, 6: 0, 7: 6, 8: 6, 9: 60_001, 10: 0, 11: 1, 12: 1}
    assert packing.pack(odd.limit(0)).count() == 0
