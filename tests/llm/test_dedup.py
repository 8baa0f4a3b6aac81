import random

import numpy as np
import pytest
from brute_force import components, shingle_set

from tidelog.llm import dedup


def check(docs, rows):
    got = dedup.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    want = components(rows)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingle_set(t)))
    for r in got:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_families_chains_and_shared_passages(docs):
    rnd = random.Random(1)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 5, 8, 20, 60, 300]))]
        for _ in range(rnd.randrange(1, 8)):
            copy = list(base)
            for _ in range(rnd.randrange(1 + len(copy) // 25)):
                copy[rnd.randrange(len(copy))] = word()
            base = copy if rnd.random() < 0.5 else base  # a chain drifts away from where it began
            rows.append(" ".join(copy).title() if rnd.random() < 0.3 else "\n".join(copy))
    rows += [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))]) for _ in range(40)]
    rnd.shuffle(rows)
    check(docs, list(enumerate(rows)))


def test_at_the_threshold(docs):
    base = [f"a{i}" for i in range(104)]  # 100 shingles
    cut = [base[:n] for n in (104, 79, 78)]  # 75 of 100 in common, 74 of 100
    check(docs, [(i, " ".join(c)) for i, c in enumerate(cut)])
    rows = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(docs([" ".join(c) for c in cut[::2]])).collect()}
    assert rows == {0: 0, 1: 1}


def test_odd_rows(docs, odd):
    got = dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[8]["component_id"], by[7]["component_id"], by[8]["kept"]) == (7, 7, False)
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (5, 6, 10))
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    kept = dedup.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 1
    assert dedup.near_duplicates(odd.limit(0)).count() == 0
    check(docs, [(1, "x y z"), (1, "other words here"), (2, "x y z"), (3, "OTHER words\there"), (4, "x y z q")])
    check(docs, [(0, "x y z"), (5, "x y z"), (5, "other words here"), (5, None), (7, "other words here"), (8, "p q"), (7, "p q"), (9, "alone")])


def test_without_broadcasts(docs, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    test_families_chains_and_shared_passages(docs)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 120 + i) for i in range(30)] + [(200 + rnd.randrange(60), 200 + rnd.randrange(60)) for _ in range(40)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a)
        least.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in least.items() if k not in alone}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("n", "share"), [(9, 7 / 9), (40, 0.75), (400, 0.75), (3000, 0.8)])
def test_registers_match_by_similarity(n, share):
    rnd = np.random.default_rng(n)
    bands = []
    for _ in range(60):
        u = rnd.integers(0, 1 << 64, n, dtype=np.uint64)
        common = round(n * share)
        half = common + (n - common) // 2
        a, b = np.sort(u[:half]), np.sort(np.concatenate([u[:common], u[half:]]))
        x, y = dedup.registers(a), dedup.registers(b)
        bands.append(np.isin(dedup.band_keys(x), dedup.band_keys(y)).sum())
        j, used = dedup.estimate(x[None], y[None])
        assert abs(j[0] - common / n) < 6 * np.sqrt(0.2 / used[0]) + 0.01
    assert min(bands) > 0
    assert abs(np.mean(bands) / dedup.BANDS - share**dedup.ROWS) < 0.08


def test_hot_keys_are_dealt_into_tiles(spark, monkeypatch):
    """One key that hundreds of unlike documents and one large component share: small tasks, and no link lost."""
    monkeypatch.setattr(dedup, "PAIR_BLOCK", 40)
    rnd, sets, component = np.random.default_rng(8), {}, {}
    for i in range(500):
        sets[i], component[i] = np.unique(rnd.integers(0, 1 << 64, int(rnd.integers(20, 90)), dtype=np.uint64)), i
    for i in range(500, 560):  # near copies of the others, and a component of equal ones
        base = sets[i - 500]
        sets[i], component[i] = np.unique(np.concatenate([base[: len(base) - len(base) // 10], rnd.integers(0, 1 << 64, 2, dtype=np.uint64)])), i
    for i in range(600, 760):
        sets[i], component[i] = sets[3][:-1], 600
    placed = spark.createDataFrame([(7, i, c) for i, c in component.items()], "key long, node long, component long")
    table = spark.createDataFrame([(i, len(s), bytearray(dedup.brief(s))) for i, s in sets.items()], "node long, n long, brief binary")
    tiles = dedup.tiles(placed, table)
    assert tiles.groupBy("key", "size", "tile", "left", "right").count().agg({"count": "max"}).first()[0] <= 4 * dedup.PAIR_BLOCK
    got = {tuple(r) for r in dedup.across(placed, table).collect()}
    assert all(component[a] != component[b] and a < b for a, b in got)
    for a in sets:
        for b in sets:
            if a < b and component[a] != component[b] and dedup.SHARE[1] * min(len(sets[a]), len(sets[b])) >= dedup.SHARE[0] * max(len(sets[a]), len(sets[b])):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    assert (a, b) in got
    assert len(got) < 400


def test_candidates_lose_no_link(monkeypatch):
    monkeypatch.setattr(dedup, "BRIEF", 300)
    rnd = np.random.default_rng(1)
    for n in (5, 100, 290, 310, 2000):
        base = rnd.integers(0, 1 << 64, n, dtype=np.uint64)
        sets = []
        for share in rnd.random(60):
            keep = base[rnd.random(n) < 0.6 + share / 2]
            sets.append(np.unique(np.concatenate([keep, rnd.integers(0, 1 << 64, int(n * (1 - share) / 3), dtype=np.uint64)])))
        sets = [s for s in sets if len(s)]
        sizes, briefs = np.array([len(s) for s in sets]), [np.frombuffer(dedup.brief(s), np.uint16) for s in sets]
        for i in range(len(sets)):
            found = set(dedup.candidates(i, np.arange(len(sets)), sizes, briefs).tolist())
            for j in range(len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    assert j in found
