import hashlib
import random

from pyspark.sql import functions as F

from tidelog.llm import fingerprint


def test_edits_against_brute_force(spark, docs):
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(40))) + "é漢" for _ in range(60)]
    ids = rnd.sample(range(1000), 60)
    rows = sorted(zip(ids, texts, strict=True), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.against_edited(docs(rows[::2] + rows[1::2])).collect()}
    assert len(got) == 60
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[1][:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        mine = got[i]["fingerprint"].split(".")
        assert len(mine) == fingerprint.SLOTS
        for near, other in (("near_edited", got[i]["edited_fingerprint"]), ("near_next", got[after[0]]["fingerprint"])):
            theirs = other.split(".")
            filled = sum(a != "" or b != "" for a, b in zip(mine, theirs, strict=True))
            equal = sum(a == b != "" for a, b in zip(mine, theirs, strict=True))
            assert abs(got[i][near] - (1.0 if mine == theirs else equal / filled if filled else 0.0)) < 1e-12


def xxhash(spark, rows):
    """Spark's 64-bit hash of each array of numbers."""
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<long>")
    return [x[0] for x in table.orderBy("i").select(F.xxhash64("r")).collect()]


def test_whole_fingerprints_by_brute_force(spark, docs):
    """Band by counting, distinct terms sorted, and each lexicon's terms picked out one by one and hashed."""
    rnd = random.Random(6)
    texts = ["common " + " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.choice((3, 40, 200)))) for _ in range(40)] + ["common only", "!!!", ""]
    table, words = docs(texts), sorted({w for t in texts for w in t.split()} - {"!!!"})
    number = dict(zip(words, (x[0] for x in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()), strict=True))
    df = {w: sum(w in t.split() for t in texts) for w in words}
    band = {w for w in words if 2 <= df[w] <= 0.5 * len(texts)}
    lexicon = fingerprint.lexicon(table, 0.01, 0.5)
    assert {r["term"] for r in lexicon.collect()} == {number[w] for w in band} and "common" not in band
    size, want = 1 << 64, []
    for t in texts[:-3]:
        own = set(t.split())
        some = own & band if len(own & band) >= fingerprint.SPARSE * len(own) else own
        held = sorted(number[w] & -4 | 2 | (w in band) for w in some)
        rows = [held]
        for i in range(1 << fingerprint.SPLIT):
            low = -size // 2 + i * (size >> fingerprint.SPLIT)
            for rate in reversed(fingerprint.RATES):
                high = low + (size >> rate)
                inner = [low + (size >> r) for r in fingerprint.RATES if r > rate]
                terms = [x for x in held if low <= x < high]
                rows.append(sorted([*terms, *inner]) if terms else None)
        hashes = iter(xxhash(spark, [r for r in rows if r is not None]))
        want.append([next(hashes) if r is not None else 0 for r in rows])
    got = [r["f"] for r in fingerprint.fingerprints(table, {"f": "text"}, lexicon, ["doc_id"]).orderBy("doc_id").collect()]
    assert got[: len(want)] == want
    # Without terms of its own a text is told by itself.
    assert len({tuple(x) for x in got[-2:]}) == 2 and all(any(x) for x in got[-2:])


def test_the_number_of_parts_changes_nothing(spark, docs):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, rnd.randrange(60), rnd.randrange(1 << 60), -rnd.randrange(1 << 62)]), " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(12)))) for _ in range(150)]
    table = docs(rows)
    one = sorted(map(repr, fingerprint.against_edited(table, parts=1).collect()))
    assert len(one) == 150
    for parts in (4, 2000):
        assert sorted(map(repr, fingerprint.against_edited(table, parts=parts).collect())) == one


def test_terms_out_of_the_band_change_nothing(spark, docs):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(600)}" for _ in range(30)) for _ in range(50)]
    texts += [texts[0] + " rareword", " ".join(reversed(texts[0].split())).upper()]
    rows = {r["doc_id"]: r["fingerprint"] for r in fingerprint.against_edited(docs(texts)).collect()}
    assert rows[0] == rows[50] == rows[51] and rows[0] != rows[1]


def test_a_text_that_a_third_of_the_rows_copy(docs):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(40)) for _ in range(80)]
    hot = texts[0]
    texts[1] = hot.replace(hot.split()[7], "other")
    rows = [*enumerate(texts), *((1000 + i, hot) for i in range(40))]
    got = {r["doc_id"]: r for r in fingerprint.against_edited(docs(rows)).collect()}
    for i in range(1, 40):  # the next of each copy but the first is a copy
        assert got[1000 + i]["near_next"] == 1.0
    assert len({got[i]["fingerprint"] for i in (0, *range(1000, 1040))}) == 1 and got[1000]["near_edited"] > 0.02
    assert got[1]["near_next"] > 0.3  # a near copy, before the text itself


def test_texts_out_of_the_band_are_graded(docs):
    """Near copies, each a different text, that hold most of the rows: no term of theirs is in the band."""
    hot = [f"h{i}" for i in range(40)]
    rnd = random.Random(5)
    near = [(i, " ".join([*hot[: i % 40], f"own{i}", *hot[i % 40 + 1 :]])) for i in range(40)]
    far = [(100 + i, " ".join(f"w{rnd.randrange(900)}" for _ in range(40))) for i in range(60)]
    got = {r["doc_id"]: r for r in fingerprint.against_edited(docs([*near, *far])).collect()}
    assert all(0.3 < got[i]["near_next"] < 1 for i in range(1, 40))
    assert all(got[i]["near_edited"] > 0 for i in range(1, 40))
    assert all(got[i]["near_next"] < 0.2 for i in range(101, 160))


def test_large_lexicons_are_joined(docs, monkeypatch):
    rnd = random.Random(3)
    table = docs([" ".join(f"w{rnd.randrange(50)}" for _ in range(30)) for _ in range(50)])
    broad = sorted(map(tuple, fingerprint.against_edited(table).collect()))
    monkeypatch.setattr(fingerprint, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, fingerprint.against_edited(table).collect())) == broad


def test_odd_rows(odd, docs):
    got = fingerprint.against_edited(odd).collect()
    assert len(got) == odd.count()
    same = {r["fingerprint"] for r in got if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    empty = [r for r in got if r["doc_id"] in (5, 6)]
    assert {(r["n_chars"], r["edited_sha256"]) for r in empty} == {(0, hashlib.sha256(b"").hexdigest())} and len({r["fingerprint"] for r in empty}) == 1
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprint.against_edited(odd.limit(0)).count() == 0
    alone = fingerprint.against_edited(docs([(4, "one two three")])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(("one two three"[:7] + "one tw").encode()).hexdigest()


def test_no_python_in_the_plan(docs):
    plan = fingerprint.against_edited(docs(["a b", "b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
