import random

import numpy as np
import pytest
from brute_force import held_out, languages
from pyspark.sql import functions as F

from tidelog.llm import langid
from tidelog.llm.queries import QUERIES

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "er", "ein"], "cc": ["ão", "zh", "pr", "vy"]}


def text_of(lang, n, rnd):
    return " ".join("".join(rnd.choices(SOUNDS[lang], k=3)) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(i, text_of(lang, 30, rnd), lang) for i, lang in enumerate(list(SOUNDS) * 20)] + [(99, None, "aa"), (98, "ka lo", None)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_counts_by_hand(spark, model):
    langs, logs = model
    assert langs == ["aa", "bb", "cc"]
    assert np.allclose(np.exp(logs).sum(1), 1)
    assert langid.trigrams("A1b").sum() == langid.trigrams("a b").sum() == 3  # _a_ a_b _b_
    assert langid.trigrams("abc").tolist() == langid.trigrams("!!ABC??").tolist()
    assert not langid.trigrams("12 !?").any()


def test_spans_change_nothing(monkeypatch):
    t = "Some words, 12 of them: áé 漢字 and so on. " * 20
    whole = langid.trigrams(t)
    for n in (1, 2, 7, 50):
        monkeypatch.setattr(langid, "SPAN", n)
        assert (langid.trigrams(t) == whole).all()


def test_mixtures_and_single_languages(model):
    langs, logs = model
    rnd = random.Random(2)
    for lang in SOUNDS:
        found, share = langid.infer(logs, langid.trigrams(text_of(lang, 20, rnd)))
        assert [langs[i] for i in found] == [lang] and share == [1.0]
    found, share = langid.infer(logs, langid.trigrams(text_of("aa", 60, rnd) + " " + text_of("cc", 30, rnd)))
    assert [langs[i] for i in found] == ["aa", "cc"]
    assert abs(share[0] - 2 / 3) < 0.1 and abs(sum(share) - 1) < 1e-6


def test_em_raises_the_likelihood(model):
    _, logs = model
    rnd = random.Random(3)
    counts = langid.trigrams(text_of("aa", 20, rnd) + " " + text_of("bb", 20, rnd))
    at = np.flatnonzero(counts)
    p = np.exp(logs[:, at])
    values = [counts[at] @ np.log(langid.proportions(p, counts[at], r) @ p) for r in range(8)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False))


def test_odd_rows(odd, model):
    rows = langid.predict(odd, *model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (5, 6, 10, 12):
            assert (r["lang_pred"], r["score"], r["langs"]) == ("und", 0.0, [])
        assert 0 <= r["score"] <= 1
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 7}) == 1
    assert langid.predict(odd.limit(0), *model).count() == 0
    nothing = langid.fit(odd.where("lang = 'none'"))
    assert nothing[0] == [] and {r["lang_pred"] for r in langid.predict(odd, *nothing).collect()} == {"und"}


def test_the_whole_query_by_brute_force(spark, sf_dir):
    """Trigrams counted and proportions estimated one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = languages(docs.select("doc_id", "text", "lang").collect())
    rows = QUERIES["op10_language_mixture"](spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r
        assert r["held_out"] == held_out(r["doc_id"])


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_mixture"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id")
    assert rows.where("lang = lang_pred").count() >= 0.98 * rows.count() > 0
    fold = truth.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert fold.count() == rows.count()
