import corpus_pipeline
from brute_force import components, expected_number, languages, least_padding, quality_weights, words
from pyspark.sql import functions as F

from tidelog.llm import dedup, langid, packing, quality


def test_stages_against_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]

    def rows(df):
        return sorted(map(tuple, df.collect()))

    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    chosen = {r["doc_id"] for r in quality.classify(docs, labels).where("selected").collect()}
    assert rows(good) == rows(docs.where(docs["doc_id"].isin(list(chosen))))
    assert labels.where("quality = 1 AND toxic = 0").join(docs, "doc_id").join(good, "doc_id", "left_anti").count() == 0

    known = stages["language"](spark, good, sf_dir)
    model = langid.fit(good.where(~langid.held_out()))
    sure = {r["doc_id"] for r in langid.predict(good, *model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SHARE}
    assert rows(known) == rows(good.where(good["doc_id"].isin(list(sure))))

    single = stages["near_duplicates"](spark, known, sf_dir)
    kept = {r["doc_id"] for r in dedup.near_duplicates(known).where("kept").collect()}
    assert rows(single) == rows(known.where(known["doc_id"].isin(list(kept))))

    assert rows(stages["packing"](spark, single, sf_dir)) == rows(packing.pack(single)) == rows(corpus_pipeline.run(spark, sf_dir))


def test_the_whole_pipeline_by_brute_force(spark, sf_dir):
    """Each stage by plain loops over what the one before it left; only the Gumbel draw is the operator's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    noise = dict(map(tuple, docs.select("doc_id", quality.gumbel_noise(F.col("doc_id"), 17)).collect()))
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    weight = quality_weights({i: r["text"] for i, r in rows.items()}, good)
    rows = {i: rows[i] for i in sorted(rows, key=lambda i: -weight[i] - noise[i])[: expected_number(weight)]}
    found = languages([tuple(r) for r in rows.values()])
    rows = {i: r for i, r in rows.items() if found[i][0] != "und" and found[i][1] >= corpus_pipeline.LEAST_SHARE}
    rows = {i: rows[i] for i, least in components([(i, r["text"]) for i, r in rows.items()]).items() if i == least}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(words(r["text"])) for i, r in rows.items()} and len(got) == len(rows)
    assert sum(r["padding"] for r in got) == least_padding([r["n_tokens"] for r in got], 8)


def test_odd_rows(spark, sf_dir, odd):
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.dedup_stage(spark, odd, sf_dir).count() == odd.count() - 1
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, odd, sf_dir).collect()} == set()
    packed = corpus_pipeline.packing_stage(spark, odd.drop("source", "n_chars", "lang"), sf_dir)
    assert packed.count() == odd.count() and {r["padding"] for r in packed.where("padding < 0").collect()} == set()
    assert corpus_pipeline.packing_stage(spark, odd.limit(0), sf_dir).count() == 0
