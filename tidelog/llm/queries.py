"""The operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, dedup, fingerprint, html, langid, packing, quality, search, warc
from tidelog.llm.common import table


def op1_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the whole texts of the documents whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_imatch_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_edited(table(spark, sf_dir, "documents"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """ranks: the rank file's path on the driver; workers get its bytes."""
    import public_tokenizers

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    return bpe.round_trip(table(spark, sf_dir, "documents"), data, public_tokenizers.PATTERN)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, logs = langid.fit(docs.where(~langid.held_out()))
    # The fold depends on the id alone, so it may pass by the predictor as its id column does.
    rows = docs.select(F.struct("doc_id", langid.held_out().alias("held_out")).alias("row"), "text")
    return langid.predict(rows, langs, logs, "row").select("row.doc_id", "row.held_out", "lang_pred", "score", "langs", "shares")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_block_max_wand,
        op2_importance_resampling,
        op3_length_buckets,
        op4_imatch_lexicons,
        op5_hyperminhash,
        op6_warc_segments,
        op7_snapshot_collapse,
        op8_site_style_tree,
        op9_bpe_transducer,
        op10_language_mixture,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_block_max_wand": search.TOP_K_SQL, "op6_warc_segments": warc.ROUND_TRIP_SQL, "op7_snapshot_collapse": chat.COLLAPSE_SQL}
