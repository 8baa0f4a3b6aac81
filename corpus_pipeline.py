"""From raw documents to training batches: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() applies them to the table of documents, each
result written as Parquet and read as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import dedup, langid, packing, quality
from tidelog.llm.common import shared_dir, table

#: A document is of a language if one has this share of it at least.
LEAST_SHARE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects, with all columns of docs.

    Null and empty texts weigh nothing for or against and stay; a null id has no label; rows that share an id share its label and
    its draw; rows that tie with the last one selected are selected too; an empty table, or one without good labels, stays as it is.
    """
    return quality.select(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one of the learned languages has LEAST_SHARE or more, with all columns of docs.

    `und` (null, empty, without a letter) and mixtures without a main language go. Rows without a language or text teach nothing; a
    null id is learned from; equal texts fare alike, repeated rows too; of languages with equal shares the first by name counts;
    an empty table gives an empty one.
    """
    langs, logs = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text")
    return langid.predict(rows, langs, logs, "row").where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, with all columns of docs.

    Texts without words are like nothing and stay, rows with a null id too; rows that share an id are one document and stay or go
    together; an empty table gives an empty one.
    """
    return dedup.distinct_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each row, and nothing else of docs.

    Null and empty texts have no tokens and are packed all the same; a text over the budget is a batch by itself; null ids come
    first in their part; repeated rows are packed each, and equal ones tie either way; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", dedup_stage), ("packing", packing_stage)]

#: SQL has no way to say the Gumbel draw, expectation-maximisation, the components or the dynamic program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
