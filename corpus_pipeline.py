"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's docs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm import bpe, common, exact_dedup, mixing, quality_knn, simhash
from veritome.shipping import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    score = common.free_name(docs.columns, "score")
    judged = quality_knn.judge(settle(spark), docs, sf_dir, keep=docs.columns, score_col=score)
    return judged.filter(F.col(score) >= quality_knn.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    settle(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the one with the smallest id stays."""
    settle(spark)
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights by whole documents; repeated documents are repeated rows."""
    settle(spark)
    return mixing.mix_documents(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token counts and digests of its ids and decoded texts."""
    settle(spark)
    return bpe.digest_documents(docs, bpe.vocabulary(VOCABULARY))


VOCABULARY = "word_bpe_49k.json"
STAGES: list[tuple[str, Stage]] = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("mix_sources", mix), ("bpe_encode", encode)]

#: SQL can't express the classifier, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; the folders of the others are removed once the next stage is written."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.remove(spark, f"{folder}/{k - 1}")
    return docs
