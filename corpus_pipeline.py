"""A training corpus from documents: quality classifier, near-dedup, benchmark decontamination, secret scan, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the columns of
documents. All of them bear null ids, null, empty, blank and very long texts, repeated rows, ties, empty tables and further columns of
any name; what becomes of such rows is said at each stage. run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import decontaminate, minhash, mixing, quality, secrets
from glossa.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject.

    Null, empty and blank texts go; null ids don't matter; repeated rows stay or go together; without labels all others stay.
    """
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null ids and texts without words stay; repeated rows of an id stay or go together; an id of different texts stays with all of them.
    """
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null ids, null and empty texts stay; all rows of an id go if one contains an item; null and empty items match nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; null and empty texts stay as they are, repeated rows stay equal."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them, with their rate and the number of the copy.

    Null sources and languages are categories of their own; rows of one id, null included, get the largest rate and copies among them.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL can state none of the stages (trained models, sketches, iterations): tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
