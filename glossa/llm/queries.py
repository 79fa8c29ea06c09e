"""Queries of this subpackage over the synthetic tables, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltree, impact, licenses, lmscore, minhash, mixing, quality, secrets, tokencounts
from .common import scratch, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is divisible by 20, each against all documents but itself."""
    docs = table(spark, sf_dir, "documents")
    return lmscore.lm_scores(docs.where("doc_id % 20 = 0"), docs, id_col="doc_id", inside=True)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = tokencounts.TokenCountParams.vocabulary, cache: str | None = None) -> DataFrame:
    # A new cache for each call, so that every distinct text is encoded; a service would name a lasting folder.
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), cache or scratch(spark, "token-cache"), tokencounts.TokenCountParams(vocabulary))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled pages are those whose URL ends in the number of the document that they show."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.select("page_id", F.regexp_extract("url", r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", 1).alias("n")).where("n != ''")
    # Bounded before documents are read: the labelled sample is a parameter of the operator.
    shown = shown.orderBy(F.xxhash64("page_id"), "page_id").limit(htmltree.HtmlParams().max_train_pages)
    labelled = table(spark, sf_dir, "documents").join(F.broadcast(shown), F.col("doc_id") == F.col("n").cast("long")).select("page_id", F.col("text").alias("content"))
    return htmltree.extracted(pages, labelled)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_topk_search": op2_topk_search,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_source_mixing": op4_source_mixing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_html_extraction": op9_html_extraction,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_topk_search": impact.ORACLE,
}
