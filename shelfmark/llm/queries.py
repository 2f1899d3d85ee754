"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, toxicity, treap_search
from .bpe_stream import transcode_digests
from .common import drop_scratch, held_out
from .language_id import identify
from .language_id import train as train_languages
from .line_dedup import dedup_lines
from .media_columns import document_media
from .mixing import mix_plan
from .ngram_join import components
from .ngram_join import oracle as components_sql
from .packing import pack_documents
from .spelling import spelling_variants
from .spot_signatures import fingerprint_documents
from .substring_dedup import remove_repeats

__all__ = ["drop_scratch", "oracle_sql", "queries"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_documents(spark, sf_dir), words_each=3, percent=90)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_documents(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir)).drop("ids")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_sentence", "sentence_score"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), with_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_documents(spark, sf_dir), drop_each=31)


def op12_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode_digests(_documents(spark, sf_dir))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return treap_search.search_documents(_documents(spark, sf_dir), items)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_fingerprints": op2_fingerprints,
        "op3_media_columns": op3_media_columns,
        "op4_packing": op4_packing,
        "op5_license_scan": op5_license_scan,
        "op6_toxicity": op6_toxicity,
        "op7_mixing": op7_mixing,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_language_id": op9_language_id,
        "op10_line_dedup": op10_line_dedup,
        "op11_spelling": op11_spelling,
        "op12_bpe_stream": op12_bpe_stream,
        "op13_treap_search": op13_treap_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": components_sql(words_each=3, percent=90),
        "op5_license_scan": license_scan.oracle(),
        "op13_treap_search": treap_search.oracle(),
    }
