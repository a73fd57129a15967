"""One query per operator over its whole table. Each takes (session, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.centroids import cluster_report
from candlemill.llm.collocations import collocations
from candlemill.llm.common import read
from candlemill.llm.exact_dedup import exact_dedup
from candlemill.llm.html_text import extract_text
from candlemill.llm.line_dedup import line_report
from candlemill.llm.mixing import mix_report
from candlemill.llm.packing import pack_documents
from candlemill.llm.pseudonyms import pseudonymise
from candlemill.llm.quality_classifier import quality_scores
from candlemill.llm.quality_rules import quality_report
from candlemill.llm.sharding import shard_documents
from candlemill.llm.simhash import near_duplicates
from candlemill.llm.toxicity import toxicity_scores


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(read(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text")


# Whoever uses the operator brings their own key; this one is for the query alone.
QUERY_KEY = "candlemill query key"


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(read(spark, folder, "documents").select("doc_id", "text"), QUERY_KEY)


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_documents(read(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(read(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read(spark, folder, "documents"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_report(spark, read(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_html": op5_html,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_centroids": op13_centroids,
}
