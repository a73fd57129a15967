"""From raw documents to packed training sequences: quality rules, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes what the one before kept, in the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlemill.llm.common import read
from candlemill.llm.exact_dedup import drop_copies
from candlemill.llm.mixing import mix
from candlemill.llm.packing import pack_documents
from candlemill.llm.quality_rules import fit_rules, keep_good
from candlemill.llm.queries import tokenizer_path
from candlemill.llm.simhash import drop_near_duplicates
from candlemill.session import fresh_path, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The trees are fitted on the labels of ``sf_dir``."""
    prepare(spark)
    return keep_good(docs, fit_rules(docs, read(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return drop_copies(docs)


# Of their runs of five words, what near copies have in common at least.
NEAR_COPY = 0.8


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return drop_near_duplicates(docs, similarity=NEAR_COPY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in the order of training."""
    prepare(spark)
    return mix(docs, position="_position").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 ids, one row per piece of a document."""
    prepare(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
# The trees of the first stage, the links of the third and the tokenizer of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        schema = docs.schema
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
