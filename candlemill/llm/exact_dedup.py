"""Exact dedup: one row of each group of equal texts stays, the one with the smallest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import SPACES
from candlemill.session import stage


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """The first 128 bits of the SHA-256 of a normalised text, in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def _groups(docs: DataFrame, hash_of) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents with (_text, _hash); per hash (keep_id, group_size, variants); and, only if texts that differ
    share a hash, the same per hash and text.

    Rows are grouped by hash *and* bytes, so equal hashes are never taken for equal texts. Copies within a task
    are merged before the shuffle, which takes each distinct text there once, however many copies it has.
    """
    texts = docs.withColumn("_text", normalised(F.col("text")))
    keyed = texts.withColumn("_hash", hash_of(F.col("_text"))).withColumn("_sha", F.sha2("_text", 256))
    # a null id counts as the largest
    equal = keyed.groupBy("_hash", "_text").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_size"))
    merged = equal.groupBy("_hash").agg(
        F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"), F.count("*").alias("_variants"))
    by_hash = stage(merged, "content-hashes")
    collided = by_hash.where("_variants > 1").select("_hash")
    if collided.isEmpty():
        return keyed, by_hash.drop("_variants"), None
    return keyed, by_hash.where("_variants = 1").drop("_variants"), equal.join(collided, "_hash", "left_semi")


def exact_dedup(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, duplicates included.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; null counts as
    empty, and empty texts are copies of one another. A row that is repeated (same id and text) counts in
    group_size and has the flag of its id. A null id never wins over another; rows that all lack an id have
    keep_id null and are kept. Other columns are not read. An empty table gives an empty result.

    A hash that a third of all rows share makes one row per task in the grouping, and its partition is split by
    Spark when the documents meet the groups.
    """
    keyed, by_hash, by_text = _groups(docs.select("doc_id", "text"), hash_of)
    # the bytes have been compared: from here on a hash stands for its text, unless another text shares it
    found = keyed.select("doc_id", "_sha", "_hash").join(by_hash, "_hash")
    if by_text is not None:
        found = found.unionByName(keyed.join(by_text, ["_hash", "_text"]).select(found.columns))
    return found.select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns (whatever their names); of a repeated row one."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias("_id")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    keyed, by_hash, by_text = _groups(rows, hash_of)
    keyed = keyed.select("_hash", "_text", name("doc_id"), "_row")
    won = by_hash.select("_hash", name("_keep"))
    kept = keyed.join(won, ["_hash", "_id"], "left_semi").dropDuplicates(["_hash", "_id"])
    if by_text is not None:
        keys = ["_hash", "_text", "_id"]
        kept = kept.unionByName(
            keyed.join(by_text.select("_hash", "_text", name("_keep")), keys, "left_semi").dropDuplicates(keys).select(kept.columns))
    return kept.select("_row.*")
