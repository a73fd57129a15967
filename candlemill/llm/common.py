"""What the operators of this folder share.

A null text counts as empty everywhere here. Words are maximal runs of anything but ASCII white space
(``bytes.split()`` cuts at exactly those characters).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.session import prepare

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """The rows whose labels no model may see. A null id is not held out (and is never fitted on)."""
    text = F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 4 == 2, F.lit(False))


def running(df: DataFrame, by: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``by`` that come before this one in the
    order (chunk, order).

    A group is never sorted in one task: each chunk is sorted by itself, and the chunks' totals, one row for
    each chunk, give where it starts. Chunks are to be of a bounded size and must follow from a row's own
    values, so that a task that runs again finds the same. ``by`` and ``chunk`` must not be null.
    """
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(*before)
    totals = df.groupBy(*by, chunk).agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*by).orderBy(chunk) if by else Window.orderBy(chunk)
    starts = totals.select(*by, chunk, F.coalesce(F.sum("_total").over(over.rowsBetween(*before)), F.lit(0)).alias("_start"))
    return (
        df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*by, chunk])
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_start")
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents that are not held out: a classifier's sample.

    Which ones is decided by a hash of the id, so reruns agree. An id labelled twice has the larger label, and of an id
    with several documents the text that sorts first is taken, so the bound holds for rows too. Null ids and labels are
    left out. If no more ids qualify, all are taken. The sample's ids are few by the bound, so they are broadcast and
    the documents stay where they are.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    )
    share = min(1.0, 1.2 * most / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ids = known.where(draw < int(share * (1 << 30)) + 1).orderBy(draw, "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("label"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column's UTF-8 bytes; null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, or put in place of those of the same name."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in new]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), *new.values()], [*(batch.schema.names[i] for i in kept), *new])


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def extended(schema, new: str):
    """The schema ``with_columns`` leads to; ``new`` in DDL."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    return StructType([f for f in schema.fields if f.name not in added.names] + added.fields)
