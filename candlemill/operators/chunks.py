"""Ordered work on one key, cut into pieces that are spread over the cluster.

A symbol may own a third of all rows, so no operator here sorts or folds a whole symbol in one task.
Rows are cut into *chunks*: consecutive stretches of a key's order. What one chunk needs from the rows
before it is small (a few rows, or the state of a recurrence) and reaches it through a table with one
row per chunk.

Bars have at most one row per bucket, so a chunk of ``SPAN`` buckets holds at most ``SPAN`` bars and
a symbol has at most (its time range / SPAN buckets) chunks, however many trades it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.functions.columns import floor_div
from candlemill.session import stage

SPAN = 4096
BLOCK = 1024
CHUNK = "_chunk"
HALO = "_halo"


def bucket_chunk(order: str = "group_id", span: int = SPAN) -> Column:
    return floor_div(order, span)


ROWS = "_rows"
BROADCAST_CHUNKS = 100_000


def packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """A stored table with one row per chunk: keys, ``CHUNK`` and ``ROWS``, an array of its rows in order.

    This is the one time the rows move. What is read of it later are the columns needed, an array each.
    """
    cut = df.withColumn(CHUNK, chunk.cast("long"))
    row = F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])
    rows = cut.select(*keys, CHUNK, row.alias("_row")).groupBy(*keys, CHUNK)
    return stage(rows.agg(F.sort_array(F.collect_list("_row")).alias(ROWS)), "chunks")


def packed_by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int = 2 * SPAN, piece_rows: int | None = None) -> DataFrame:
    """The same for rows of any density (ticks, say), in chunks of at most ``chunk_rows`` rows.

    A range partition over (keys, order) splits a hot key; within a sorted part rows are cut off as they come, so they
    move this once. The cut depends on Spark's sample of the rows, but the result is written: every
    later pass, and every retry, sees the same chunks. Chunks of a key are numbered in its order.
    """
    columns = [*order, *[c for c in df.columns if c not in (*keys, *order)]]
    parts = [max(1, ceil(df.count() / piece_rows))] if piece_rows else []
    rows = df.select(*keys, *columns).repartitionByRange(*parts, *keys, *order).sortWithinPartitions(*keys, *order)
    numbered = rows.select(F.monotonically_increasing_id().alias(CHUNK), *rows.columns)
    names = list(keys)

    def pack(batches):
        """A key's rows lie side by side: cut where the key changes, and every ``chunk_rows`` rows."""
        held, size = [], 0

        def row(parts):
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            whole = pa.StructArray.from_arrays([table.column(c) for c in columns], fields=[table.schema.field(c) for c in columns])
            found = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            return pa.RecordBatch.from_arrays([*(table.column(k).slice(0, 1) for k in names), table.column(CHUNK).slice(0, 1), found], [*names, CHUNK, ROWS])

        for batch in batches:
            changed = np.zeros(batch.num_rows, bool)
            for k in names:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed[1:] |= codes[1:] != codes[:-1]
            if held and names and any(not held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in names):
                changed[:1] = True
            for a, b in zip(starts := [0, *np.flatnonzero(changed[1:]) + 1], [*starts[1:], batch.num_rows]):
                if changed[a] and held:
                    yield row(held)
                    held, size = [], 0
                while a < b:
                    n = min(b - a, chunk_rows - size)
                    held.append(batch.slice(a, n))
                    a, size = a + n, size + n
                    if size == chunk_rows:
                        yield row(held)
                        held, size = [], 0
        if held:
            yield row(held)

    kind = T.ArrayType(T.StructType([rows.schema[c] for c in columns]))
    schema = T.StructType([*[rows.schema[k] for k in names], T.StructField(CHUNK, T.LongType()), T.StructField(ROWS, kind)])
    return stage(numbered.mapInArrow(pack, schema), "chunks")


def chunk_block(chunk_rows: int = 2 * SPAN) -> Column:
    """Number of the block of rows, of about ``BLOCK`` chunks, that a chunk's first row belongs to."""
    return floor_div(CHUNK, BLOCK * chunk_rows)


def with_halo(
    bars: DataFrame,
    rows: int,
    columns: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    order: str = "group_id",
    span: int = SPAN,
) -> DataFrame:
    """Bars with ``CHUNK``, each chunk led by copies (``HALO``) of the ``rows`` bars before it.

    A window over (keys, CHUNK) then sees what a window over the whole key would see. Buckets may be
    empty, so those bars can lie several chunks back: each of the ``rows`` chunks before holds at
    least one bar, so their last bars together always suffice.
    """
    own = bars.withColumns({CHUNK: bucket_chunk(order, span), HALO: F.lit(False)})
    # Ranking under a limit is cut on the map side: a task passes on at most ``rows`` rows per chunk.
    from_end = Window.partitionBy(*keys, CHUNK).orderBy(F.col(order).desc())
    ends = (
        own.select(*keys, CHUNK, order, *columns)
        .withColumn("_from_end", F.row_number().over(from_end))
        .where(F.col("_from_end") <= rows)
    )
    tails = ends.groupBy(*keys, CHUNK).agg(F.collect_list(F.struct(order, *columns)).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-rows, -1)
    newest_first = F.sort_array(F.flatten(F.collect_list("_tail").over(before)), asc=False)
    halo = tails.select(*keys, CHUNK, F.slice(newest_first, 1, rows).alias("_before")).select(
        *keys, CHUNK, F.inline("_before"), F.lit(True).alias(HALO)
    )
    return own.unionByName(halo, allowMissingColumns=True)


def chunk_window(keys: Sequence[str] = ("symbol",), order: str = "group_id"):
    return Window.partitionBy(*keys, CHUNK).orderBy(order)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO)
