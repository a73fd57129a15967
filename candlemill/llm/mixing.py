"""Mixing sources to target weights along a curriculum.

How much of a source is taken follows from its target; when it is trained on follows from its weight schedule.
The schedule is integrated to a cumulative demand, and each document's place in its source's stream is put
through the inverse of that, which gives its position in training; documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.common import WORD, running
from candlemill.session import stage

WEIGHTS = (5, 2, 1)
CAP = 3
# One schedule for each of the weights: (time, weight) knots, linear between them, times from 0 to 1. Only the
# shape matters, since the integral is scaled to the source's target: the heaviest sources fade out, the
# lightest come in over the last third.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.7, 0.5), (1.0, 3.0)))
CHUNK_ROWS = 512
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized_docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_rows, source_size, weight_class, target: one row per source (a null source is one too).

    The sum of all sizes is shared by weight; a source whose share exceeds ``cap`` times its size gets exactly
    that, and what is left is shared among the others until none exceeds. That is a filling by the ratio of
    limit to weight: in that order the limited sources are a prefix. Sums are exact integers.
    """
    sources = sized_docs.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = (
        sources.withColumn("weight_class", ((F.row_number().over(name) - 1) % len(weights)).cast("int"))
        .withColumn("_w", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), F.col("weight_class") + 1))
        .withColumn("_limit", F.col("source_size") * cap)
    )
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_first = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), "source")
    big = "decimal(38,0)"
    placed = (
        ranked.withColumn("_rest", F.sum("source_size").over(everything)
                          - F.coalesce(F.sum("_limit").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(full_first.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_limit").cast(big) * F.col("_open").cast("decimal(18,0)") < F.col("_rest").cast(big) * F.col("_w").cast("decimal(18,0)"))
        .withColumn("_left", F.sum("source_size").over(everything)
                    - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(everything), F.lit(0)))
        .withColumn("_weight_left", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything))
    )
    share = (F.col("_w") * F.col("_left")).cast("double") / F.col("_weight_left").cast("double")
    return placed.select("source", "source_rows", "source_size", "weight_class",
                         F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(share).alias("target"))


def training_time(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """When a source's stream has reached ``fraction`` of its target: the inverse of its integrated schedule.

    Between two knots the weight is linear, its integral a square, and the inverse a root.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, None
    for (begin, v0), (end, v1), area in zip(knots, knots[1:], areas):
        need = fraction * whole - done
        slope = (v1 - v0) / (end - begin)
        at = F.lit(begin) + F.lit(2.0) * need / (F.lit(v0) + F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2.0 * slope) * need, F.lit(0.0))))
        out = F.when(fraction * whole <= done + area, F.least(at, F.lit(end))) if out is None else out.when(fraction * whole <= done + area, F.least(at, F.lit(end)))
        done += area
    return out.otherwise(F.lit(knots[-1][0]))


def mix_plan(sized_docs: DataFrame, targets: DataFrame, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """``sized_docs`` with source_size, target, before, passes, taken and positions (one for each time it is taken).

    A source is a stream of its documents in the order of a hash of their ids, over and over, at most ``cap``
    times. A document is taken in each pass in which its middle lies within the target, so what a source gives
    differs from its target by half a document at most. Rows that tie (same id) are ordered by size. ``before`` has the
    words of a stream that come before a document; no two documents that are taken have the same source and ``before``.
    Columns of these names in the input are replaced.
    """
    own = ["source_rows", "source_size", "weight_class", "target", "before", "passes", "taken", "positions"]
    docs = sized_docs.drop(*own).withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    few = targets.count() <= BROADCAST_SOURCES
    named = targets.withColumnRenamed("source", "_source")
    joined = docs.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source")))
    chunks = F.ceil(F.col("source_rows") / CHUNK_ROWS)
    spread = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    stream = (
        joined.withColumn("_group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
        .withColumn("_chunk", F.floor(spread * chunks / F.lit(1 << 32)).cast("long"))
    )
    placed = running(stream, ["_group"], "_chunk", ["_key", "doc_id", "size"], F.col("size"), "before")
    # twice the middle of the document in pass p, in whole words
    middles = [F.lit(2) * (F.lit(p) * F.col("source_size") + F.col("before")) + F.col("size") for p in range(cap)]
    inside = [(F.col("size") > 0) & (m <= F.lit(2.0) * F.col("target")) for m in middles]
    times = []
    for m in middles:
        fraction = F.try_divide(m.cast("double"), F.lit(2.0) * F.col("target"))
        at = F.lit(None).cast("double")
        for c, knots in enumerate(schedules):
            at = F.when(F.col("weight_class") == c, training_time(fraction, knots)).otherwise(at)
        times.append(at)
    passes = sum((i.cast("int") for i in inside), F.lit(0))
    return (
        placed.withColumn("passes", passes).withColumn("taken", F.col("passes") * F.col("size"))
        .withColumn("positions", F.slice(F.array(*times), F.lit(1), F.col("passes")))
        .drop("_group", "_chunk", "_key", "_source", "source_rows", "weight_class")
    )


def in_training_order(plan: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of each document of a ``mix_plan`` as often as it is taken, and ``_position``, range-sorted by it.

    Sources of one document each have only a few positions among them, so uses of one position are dealt and sorted
    by a hash and no range is one task's work.
    """
    order = ["_position", "_tie"]
    uses = plan.where("passes > 0").select(*columns, F.xxhash64("source", "before").alias("_tie"), F.explode("positions").alias("_position"))
    return uses.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, schedules=SCHEDULES, position: str = "position") -> DataFrame:
    """The mixture to train on: the rows of ``docs``, each as often as it is taken, sorted by position.

    ``docs`` needs doc_id, source and text; ``weights`` go to the sources in code point order, over and over,
    null last, and there is one schedule for each of them. Null and empty texts have no words and are not taken.
    All columns come through, and one more, named by ``position``, has the place in training (0 to 1). An empty table gives an empty result.
    """
    sizes = sized(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))).drop("text")
    targets = stage(source_targets(sizes, weights, cap), "source-targets")
    mixture = in_training_order(mix_plan(sizes, targets, cap, schedules), "_row")
    return mixture.select("_row.*", F.col("_position").alias(position))


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """One row per document, taken or not: doc_id, size, source_size, target, taken, position (of its first use).

    What is taken, and where first, is read from the mixture in the order of training; its rows are those of ``mix``
    without the texts, which nothing here needs. Documents that are not taken come from the plan.
    """
    sizes = stage(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    targets = stage(source_targets(sizes, weights, cap), "source-targets")
    plan = stage(mix_plan(sizes, targets, cap, schedules), "mix-plan")
    shown = ["doc_id", "size", "source_size", "target"]
    mixture = stage(in_training_order(plan, "source", "before", *shown), "mixture")
    taken = mixture.groupBy("source", "before", *shown).agg(F.sum("size").alias("taken"), F.round(F.min("_position"), 9).alias("position"))
    left = plan.where("passes = 0").select(*shown, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position"))
    return taken.select(left.columns).unionByName(left)
