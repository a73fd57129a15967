"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Each starts in a shard by hash and moves, round by round, to the shard
that holds most of its group, as far as that shard has room; so the links that cross shards become few.
Room is what a shard has left when its linked documents are counted: the others can make way at no
cost, which they do at the end, when every shard is brought to its exact number of rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import running
from candlemill.session import stage

SHARDS = 24
ROUNDS = 16
CHUNK_ROWS = 512


def _unit(*of) -> Column:
    """A number from 0 to 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, group (128-bit hash of the text); null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))


def by_shard(df: DataFrame, shard: str, value: Column, shards: int) -> list[int]:
    """A sum for each shard: as many numbers as there are shards."""
    found = dict(df.groupBy(shard).agg(value).collect())
    return [found.get(j) or 0 for j in range(shards)]


def propagate(linked: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (group, shard and more) with new shards.

    In a round, each group looks at how many of its rows each shard has (at most a row per group and shard, made by
    an aggregation that combines within tasks), and picks the fullest one that has room, the same for all its
    rows. Rows elsewhere apply to move there unless their own shard has more of the group. A shard with less
    room than applicants takes a share of them, by hash; the rest see it full in the next round and go for
    the next shard, and so a group larger than a shard fills several. Ends when nothing can move.
    """
    shards = len(capacity)
    for turn in range(rounds):
        seats = linked.groupBy("group", "shard").agg(F.count("*").alias("n")).withColumn("tie", F.xxhash64("group", "shard"))
        taken = by_shard(linked, "shard", F.count("*"), shards)
        room = [c - t for c, t in zip(capacity, taken)]
        open_ = [j for j in range(shards) if room[j] > 0]
        goal = seats.where(F.col("shard").isin(open_)).groupBy("group").agg(F.max(F.struct("n", "tie", "shard")).alias("goal"))
        moves = stage(
            seats.join(goal, "group").where(F.col("goal") > F.struct("n", "tie", "shard"))
            .select("group", "shard", F.col("goal.shard").alias("to"), "n"), "moves")
        asked = by_shard(moves, "to", F.sum("n"), shards)
        if not any(asked):
            break
        share = F.array(*(F.lit(min(1.0, max(r, 0) / a) if a else 0.0) for r, a in zip(room, asked)))
        accepted = _unit("doc_id", "group", F.lit(turn)) < F.element_at(share, F.col("to") + 1)
        linked = stage(
            linked.join(moves.drop("n"), ["group", "shard"], "left")
            .withColumn("shard", F.when(F.col("to").isNotNull() & accepted, F.col("to")).otherwise(F.col("shard")))
            .select(linked.columns), "labels")
    return linked


def settle(rows: DataFrame, counts: list[int], capacity: list[int]) -> DataFrame:
    """``rows`` (shard, linked and more) with shards of exactly ``capacity`` rows, and slot, gapless from 0.

    Rows are numbered in their shard, linked ones first. Those numbered past its capacity are numbered on through
    all shards, and fill the free ends of the others in that order.
    """
    shards, total = len(capacity), sum(capacity)
    over = [max(0, n - c) for n, c in zip(counts, capacity)]
    under = [max(0, c - n) for n, c in zip(counts, capacity)]
    over_before = [0, *accumulate(over)][:shards]
    under_before = [0, *accumulate(under)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    at = lambda xs, j: F.element_at(longs(xs), j + 1)
    spread = F.xxhash64("doc_id", "group")
    chunks = max(1, -(-total // (shards * CHUNK_ROWS)))
    chunk = F.when(F.col("linked"), 0).otherwise(chunks) + F.pmod(spread, F.lit(chunks)).cast("int")
    ranked = running(rows.withColumn("_chunk", chunk), ["shard"], "_chunk", [spread, "doc_id"], F.lit(1), "_rank")
    here, rank = F.col("shard"), F.col("_rank").cast("long")
    extra = at(over_before, here) + rank - at(capacity, here)
    to = F.size(F.filter(longs(under_before[1:]), lambda x: x <= extra))
    stays = rank < at(capacity, here)
    return ranked.withColumn("slot", F.when(stays, rank).otherwise(at(counts, to) + extra - at(under_before, to))).withColumn(
        "shard", F.when(stays, here).otherwise(to).cast("int")).drop("_chunk", "_rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, group, shard, slot: one row per row of ``docs``, shards equal in rows up to one.

    Null texts count as empty and are linked with empty ones. Rows that are repeated or lack an id are rows like
    any other. Only doc_id and text are read. An empty table gives an empty result.
    """
    rows = stage(sized(docs).withColumn("shard", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")), "sized")
    groups = rows.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = stage(groups, "groups")
    total = rows.count()
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    linked = propagate(stage(rows.join(groups, "group", "left_semi").select(rows.columns), "labels"), capacity, rounds)
    alone = rows.join(groups, "group", "left_anti").select(rows.columns)
    labelled = stage(linked.withColumn("linked", F.lit(True)).unionByName(alone.withColumn("linked", F.lit(False))), "labels")
    counts = by_shard(labelled, "shard", F.count("*"), shards)
    return settle(labelled, counts, capacity).drop("linked")


def stray_rows(assigned: DataFrame) -> DataFrame:
    """(linked_rows, stray_rows): rows of groups of two and more, and those outside their group's main shard."""
    seats = assigned.groupBy("group", "shard").agg(F.count("*").alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return seats.where("n > 1").agg(F.sum("n").alias("linked_rows"), F.sum(F.col("n") - F.col("most")).alias("stray_rows"))
