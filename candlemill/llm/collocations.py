"""Collocations: phrases of two to four words that occur together, mined by partitions (SON).

The corpus is dealt to shards. A phrase with the support asked for has, in one shard at least, its share of that
support by the shard's words, so a shard mined completely at that lowered support finds it. What any shard finds is a
candidate, and a last pass counts all candidates over the whole corpus, by their words, exactly.

Shards are mined level by level: phrases of n words are counted only where both phrases of n - 1 words inside
are frequent in the shard. Tasks know what is frequent from a bit map of a fixed size, so a shard is never one task's work
nor held anywhere as a whole. A full map, or two hashes that meet, only let more phrases be counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.session import stage

LONGEST = 4
SUPPORT = 30
SHARDS = 8
CONTAINED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
FILTER_BITS = 27  # 16 MB
BLOCK_BYTES = 8 << 20
BROADCAST_ROWS = 100_000
NO_LANG = "und"

WORD, GAP, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = GAP
KIND[list(b".,;:!?\n\x0b\x0c\r")] = END
PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
SHARD_SALT = 2654435761


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a block of texts: a dictionary, its entry at each place, and the piece each place is in."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        kind = KIND[data]
        inside = kind == WORD
        edges = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        values = data[inside]
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        coded = array.dictionary_encode()
        self.words = coded.dictionary
        self.at = coded.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(kind == END, dtype=np.int32)[starts]

    def hashes(self, salt: bytes) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(salt)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def frequent(self, salt: bytes, levels: int, passes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the phrases of up to ``levels`` words whose shorter phrases all pass.

        A place is where a phrase starts. The hash of a phrase follows from its words in order and ``salt``.
        """
        own = self.hashes(salt)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        places, h = np.arange(len(self.at)), own
        yield 1, places, h
        for n in range(2, levels + 1):
            ok = np.zeros(len(self.at), bool)
            ok[places[passes(n - 1, h)]] = True
            before = np.zeros(len(self.at), np.uint64)
            before[places] = h
            places = np.flatnonzero(ok[:-1] & ok[1:])
            places = places[places + n <= len(self.at)]
            places = places[self.piece[places] == self.piece[places + n - 1]]
            h = _mixed(before[places] * np.uint64(0x9E3779B97F4A7C15) + own[places + n - 1])
            yield n, places, h


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, int, Words]]:
    """(lang, shard, words) of blocks of about ``block_bytes``. Texts longer than that are cut between pieces."""
    held: dict[tuple[str, int], list[bytes]] = {}
    size = 0

    def flush():
        for (lang, shard), texts in held.items():
            yield lang, shard, Words(texts)
        held.clear()

    for batch in batches:
        langs, shards = batch.column("lang").to_pylist(), batch.column("shard").to_pylist()
        for text, lang, shard in zip(batch.column("text").cast(pa.large_binary()), langs, shards):
            data = text.as_py()
            while data:
                cut = PIECE_END.search(data, block_bytes) if len(data) > block_bytes else None
                head, data = (data[: cut.end()], data[cut.end():]) if cut else (data, b"")
                held.setdefault((lang, shard), []).append(head)
                size += len(head)
                if size >= block_bytes:
                    yield from flush()
                    size = 0
    yield from flush()


class Filter:
    """A bit for each of 2^bits hashes."""

    def __init__(self, bits: int, map_: np.ndarray | None) -> None:
        self.mask, self.map = np.uint64((1 << bits) - 1), map_

    def passes(self, h: np.ndarray, shard: int) -> np.ndarray:
        if self.map is None:
            return np.ones(len(h), bool)
        p = (h ^ np.uint64(shard * SHARD_SALT)) & self.mask
        return (self.map[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _filter(df: DataFrame, bits: int, shard: Column) -> np.ndarray:
    """The bit map of the hashes ``h``: 2^(bits - 6) numbers at most, whatever the rows."""
    p = F.col("h").bitwiseXOR(shard.cast("long") * F.lit(SHARD_SALT)).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(F.shiftrightunsigned(p, 6).cast("int").alias("i"), F.expr("1L").alias("one"), p.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    found = words.groupBy("i").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits")).toArrow()
    map_ = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    map_[found["i"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return map_


GRAMS = "lang string, shard int, h long, c long"
TEXTS = "lang string, n int, phrase binary, c long"


def _same(value, n: int, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def count_level(rows: DataFrame, level: int, maps: list[np.ndarray], bits: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, shard, h, c: how often each phrase of ``level`` words, by hash, occurs in each shard, among those whose
    shorter phrases are in ``maps``."""
    sent = rows.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        filters = [Filter(bits, m) for m in sent.value]
        for lang, shard, words in _blocks(batches, block_bytes):
            passes = lambda n, h: filters[n - 1].passes(h, shard)  # noqa: E731, B023
            for n, _, h in words.frequent(lang.encode(), level, passes):
                pass
            h, c = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [_same(lang, len(h), pa.string()), _same(shard, len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))],
                ["lang", "shard", "h", "c"])

    return rows.mapInArrow(run, GRAMS).groupBy("shard", "lang", "h").agg(F.sum("c").alias("c"))


def _joined(words: pa.Array, *ids: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(i)) for i in ids), pa.scalar(b" ", pa.large_binary()))


def count_candidates(rows: DataFrame, candidates: np.ndarray, bits: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, n, phrase, c: how often each candidate occurs. Phrases are told apart by their words, not by hashes."""
    sent = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        chosen = Filter(bits, sent.value)
        for lang, _, words in _blocks(batches, block_bytes):
            at, size = words.at, max(1, len(words.words))
            passes = lambda n, h: chosen.passes(h, 0)
            for n, places, h in words.frequent(lang.encode(), LONGEST, passes):
                places = places[passes(n, h)]
                if not len(places):
                    continue
                if n == 1:
                    found, c = np.unique(at[places], return_counts=True)
                    ids = [found]
                else:
                    # pairs are numbered within the block, so that two numbers make a key whatever n
                    first = at[places] * size + at[places + 1]
                    if n == 2:
                        found, c = np.unique(first, return_counts=True)
                        ids = [found // size, found % size]
                    else:
                        last = at[places + n - 2] * size + at[places + n - 1]
                        pairs, number = np.unique(np.concatenate([first, last]), return_inverse=True)
                        found, c = np.unique(number[: len(first)] * len(pairs) + number[len(first):], return_counts=True)
                        a, b = pairs[found // len(pairs)], pairs[found % len(pairs)]
                        ids = [a // size, a % size, *([b // size] if n == 4 else []), b % size]
                phrase = _joined(words.words, *ids).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [_same(lang, len(c), pa.string()), _same(n, len(c), pa.int32()), phrase, pa.array(c.astype(np.int64))],
                    ["lang", "n", "phrase", "c"])

    counted = rows.mapInArrow(run, TEXTS).groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f"))
    return counted.select("lang", "n", F.col("phrase").cast("string").alias("phrase"), "f")


def stored_shard(shards: int = SHARDS) -> Column:
    """A shard for each part of a file, so a task's rows are mostly of one shard; one shard for rows from elsewhere."""
    return F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(shards)).cast("int")


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, shard: Column | None = None, filter_bits: int = FILTER_BITS,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all phrases of one to four words with f >= ``support``; and (lang, words), all words.

    ``shard`` deals rows to shards by anything that a second reading finds again. It decides the work only.
    """
    rows = docs.select(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"),
        (stored_shard() if shard is None else shard).alias("shard"))
    counted = stage(count_level(rows, 1, [], filter_bits, block_bytes), "words-by-shard")
    here = counted.groupBy("lang", "shard").agg(F.sum("c").alias("_here"))
    words = stage(here.groupBy("lang").agg(F.sum("_here").alias("words")), "words-by-lang")
    # a phrase's share of the support in a shard, rounded up, is at most what it has in one of them
    lowered = F.expr(f"({support} * cast(_here as decimal(20,0)) + words - 1) div words").alias("_least")
    limits = stage(here.join(words, "lang").select("lang", "shard", lowered), "local-support")
    few = limits.count() <= BROADCAST_ROWS
    found, maps = [], []
    for level in range(1, LONGEST + 1):
        if level > 1:
            counted = count_level(rows, level, maps, filter_bits, block_bytes)
        kept = counted.join(F.broadcast(limits) if few else limits, ["lang", "shard"]).where("c >= _least")
        found.append(stage(kept.select("shard", "h"), f"local-phrases-{level}"))
        if level < LONGEST:
            maps.append(_filter(found[-1], filter_bits, F.col("shard")))
    every = found[0]
    for level in found[1:]:
        every = every.union(level)
    candidates = _filter(every.select("h"), filter_bits, F.lit(0))
    phrases = count_candidates(rows, candidates, filter_bits, block_bytes).where(F.col("f") >= support)
    return stage(phrases, "phrases"), words


def collocations(
    docs: DataFrame, support: int = SUPPORT, top: int = TOP, shard: Column | None = None,
    filter_bits: int = FILTER_BITS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score.

    Texts are lower-cased A to Z and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at spaces and tabs.
    a is how often a phrase occurs within pieces, overlaps included, l and r the same of its two parts, n the
    language's words. The score floor(2000000 a / (l + r)) is that of the cut where it is lowest, of equal ones the
    first. Phrases inside a longer one that occurs at least 0.8 times as often are left out, whether or not
    that one is itself. Ties go by a, then by the phrase's bytes.

    A null text counts as empty, a null language as ``und``. Repeated rows and ids count each time; other columns
    are not read. An empty table gives an empty result.
    """
    phrases, words = frequent_phrases(docs, support, shard, filter_bits, block_bytes)
    longer = phrases.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    part = lambda at, n: F.array_join(F.slice("_w", at, n), " ")
    cuts = longer.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "n", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_left"),
                       part(F.col("_k") + 1, F.col("n") - F.col("_k")).alias("_right"))
    side = lambda name, value: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    cuts = cuts.withColumn("score", F.expr(f"({SCALE} * cast(a as decimal(20,0))) div (l + r)").cast("long"))
    worst = cuts.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    inner = longer.where("n > 2").withColumn("_m", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    inner = inner.withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("_m") + 1)))
    inside = inner.select("lang", part(F.col("_s"), F.col("_m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    alone = worst.join(inside, ["lang", "phrase"], "left").where(
        F.col("_most").isNull() | (F.lit(100) * big("_most") < F.lit(CONTAINED_PERCENT) * big("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # one row a language after the cut to its first phrases
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"),
        F.col("words").alias("n"), F.col("_cut.score").alias("score"))
