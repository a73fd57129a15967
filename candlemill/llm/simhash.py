"""SimHash near-dedup: documents whose 64-bit fingerprints differ in few bits.

Fingerprints within distance 3 are found with a generalised pigeonhole (GPH: Qin et al., 2018). The 64 bits
are grouped into m parts, each gets a threshold t_i >= -1, and as long as the thresholds sum to 3 - m + 1, any
two fingerprints within distance 3 differ in at most t_i bits of some part i. Bits that go together are put
into one part, and the thresholds come from dynamic programming on estimated candidate counts, so that a part
with few distinct values is not probed at all, at the price of wider probes elsewhere. Every split is exact;
the estimates decide the work alone.

A part of w bits with threshold t is probed through its C(w, t) masks that leave out t of the bits: two parts
differ in at most t bits just if they agree under one of these masks.

Texts that share four fifths of their words' runs lie up to some eleven bits apart, where no split is selective. Whoever
wants those too names a ``similarity``: candidates then come from MinHash bands as well, and are linked only if the
sets of their runs of five words are that similar, counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import texts
from candlemill.llm.components import components
from candlemill.session import stage

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
# A bucket of more fingerprints than this is compared block by block, by as many tasks as there are pairs of blocks.
BLOCK = 1024
SAMPLE = 2048
ROW_COST = 50  # moving one probe row, in comparisons
# Of texts at a similarity of 0.8, 1 - (1 - 0.8^8)^40 = 99.9 % agree in a band; at 0.5, 14 %.
BANDS, BAND_ROWS = 40, 8
RUNS_AT_ONCE = 4096


# ---- fingerprints -------------------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z lower-cased; of the whole if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; no hashes give 0. Signed, as Spark has it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * np.add.reduce(bits, axis=0, dtype=np.uint32) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, bands: bool = False) -> DataFrame:
    """(doc_id, fp), and with ``bands`` the keys of the text's MinHash bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, width) for t in texts(batch)]
            found = {"doc_id": batch.column(0), "fp": pa.array(map(simhash, hashes), pa.int64())}
            if bands:
                found["bands"] = pa.array([band_keys(long_runs(h)) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long" + (", bands array<long>" if bands else ""))


def long_runs(hashes: np.ndarray) -> np.ndarray:
    """The set of runs two words longer than those hashed, 32 bits each, sorted. Of fewer runs, each as it is."""
    x = hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[2:] if len(hashes) > 2 else hashes
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x >> np.uint64(32)).astype(np.uint32))


def band_keys(runs: np.ndarray) -> np.ndarray:
    """A key for each band of a set's MinHash signature; an empty set has none."""
    if not len(runs):
        return np.array([], np.int64)
    draw = np.random.default_rng(SEED)
    times, plus = draw.integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), np.uint32)
    least = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(runs), RUNS_AT_ONCE):
        np.minimum(least, ((times | np.uint32(1)) * runs[at:at + RUNS_AT_ONCE] + plus).min(axis=1), out=least)
    mixed = least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * draw.integers(0, 1 << 63, (BANDS, BAND_ROWS), np.uint64)
    keys = np.bitwise_xor.reduce(mixed ^ mixed >> np.uint64(31), axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


# ---- the split of the bits ----------------------------------------------------------------------

def bit_counts(distinct: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set, over all of them."""
    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x  # exact below 2^24 rows in a batch
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for i, j, n in rows:
        out[i, j] = n
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Equal parts of bits; each grows from the most correlated pair left, by the bit closest to it."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        block = near[np.ix_(left, left)]
        group = [left[i] for i in np.unravel_index(np.argmax(block), block.shape)] if len(left) > 1 else left[:1]
        group = list(dict.fromkeys(group))
        if len(group) < 2 <= width:
            group.append(next(b for b in left if b not in group))
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(near[np.ix_(rest, group)].mean(axis=1)))])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def estimate(group: list[int], counts: np.ndarray, n: int, sample: np.ndarray) -> np.ndarray:
    """For t = 0..DISTANCE, the share of pairs that differ in at most t bits of the part: what a sample shows,
    but no less than independent bits would give."""
    p = np.diag(counts)[group] / max(n, 1)
    odds = np.zeros(len(group) + 1)
    odds[0] = 1
    for q in 2 * p * (1 - p):
        odds[1:] = odds[1:] * (1 - q) + odds[:-1] * q
        odds[0] *= 1 - q
    seen = np.zeros(BITS + 1)
    mask = np.uint64(sum(1 << b for b in group))
    for i in range(1, len(sample)):
        seen += np.bincount(np.bitwise_count((sample[:-i] ^ sample[i:]) & mask), minlength=BITS + 1)
    shown = np.cumsum(seen) / max(seen.sum(), 1)
    return np.maximum(np.cumsum(odds)[: DISTANCE + 1], shown[: DISTANCE + 1])


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """s_i >= 0 that sum to ``budget`` with the least total of costs[i][s_i], part by part."""
    best = {0: (0.0, [])}
    for row in costs:
        after = {}
        for used, (cost, chosen) in best.items():
            for s, more in enumerate(row):
                if used + s <= budget and (used + s not in after or cost + more < after[used + s][0]):
                    after[used + s] = cost + more, [*chosen, s]
        best = after
    return best[budget]


def probe_masks(counts: np.ndarray, n: int, sample: np.ndarray) -> list[int]:
    """The masks under one of which any two fingerprints within the distance agree."""
    options = []
    for parts in range(2, DISTANCE + 2):
        groups = group_bits(counts, n, parts)
        costs = []
        for g in groups:
            share = estimate(g, counts, n, sample)
            costs.append([0.0] + [n * comb(len(g), t) * ROW_COST + n * n / 2 * share[t] for t in range(min(DISTANCE, 3))])
        # thresholds t_i = s_i - 1 sum to DISTANCE - parts + 1, so the s_i sum to DISTANCE + 1
        total, chosen = allocate(costs, DISTANCE + 1)
        options.append((total, [(g, s - 1) for g, s in zip(groups, chosen) if s]))
    return [sum(1 << b for b in g if b not in out) for g, t in min(options, key=lambda o: o[0])[1] for out in combinations(g, t)]


# ---- links --------------------------------------------------------------------------------------

def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest known companion) after the rows a[i] and b[i] are joined."""
    while True:
        ra, rb = label[a], label[b]
        open_ = ra != rb
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while (label[label] != label).any():
            label = label[label]


def _forest(keys: list[np.ndarray], fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: enough of them to connect what is within the distance, one per row at most."""
    n = len(fp)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    label, at, step = np.arange(n), np.arange(n), 1
    while (at := at[at + step < end[at]]).size:
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= DISTANCE
        label = join_labels(label, at[near], at[near] + step)
        step += 1
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key, lo, hi); a run may cross batches and is at most two blocks long."""
    held = None

    def links(columns):
        a, b = _forest(columns[:4], columns[4].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        last = np.ones(len(columns[0]), bool)
        for k in columns[:4]:
            last &= k == k[-1]
        cut = int(np.argmax(last))  # the last run is contiguous
        held = [c[cut:] for c in columns]
        if cut:
            yield links([c[:cut] for c in columns])
    if held is not None and len(held[0]):
        yield links(held)


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the distance, enough to connect all that are connected.

    Rows that agree under a mask form a bucket, of which only the verified links leave, as a spanning forest: a
    group of very many near copies makes about a row for each, not for each pair. Large buckets are cut into
    blocks by a hash, and each pair of blocks is verified by itself, so no pair is left out and no task
    gets more than two blocks of a bucket.
    """
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    masks = probe_masks(bit_counts(distinct), n, sample)
    probes = (
        distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"))
        .withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    )
    sizes = probes.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    paired = (
        probes.join(sizes, ["mask", "key"]).withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("mask", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    group = ["mask", "key", "lo", "hi"]
    return paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(_link_runs, "a long, b long").distinct()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have ``least`` of their union in common."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= least * (len(both) - common)


def _similar_forest(fp: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links that connect what is similar; rows already connected, and equal fingerprints, are not compared."""
    _, first, label = np.unique(fp, return_index=True, return_inverse=True)
    label = first[label]
    at, step, a, b = np.arange(len(fp)), 1, [], []
    while (at := at[at + step < len(fp)]).size:
        for i in at[label[at] != label[at + step]].tolist():
            if label[i] != label[i + step] and similar(sets[i], sets[i + step], least):
                low, high = sorted((label[i], label[i + step]))
                label[label == high] = low
                a.append(int(fp[i]))
                b.append(int(fp[i + step]))
        step += 1
    return a, b


def similar_links(docs: DataFrame, found: DataFrame, width: int, block: int, least: float) -> DataFrame:
    """(a, b): fingerprints of texts whose sets of longer runs are similar, enough to connect all that are connected.

    Texts that share a band's key come into one coarse group by a star, which costs a row for each. Within coarse groups
    sets are compared in full, block by block as for buckets. The sets are made again from the texts, not stored.
    """
    probes = found.select("fp", F.explode("bands").alias("key")).distinct()
    shared = probes.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("key", "a")
    coarse = stage(components(probes.join(shared, "key").where("fp <> a").select("a", F.col("fp").alias("b"))), "coarse")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, width) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(simhash, hashes), pa.int64()), pa.array([long_runs(h).tobytes() for h in hashes], pa.binary())], ["fp", "runs"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, 3):
            fp = group.column("fp").to_numpy()
            runs = [np.frombuffer(x, np.uint32) for x in group.column("runs").to_pylist()]
            a, b = _similar_forest(fp, runs, least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    members = docs.select("doc_id", "text").mapInArrow(sets, "fp long, runs binary").join(coarse, F.col("fp") == F.col("node"))
    sizes = coarse.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    paired = (
        members.join(sizes, "root").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "runs")
    )
    by = ["root", "lo", "hi"]
    return paired.repartition(*by).sortWithinPartitions(*by).mapInArrow(links, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first ``keys`` columns and follow one another, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(columns[:, start].tolist())
            if now != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that is reachable over fingerprints within the distance, and with
    ``similarity`` also over texts whose sets of runs of ``width`` + 2 words have that share in common.

    One row per row of ``docs``, of which doc_id and text alone are read. Texts without words (null, empty) have
    fingerprint 0, which is linked like any other. Rows without an id take part, but no component is
    named after them unless it has no other; component_id is then null. An empty table gives an empty result.
    """
    found = stage(fingerprints(docs, width, similarity is not None), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = fingerprint_links(distinct, block)
    if similarity is not None:
        links = links.union(similar_links(docs, found, width, block, similarity))
    linked = stage(components(links), "components")
    members = linked.join(distinct, linked.node == distinct.fp).select("root", "fp", "first_id")
    named = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = members.join(named, "root").select("fp", "component_id")
    # written, so that the join below deals out both sides itself and Spark can split a fingerprint of very many copies
    by_fp = stage(distinct.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "fingerprint-classes")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose id names its component, one document of each group. Rows with the same id stay
    or go together, and rows without an id stay."""
    classes = near_duplicates(docs, width, similarity=similarity)
    dropped = stage(classes.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
