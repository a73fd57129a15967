"""Centroid clustering with zone maps along a space-filling curve.

Vectors are put into the order of a Hilbert curve and stored in blocks, each with the smallest and largest value of each
component. The distances from a centroid to a block's box bound those to its vectors, so most centroids
can be nobody's nearest in a block and are not compared; where one is left, the block is assigned as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.session import stage

COMPONENTS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
CURVE_BITS = 2
BLOCK_ROWS = 256
# Below this, no squared distance of two vectors of 64 components reaches 2^63.
LARGEST = 1 << 27


def usable(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, v (doubles): the vectors of exactly so many components, none of them null, NaN or infinite."""
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return doubles.where((F.size("v") == components) & finite)


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def whole(v: np.ndarray) -> np.ndarray:
    """floor(1024 x) of each component, as integers."""
    scaled = np.floor(SCALE * v)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST / SCALE:g} or more: squared distances would not fit 64 bits")
    return scaled.astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (components of 0 to 2^bits - 1) on a Hilbert curve, as big-endian bytes.

    The transposed form of Skilling (2004): undo the excess turns from the highest bit down, then take the Gray
    code over components; all rows at once.
    """
    x = cells.T.astype(np.int64).copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


BLOCKS = "ids array<long>, v binary, lo array<long>, hi array<long>, total array<long>"


def blocks(vectors: DataFrame, components: int = COMPONENTS, bits: int = CURVE_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Usable vectors in blocks of up to ``block_rows`` along the curve: ids, v (whole components), and the smallest,
    largest and sum by component.

    Cells are even divisions of each component's range, which is all that is known of the whole table (two numbers
    a component). The order decides how tight the boxes are, never the result.
    """
    ends = vectors.agg(*(f(F.get("v", F.lit(i))) for i in range(components) for f in (F.min, F.max))).first()
    low, high = (np.array([0.0 if x is None else x for x in ends[k::2]]) for k in (0, 1))
    with np.errstate(over="ignore"):
        width = np.where(high > low, (high - low) / (1 << bits), 1.0)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), components)
            cells = np.clip(np.floor((v - low) / width), 0, (1 << bits) - 1).astype(np.int64)
            keys = [k.tobytes() for k in hilbert_keys(cells, bits)] if len(v) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("vec_id").cast(pa.int64()), pa.array(list(map(bytes, whole(v).astype("<i8"))), pa.binary())],
                ["key", "vec_id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows += batch.column("v").to_pylist()
            while len(rows) >= block_rows:
                yield block(ids[:block_rows], rows[:block_rows])
                ids, rows = ids[block_rows:], rows[block_rows:]
        if rows:
            yield block(ids, rows)

    def block(ids: list, rows: list) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(rows), "<i8").reshape(-1, components)
        lists = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), lists(m.min(0)), lists(m.max(0)), lists(m.sum(0))],
            ["ids", "v", "lo", "hi", "total"])

    keyed = vectors.mapInArrow(key, "key binary, vec_id long, v binary")
    # many equal vectors share a key; the id spreads them
    return keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").mapInArrow(cut, BLOCKS)


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be the nearest of some vector in a box: none other is closer to all of the box."""
    gap = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(hi - centroids))
    return np.flatnonzero((gap * gap).sum(1) <= (far * far).sum(1).min())


def nearest(m: np.ndarray, near: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``m`` among the centroids ``near``; the smaller number wins ties."""
    apart = np.empty((len(near), len(m)), np.int64)
    for k, c in enumerate(near):
        d = m - centroids[c]
        apart[k] = np.einsum("ij,ij->i", d, d)
    best = apart.argmin(0)
    return near[best], apart[best, np.arange(len(m))]


def _box(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(batch.column(n)[i].as_py(), np.int64) for n in ("lo", "hi"))


def sums(blocks_: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(vectors, sum by component) of each cluster that has vectors: a few numbers from each task, added up exactly."""
    count, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * count, np.zeros((count, components), object)
        for batch in batches:
            for i in range(batch.num_rows):
                near = candidates(*_box(batch, i), centroids)
                if len(near) == 1:
                    c = int(near[0])
                    n[c] += len(batch.column("ids")[i])
                    total[c] += np.array(batch.column("total")[i].as_py(), object)
                    continue
                m = np.frombuffer(batch.column("v")[i].as_py(), "<i8").reshape(-1, components)
                cluster, _ = nearest(m, near, centroids)
                for c in near.tolist():
                    mine = m[cluster == c]
                    n[c] += len(mine)
                    total[c] += mine.sum(0).astype(object)
        held = [c for c in range(count) if n[c]]
        flat = [str(x) for c in held for x in total[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, components).astype(np.int32)), pa.array(np.tile(np.arange(components, dtype=np.int32), len(held))),
             pa.array(np.repeat([n[c] for c in held], components).astype(np.int64)), pa.array(flat, pa.string())],
            ["cluster", "component", "n", "total"])

    parts = blocks_.mapInArrow(run, "cluster int, component int, n long, total string").groupBy("cluster", "component")
    rows = parts.agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for cluster, component, n, total in rows:
        found.setdefault(cluster, (n, [0] * components))[1][component] = int(total)
    return found


def first_centroids(vectors: DataFrame, clusters: int, salt: str, components: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``<salt>:<vec_id>``; equal ids go by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return whole(np.array([r.v for r in rows], float).reshape(-1, components))


class Clusters:
    """Stored blocks and the centroids after the last round."""

    def __init__(self, blocks_: DataFrame, centroids: np.ndarray) -> None:
        self.blocks, self.centroids = blocks_, centroids

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance: every vector and its nearest centroid."""
        centroids = self.centroids
        components = centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    m = np.frombuffer(batch.column("v")[i].as_py(), "<i8").reshape(-1, components)
                    cluster, distance = nearest(m, candidates(*_box(batch, i), centroids), centroids)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("ids")[i].values, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

        return self.blocks.select("ids", "v", "lo", "hi").mapInArrow(run, "vec_id long, cluster int, distance long")

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def fit(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3", components: int = COMPONENTS,
    bits: int = CURVE_BITS, block_rows: int = BLOCK_ROWS,
) -> Clusters:
    """Centroids of ``vectors`` (vec_id, embedding) in whole numbers, the same on every run.

    Components become floor(1024 x). Vectors of another length or with a null, NaN or infinite component are left
    out. A round assigns each vector to the nearest centroid, the smaller number among equals, and moves each
    centroid that has vectors to the floor of their mean; sums are exact at any size. Repeated ids and vectors count each time; a
    null id is hashed as empty. With fewer vectors than clusters there are as many centroids as vectors. A component of 131072
    or more raises an error, as its squared distances would not fit 64 bits. Other columns are not read.
    """
    kept = usable(vectors, components)
    centroids = first_centroids(kept, clusters, salt, components)
    stored = stage(blocks(kept, components, bits, block_rows), "vector-blocks")
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (n, total) in sums(stored, centroids).items():
            moved[c] = [x // n for x in total]
        if (moved == centroids).all():
            break  # every further round would find the same
        centroids = moved
    return Clusters(stored, centroids)


def cluster_report(spark: SparkSession, vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per usable vector.

    An empty table, or one without a usable vector, gives an empty result.
    """
    found = fit(vectors, **options)
    rows = stage(found.assigned(), "assigned")
    # as many rows as there are clusters
    by_cluster = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    whole_ = sum(int(r.d) for r in by_cluster)
    digests = found.digests()
    totals = spark.createDataFrame(
        [(r.cluster, int(r.d), whole_, digests[r.cluster]) for r in by_cluster],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
