import hashlib
import itertools
import random

import numpy as np
import pytest
from candlemill.llm.centroids import candidates, cluster_report, fit, hilbert_keys, nearest
from text_helpers import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, clusters=8, rounds=10, size=64):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        now = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, now) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    now = assign()
    by = {}
    for d, k in now:
        by[k] = by.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, by[k], sum(by.values()), sha[k]) for (i, _), (d, k) in zip(kept, now)), key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(n, seed=3, size=64):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(size)] for _ in range(12)]
    return [(i, [m + draw.gauss(0, 0.2) for m in draw.choice(middles)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("bits,block_rows", [(1, 7), (3, 64)])
def test_report(spark, bits, block_rows):
    rows = vectors(300)
    assert got(cluster_report(spark, table(spark, rows), bits=bits, block_rows=block_rows)) == expected(rows)


def test_odd_rows(spark):
    rows = vectors(60)
    rows += [(100, None), (101, []), (102, rows[0][1][:63]), (103, rows[0][1] + [0.0]), (104, [None] + rows[0][1][1:]),
             (105, [float("nan")] + rows[0][1][1:]), (106, [float("-inf")] + rows[0][1][1:]), (None, rows[5][1]), (7, rows[8][1])]
    rows += [rows[3]] * 40 + [(200, [0.0] * 64), (201, [0.0] * 64), (202, [-0.0] * 64), (203, [1e-30] * 64), (204, [-1e-30] * 64)]
    df = clash(table(spark, rows), "v", "key", "cluster", "ids", "inertia")
    assert got(cluster_report(spark, df, block_rows=16)) == expected(rows)


def test_few_and_none(spark):
    for rows in ([], [(1, None)], vectors(1), vectors(5), [(i, [0.5] * 64) for i in range(20)]):
        assert got(cluster_report(spark, table(spark, rows))) == expected(rows)


def test_ties_go_to_the_smaller_number():
    m = np.array([[0, 0], [2, 0], [1, 0]])
    centroids = np.array([[2, 0], [0, 0], [2, 0]])
    cluster, distance = nearest(m, np.arange(3), centroids)
    assert cluster.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 1]


def test_boxes_lose_no_nearest_centroid():
    draw = np.random.default_rng(4)
    left_out = 0
    for _ in range(200):
        m = draw.integers(-50, 50, (1, 5)) + draw.integers(-9, 9, (20, 5))
        centroids = draw.integers(-60, 60, (8, 5))
        near = candidates(m.min(0), m.max(0), centroids)
        every, best = nearest(m, np.arange(8), centroids), nearest(m, near, centroids)
        assert all((a == b).all() for a, b in zip(every, best))
        left_out += 8 - len(near)
    assert left_out


def test_hilbert_curve_visits_each_cell_once_in_steps_of_one():
    for size, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=size)))
        order = [c for _, c in sorted(zip((k.tobytes() for k in hilbert_keys(cells, bits)), cells.tolist()))]
        assert len({tuple(c) for c in order}) == len(cells)
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(order, order[1:]))


def test_blocks_along_the_curve_leave_out_centroids(spark):
    rows = vectors(600)
    found = fit(table(spark, rows), block_rows=16, components=64)
    boxes = found.blocks.select("lo", "hi").collect()
    near = [len(candidates(np.array(b.lo), np.array(b.hi), found.centroids)) for b in boxes]
    assert np.mean(near) < len(found.centroids)


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        cluster_report(spark, table(spark, vectors(3) + [(9, [200_000.0] * 64)]))
