import random

import numpy as np
import pytest
from candlemill.llm import simhash as S
from candlemill.llm.components import components
from text_helpers import WORD, clash, docs, odd_rows, prose
from xxhash import xxh64_intdigest


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]


def around(n, seed, centres=6):
    """Fingerprints of which many are a few bits from one another."""
    draw, out = random.Random(seed), set()
    base = [draw.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = draw.choice(base)
        for _ in range(draw.randrange(5)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
        if draw.random() < 0.3:
            base.append(x)
    return sorted(out)


def test_fingerprints(spark):
    rows = [(i, t) for i, (_, t, _) in enumerate(odd_rows())] + [(100 + i, prose(i, i)) for i in range(1, 40)] + [(200, "A b C d e é Ñ")]
    found = {r.doc_id: r.fp & (1 << 64) - 1 for r in S.fingerprints(docs(spark, rows)).collect()}
    assert found == {i: slow_fingerprint(t) for i, t in rows}


@pytest.mark.parametrize("n", [100, 10**5, 10**8, 10**10])
def test_masks_miss_no_pair(n):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    x[:, ] |= (x & np.uint64(1)) << np.uint64(5)  # two bits that go together
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    masks = S.probe_masks(bits.T @ bits * (n / 500), n, x)
    rand = random.Random(5)
    for _ in range(3000):
        flips = sum(1 << b for b in rand.sample(range(64), 3))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("block", [4, 1000])
def test_links_connect_what_is_near(spark, block):
    fps = around(400, 9)
    df = spark.createDataFrame([(S._signed(x), i) for i, x in enumerate(fps)], "fp long, first_id long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.fingerprint_links(df, block).collect()]
    same = lambda r: sorted(map(sorted, {v: [k for k in r if r[k] == v] for v in r.values()}.values()))
    assert same(roots(fps, links)) == same(roots(fps, near(fps)))


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(150)] + [(5, 5)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rows = []
    for k in range(6):
        text = prose(400, 50 + k, 9000)
        rows += [(10 * k + 9, text), (10 * k + 1, text + " more"), (10 * k + 5, text.replace(" ", "\n", 3))]
    return rows + [(500, None), (501, ""), (None, prose(400, 51, 9000))]


def test_near_duplicates(spark):
    rows = near_rows()
    fps = [slow_fingerprint(t) for _, t in rows]
    group = roots(set(fps), near(sorted(set(fps))))
    best = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            best[group[f]] = min(best.get(group[f], i), i)
    found = S.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted(((i, best.get(group[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert best[group[fps[0]]] == 1  # an added word and other white space are near
    df = clash(docs(spark, rows), "fp", "component_id", "mask")
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*{b for b in best.values()}, None], key=str)


def edited(text, n, seed):
    words, draw = text.split(" "), random.Random(seed)
    for i in draw.sample(range(len(words)), n):
        words[i] = f"new{draw.randrange(9999)}"
    return " ".join(words)


def five_word_similarity(a, b):
    a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [2, 1000])
def test_similar_texts_are_linked_whatever_their_distance(spark, block):
    base = [prose(210, 80 + k, 9000) for k in range(12)]
    rows = [(10 * k + j, edited(t, [0, 2, 4, 9, 30][j], j)) for k, t in enumerate(base) for j in range(5)]
    fps = {i: slow_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i]
             if (fps[a] ^ fps[b]).bit_count() <= 3 or five_word_similarity(x, y) >= 0.8]
    far = [(fps[a] ^ fps[b]).bit_count() > 3 for a, b in pairs]
    assert sum(far) > 10
    expected = roots([i for i, _ in rows], pairs)
    found = {r.doc_id: r.component_id for r in S.near_duplicates(docs(spark, rows), block=block, similarity=0.8).collect()}
    assert found == expected
    kept = {r.doc_id for r in S.drop_near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert kept == set(expected.values())


def test_empty(spark):
    assert S.near_duplicates(docs(spark, []), similarity=0.8).count() == 0
    assert S.near_duplicates(docs(spark, [])).count() == 0 and S.drop_near_duplicates(docs(spark, [])).count() == 0
