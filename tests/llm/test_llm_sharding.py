import zlib
from collections import Counter, defaultdict

from candlemill.llm.sharding import shard_documents, stray_rows
from text_helpers import clash, docs, odd_rows, prose


def check(rows, found, shards):
    assert sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows) == sorted(r.text_crc32 for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    counts = [len(by[j]) for j in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(own) == list(range(len(own))) for own in by.values())


def test_groups_come_together_and_shards_stay_equal(spark):
    rows = [(i, prose(20, i)) for i in range(400)] + [(1000 + i, prose(20, 5000 + i // 5)) for i in range(200)]
    out = shard_documents(docs(spark, rows), 8)
    check(rows, out.collect(), 8)
    strays = stray_rows(out).first()
    assert strays.linked_rows == 200 and strays.stray_rows == 0
    assert sorted(out.collect()) == sorted(shard_documents(docs(spark, rows).repartition(5), 8).collect())


def test_a_group_of_a_third_fills_whole_shards(spark):
    rows = [(i, "copy") for i in range(300)] + [(1000 + i, prose(15, i)) for i in range(600)]
    out = shard_documents(docs(spark, rows), 9).collect()
    check(rows, out, 9)
    held = sorted(Counter(r.shard for r in out if r.text_crc32 == zlib.crc32(b"copy")).values(), reverse=True)
    assert held[:2] == [100, 100] and len(held) <= 5  # from 9 shards with 33 each


def test_odd_rows(spark):
    out = shard_documents(clash(docs(spark, odd_rows()), "shard", "slot", "group", "size"), 3).collect()
    check(odd_rows(), out, 3)
    assert Counter(r["size"] for r in out)[8] == 2  # null and empty
    assert len({r.shard for r in out if r["size"] == 8}) == 1
    assert shard_documents(docs(spark, []), 3).count() == 0
    few = shard_documents(docs(spark, [(1, "a")]), 24).collect()
    assert [(r.slot, 0 <= r.shard < 24) for r in few] == [(0, True)]
