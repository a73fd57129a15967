from collections import defaultdict

import pytest
from candlemill.llm import mixing
from candlemill.llm.mixing import SCHEDULES, mix, mix_plan, mix_report, source_targets, sized, training_time
from pyspark.sql import functions as F
from text_helpers import WORD, clash, docs, odd_rows, prose


def filled(sizes, weights, cap=3):
    """Share by weight, stop at the limit, share the rest anew, until none exceeds."""
    total, target, left = sum(sizes.values()), {}, set(sizes)
    while left:
        rest = total - sum(target.values())
        share = {s: weights[s] * rest / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= over
    return target


def many(n=300):
    names = ["a", "b", "c", "d", None, "é"]
    return [(i, prose(1 + (i * 37) % 200, i), names[0] if i % 3 else names[i // 3 % 6]) for i in range(n)]


def test_targets(spark):
    rows = many()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    found = {r.source: r.target for r in source_targets(sized(docs(spark, rows))).collect()}
    assert found == pytest.approx(filled(sizes, weights))


def test_each_source_comes_near_its_target(spark):
    rows = mix_report(docs(spark, many())).collect()
    by = defaultdict(list)
    source = {i: s for i, _, s in many()}
    for r in rows:
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        by[source[r.doc_id]].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
        assert sum(r.size for r in own) == own[0].source_size


def test_mixture_repeats_and_orders(spark):
    df = clash(docs(spark, many()), "size", "target", "passes", "positions", "_row")
    out = mix(df, position="at")
    rows = out.collect()
    assert out.columns == [*df.columns, "at"] and {r["size"] for r in rows} == {"own size"}
    assert [r.at for r in rows] == sorted(r.at for r in rows) and 0 < rows[0].at <= rows[-1].at <= 1
    taken = {r.doc_id: r.taken // r.size for r in mix_report(docs(spark, many())).collect()}
    seen = defaultdict(int)
    for r in rows:
        seen[r.doc_id] += 1
    assert dict(seen) == {i: n for i, n in taken.items() if n}


@pytest.mark.parametrize("knots", SCHEDULES)
def test_times_invert_the_integral(spark, knots):
    def area(t):
        total = 0.0
        for (a, v), (b, w) in zip(knots, knots[1:]):
            e = min(t, b)
            if e > a:
                total += (e - a) * (v + v + (w - v) * (e - a) / (b - a)) / 2
        return total

    f = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(x,) for x in f], "f double").select("f", training_time(F.col("f"), knots).alias("t"))
    for r in df.collect():
        assert area(r.t) / area(1.0) == pytest.approx(r.f, abs=1e-9)


def test_odd_rows(spark):
    rows = mix_report(docs(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.taken == 0 and r.position is None for r in rows if r.size == 0)
    assert mix_report(docs(spark, [])).count() == 0 and mix(docs(spark, [])).count() == 0
    blank = mix_report(docs(spark, [(1, None), (2, "")])).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


@pytest.fixture
def four_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_report_is_read_from_the_range_sorted_mixture(spark, monkeypatch, four_tasks):
    staged = {}
    monkeypatch.setattr(mixing, "stage", lambda df, label, put=mixing.stage: staged.setdefault(label, put(df, label)))
    rows = many() + many(40) + odd_rows()  # ids come again, in one source and in several
    report = mix_report(docs(spark, rows)).collect()
    files = [spark.read.parquet(f).collect() for f in sorted(staged["mixture"].inputFiles())]
    uses = [r for f in files for r in f]
    assert len([f for f in files if f]) > 1 and [r._position for r in uses] == sorted(r._position for r in uses)
    plan = mix_plan(staged["sizes"], staged["source-targets"]).collect()
    assert max(r.passes for r in plan) > 1 and min(r.passes for r in plan) == 0
    assert sorted(r._position for r in uses) == sorted(p for r in plan for p in r.positions)
    plain = [(r.doc_id, r.size, r.source_size, r.target, r.taken, round(r.positions[0], 9) if r.positions else None) for r in plan]
    assert sorted(map(str, map(tuple, report))) == sorted(map(str, plain))


def test_uses_of_one_position_are_dealt(spark, four_tasks):
    out = mix(docs(spark, [(i, "one two", f"host {i}") for i in range(600)]))
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.select("position").distinct().count() < 10
    assert max(r["count"] for r in tasks) < 0.3 * out.count()  # 0.33 by position alone
