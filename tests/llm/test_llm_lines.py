import hashlib
import random

import pytest
from candlemill.llm.line_dedup import LineRuns, drop_repeated_lines, hashed_lines, line_report
from pyspark.sql import functions as F
from text_helpers import clash, docs, odd_rows

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def expected(rows):
    """(doc_id, lines, dropped, text left) of each row"""
    rank = lambda i: (i is None, i or 0)
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(rank(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == rank(r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def digest(rows):
    return sorted(((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=str)


def report(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def many(n=60, seed=5):
    draw = random.Random(seed)
    stock = [f"A line that repeats, number {i}" for i in range(25)] + ["short", "", "  padded repeated LINE \r", "PADDED repeated line", "Zeile über zehn Ähren", "zeile über zehn ähren"]
    return [(i, "\n".join(draw.choice(stock) if draw.random() < 0.7 else f"own line {i} {j} of this one" for j in range(draw.randrange(9)))) for i in range(n)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 2), (6, 4)])
def test_lines(spark, batches, fanout):
    rows = many()
    assert report(line_report(docs(spark, rows), batches, fanout)) == digest(expected(rows))


def test_odd_rows(spark):
    rows = odd_rows() + [
        (20, "the same long line\nthe same long line\nx"), (21, "y\nTHE SAME long line "), (None, "the same long line"), (None, "only here, without an id"),
        (21, "y\nTHE SAME long line "), (22, "y\nanother line under this id"), (22, "another line under this id\nz"), (23, "ninechars\nninechars"), (24, "ninechars")]
    want = expected(rows)
    assert report(line_report(docs(spark, rows))) == digest(want)
    df = clash(docs(spark, rows), "_row", "_t", "fp", "dropped", "kept", "_id", "line", "_lines", "pos")
    out = drop_repeated_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[3]) for r in want), key=str)
    assert {r["dropped"] for r in got} == {"own dropped"}


def test_empty(spark):
    assert line_report(docs(spark, [])).count() == 0 and drop_repeated_lines(docs(spark, [])).count() == 0


def test_runs_are_compacted_and_found_again(spark, tmp_path):
    folder = str(tmp_path / "runs")
    parts = [docs(spark, many(20, s)) for s in range(5)]
    runs, seen = LineRuns(spark, folder, buckets=3, fanout=2), set()
    for i, part in enumerate(parts):
        gone = runs.admit(hashed_lines(part)).groupBy("doc_id").agg(F.sum(F.lit(1)).alias("n"))
        own, want = {}, {}
        for r in part.orderBy("doc_id").collect():
            for line in (r.text or "").split("\n"):
                k = key(line)
                if len(k) >= 10 and (k in seen or own.setdefault(k, r.doc_id) != r.doc_id):
                    want[r.doc_id] = want.get(r.doc_id, 0) + 1
        assert dict(map(tuple, gone.collect())) == want
        seen |= set(own)
        assert [len(x) for x in runs.levels] == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]][i]
        runs.save()
        runs.forget()
        runs = LineRuns.load(spark, folder)
    lines = {bytes(r.line) for level in runs.levels for t, _ in level for r in spark.table(t).collect()}
    assert len(lines) == len(seen) == sum(spark.table(t).count() for level in runs.levels for t, _ in level)


def test_runs_are_merged_where_they_lie(spark):
    """The join with the runs shuffles neither side, and sorts nothing again."""
    runs = LineRuns(spark, buckets=4)
    for s in range(2):
        runs.admit(hashed_lines(docs(spark, many(20, s))))
    (first, _), (second, _) = runs.levels[0]
    with runs._ordered():
        df = spark.table(first).hint("merge").join(spark.table(second).hint("merge"), "line", "left_anti")
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
