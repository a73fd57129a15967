import hashlib
import re

from candlemill.llm.exact_dedup import drop_copies, exact_dedup
from pyspark.sql import functions as F
from text_helpers import clash, docs, odd_rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for r in rows:
        own = groups[norm(r[1])]
        ids = [i for i in own if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups(spark):
    assert got(exact_dedup(docs(spark, odd_rows()))) == expected(odd_rows())


def test_texts_that_share_a_hash_stay_apart(spark):
    for weak in (lambda t: F.lit("x"), lambda t: F.substring(F.md5(t), 1, 1)):
        assert got(exact_dedup(docs(spark, odd_rows()), weak)) == expected(odd_rows())
        rows = {norm(r.text) for r in drop_copies(docs(spark, odd_rows()), weak).collect()}
        assert rows == {norm(r[1]) for r in odd_rows()}


def test_one_row_of_each_group_stays(spark):
    df = clash(docs(spark, odd_rows()), "_hash", "_text", "_keep", "_size", "_row", "kept")
    out = drop_copies(df)
    assert out.columns == df.columns
    rows = [(r.doc_id, norm(r.text)) for r in out.collect()]
    assert len(rows) == len({t for _, t in rows}) == len({norm(r[1]) for r in odd_rows()})
    assert (4, "same text") in rows and (6, norm(odd_rows()[6][1])) in rows
    assert {r["_hash"] for r in out.collect()} == {"own _hash"}


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0 and drop_copies(docs(spark, [])).count() == 0
