"""Every query of the text operators over whole tables; against SQL where there is some."""

import glob
import os
import re

import __spark_entry__ as entry_point
import corpus_pipeline
import duckdb
import pytest
from candlemill.llm.oracles import ORACLES
from candlemill.llm.queries import QUERIES
from candlemill.llm.simhash import near_duplicates
from pyspark.sql import functions as F
from text_helpers import docs, odd_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_registered():
    names = set(entry_point.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    table, key = {"op5_html": ("pages", "page_id"), "op13_centroids": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    if name != "op12_collocations":  # one row per phrase
        assert {r[key] for r in got} == {r[0] for r in duck.sql(f"SELECT {key} FROM {table}").fetchall()}
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        order = sorted(df.columns)
        assert order == sorted(found.columns)
        plain = lambda rows, names: sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=str)
        assert plain(map(tuple, got), df.columns) == plain(found.fetchall(), found.columns)


def test_stages(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    now, ids, columns = table, None, table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, now, FOLDER).collect(), now.schema)
        assert after.columns == columns
        before, ids = {r.doc_id for r in now.collect()}, [r.doc_id for r in after.collect()]
        assert ids and set(ids) <= before
        if name == "exact_dedup":
            assert after.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count() == len(ids)
        if name == "near_dedup":
            assert near_duplicates(after).where("doc_id <> component_id").count() == 0
        now = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, FOLDER)
    assert {r.doc_id for r in pieces.collect()} == set(ids)


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_stages_take_odd_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs(spark, odd_rows()), FOLDER)
        assert out.count() >= 0
        assert stage(spark, docs(spark, []), FOLDER).count() == 0
