"""The pipeline and the registered queries over the supplied tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from patchpulse.llm import compression, decontaminate, mixing, neardup, queries  # noqa: E402
from patchpulse.llm.common import table  # noqa: E402

from .helpers import empty, frame, odd_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_decides_as_its_operator(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    keep = [
        lambda d: [r.doc_id for r in compression.quality_scores(d, table(spark, SF, "labels")).collect() if r.predicted],
        lambda d: [r.doc_id for r in neardup.near_duplicates(d).collect() if r.representative],
        lambda d: [r.doc_id for r in decontaminate.decontaminate(d, table(spark, SF, "benchmark")).collect() if not r.contaminated],
        lambda d: [r.doc_id for r in mixing.mix(d).collect() if r.sampled],
    ]
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, keep):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        assert ids(out) == sorted(wanted(docs))
        assert 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(last) == ids(docs)
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)


def test_stages_take_odd_and_empty_tables(spark):
    import random

    docs = frame(spark, odd_rows(random.Random(1)))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, empty(spark), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted(map(tuple, got.select(*columns).collect()))
    theirs = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]}) q").fetchall())
    assert ours == theirs


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
