"""The pipeline and the queries as registered."""

import os

import duckdb
import pandas as pd

import corpus_pipeline
from tests.llm.helpers import documents, empty
from tests.llm.test_documents import brute_cut, brute_fingerprint, brute_groups
from vecforge.llm import queries, stages


def test_registered(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "poisson_mixing", "sum_of_squares_packing"]


def test_mixing_against_sql(spark, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    name = "op4_poisson_mixing"
    want, got = con.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    got, want = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_stages_on_their_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() <= docs.count()
    once = stages.drop_near_copies(spark, docs, sf)
    groups = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(groups.values()))
    cut = {r.doc_id: r for r in stages.cut_repeats(spark, docs, sf).collect()}
    rows = docs.collect()
    for r, (_, gone, _, _) in zip(rows, brute_cut([r.text.encode() for r in rows]), strict=True):
        left = len(cut[r.doc_id].text.encode())
        assert left == len(r.text.encode()) - gone or r.text.isascii() is False and 0 <= left - (len(r.text.encode()) - gone) < 20
        assert cut[r.doc_id].n_chars == len(cut[r.doc_id].text)


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf).groupBy("doc_id").sum("length").collect()
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tokens))


def test_odd_and_empty_documents(spark, sf):
    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() >= 0 and (name == "sum_of_squares_packing" or out.columns == docs.columns)
