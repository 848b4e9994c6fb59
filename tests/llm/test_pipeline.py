"""The pipeline against its stages done plainly, and the registered queries."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import plain_components
from tidewatch.llm import exact_dedup, queries


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names)
    assert [n for n in names if n.startswith("op")] and set(entry.oracle_sql()) <= set(names)


def test_exact_dedup_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = con.execute(queries.OP4_SQL)
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    got = queries.op4_exact_dedup(spark, sf_dir).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("mine"))
    passed = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    good = {r.doc_id for r in queries.op5_quality_rules(spark, sf_dir).where("kept").collect()}
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == good
    civil = corpus_pipeline.toxicity_stage(spark, passed, sf_dir)
    toxic = {r.doc_id for r in queries.op6_toxicity(spark, sf_dir).where("toxic").collect()}
    assert civil.columns == docs.columns and {r.doc_id for r in civil.collect()} == good - toxic
    first = corpus_pipeline.exact_stage(spark, civil, sf_dir)
    stay = {r.doc_id for r in exact_dedup.label_copies(civil).where("kept").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == stay
    one = corpus_pipeline.near_stage(spark, first, sf_dir)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    alone = {i for i, _, c in plain_components(rows) if i == c}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == alone
    packed = corpus_pipeline.packing_stage(spark, one, sf_dir)
    assert {r.doc_id for r in packed.collect()} == alone


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(r.length > 0 and r.doc_tokens >= r.start + r.length for r in got)


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and empty texts, null and repeated ids, repeated rows, clashing columns: no stage loses an unlike clean text."""
    clean = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep = corpus_pipeline.quality_stage(spark, clean, sf_dir)
    one, two = [r.text for r in corpus_pipeline.near_stage(spark, corpus_pipeline.exact_stage(spark, keep, sf_dir), sf_dir).limit(2).collect()]
    rows = [(5, one), (5, two), (5, one), (None, two + " and one more"), (None, None), (6, None), (7, ""), (7, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", True) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _key string, kept boolean")
    passed = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert {r.text for r in passed.collect()} >= {one, two}
    civil = corpus_pipeline.toxicity_stage(spark, passed, sf_dir)
    first = corpus_pipeline.exact_stage(spark, civil, sf_dir)
    kept = corpus_pipeline.near_stage(spark, first, sf_dir)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect())
    assert got == sorted([(5, one), (5, two)])
    for stage_ in (s for _, s in corpus_pipeline.STAGES):
        assert stage_(spark, docs.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] > 0
