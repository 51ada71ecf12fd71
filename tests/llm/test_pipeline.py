"""The pipeline's stages, one by one and together."""

from pyspark.sql import functions as F

import corpus_pipeline
from foliomill.llm import queries
from tests.llm import brute


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    secret = "password = abcdefghijkl1234"
    words = " ".join(f"k{i}" for i in range(120))
    extra = spark.createDataFrame([(300, f"{words} {secret} end", "en", "s", 1), (301, f"{words} {secret} END", "en", "s", 1), (302, f"{words} changed end", "en", "s", 1), (None, " ".join(f"q{i}" for i in range(90)), None, None, None)], docs.schema)
    kept = docs.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_redaction", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        kept = queries_written(spark, stage(spark, before, tables), name)
        assert kept.columns == corpus_pipeline.COLUMNS
    rows = {r.doc_id: r for r in kept.collect()}
    assert not any(200 <= (i or 0) < 260 for i in rows) and 100 in rows and None in rows
    assert 300 in rows and 301 not in rows and 302 not in rows
    assert "[ASSIGN]" in rows[300].text and secret not in rows[300].text and rows[300].n_chars == len(rows[300].text)
    placed = corpus_pipeline.STAGES[3][1](spark, kept, tables).collect()
    assert {p.doc_id for p in placed} == set(rows)


def queries_written(spark, df, name):
    from foliomill.llm.store import materialize

    return materialize(df, name)


def test_groups_follow_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = brute.components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, tables).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and out.groupBy("doc_id", "piece").count().filter("count > 1").count() == 0


def test_every_query_runs(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for name, q in queries.QUERIES.items():
        df = q(spark, d)
        assert df.agg(F.count(F.lit(1))).first()[0] > 0, name
