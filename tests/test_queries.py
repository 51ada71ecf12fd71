"""Every named query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from foliomill import registry
from foliomill.sources.catalog import TABLES

DIRECTORY = "/root/testdata/sf0.001"


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIRECTORY)
    rows = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(tuple(shown(r[i]) for i in order) for r in result.fetchall())


def test_entry():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, table", [("progress_percent", "documents"), ("pivot_updates", "orders"), ("job_transition", "orders")])
def test_every_row_has_a_result(spark, duck, name, table):
    assert registry.queries()[name](spark, DIRECTORY).count() == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_every_key_has_a_result(spark, duck):
    of = lambda name, key: {r[key] for r in registry.queries()[name](spark, DIRECTORY).collect()}
    assert of("graph_degrees", "user") == {r[0] for r in duck.execute("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()}
    assert of("series_gaps", "series") == of("series_missing_from_one", "series") == {r[0] for r in duck.execute("SELECT DISTINCT p_brand FROM part").fetchall()}
    assert len(of("cross_library_search", "library_name")) > 3


def test_gaps_of_a_small_series(spark):
    from foliomill.operators import sequence

    df = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("a", 6.0), ("b", 1.0)], "series string, i double")
    assert {r.series: r.missing for r in sequence.gaps(df, "series", "i").collect()} == {"a": [4, 5], "b": []}
    assert {r.series: r.missing for r in sequence.gaps(df, "series", "i", from_one=True).collect()} == {"a": [1, 4, 5], "b": []}
    assert [tuple(r) for r in sequence.gap_ranges(df, "series", "i").collect()] == [("a", 4, 5)]


def test_requests_are_read_alike(spark):
    """The column form against the parser of one request, over a table and over requests of every kind."""
    import datetime

    from pyspark.sql import functions as F

    from foliomill.functions import nlquery

    now = datetime.date(2024, 5, 15)
    asked = ["books by Agatha Christie", "tagged as mystery", "published in 1987", "Rated 4", "in series Foundation", "dune", "what books do we have", "german thrillers from last  month", "title 3 stars", '"By the Sea" rated 5', "'only a title'", "manga naruto", "Some Comics", "show me", None, "", "  ",
             "japan locked room puzzles", "polish crime and horror novels", "author Le Guin series Hainish", "list all the books about noir", "x added this week tag a b", "one two three four five six seven eight nine ten", "9 stars", "noir by somebody with plenty of words"]
    rows = [(i, q) for i, q in enumerate(asked)]
    rows += [(100 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{DIRECTORY}/conversations.parquet").collect())]
    df = spark.createDataFrame(rows, "id int, q string")
    for r in nlquery.read_requests(df, "q", now).select("id", "q", F.col("parsed.*")).collect():
        want = nlquery.parse(r.q, now)
        assert {k: r[k] for k in vars(want)} == vars(want), r.q
