"""Catalog tables: loading, schemas, role views, and checks on constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_S, _L, _D, _TS, _I = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_ENTITY = T.StructType([T.StructField("id", _L), T.StructField("name", _S)])

#: catalog tables with explicit schemas; nothing is inferred
SCHEMAS: dict[str, T.StructType] = {
    "books": _struct(id=_L, title=_S, sort=_S, timestamp=_TS, pubdate=_TS, series_index=_D, author_sort=_S, isbn=_S, lccn=_S, path=_S, flags=_I, uuid=_S, has_cover=_I, last_modified=_TS),
    "authors": _struct(id=_L, name=_S, sort=_S, link=_S),
    "tags": _struct(id=_L, name=_S),
    "series": _struct(id=_L, name=_S, sort=_S),
    "publishers": _struct(id=_L, name=_S, sort=_S),
    "ratings": _struct(id=_L, rating=_I),
    "comments": _struct(id=_L, book=_L, text=_S),
    "data": _struct(id=_L, book=_L, format=_S, uncompressed_size=_L, name=_S),
    "identifiers": _struct(id=_L, book=_L, type=_S, val=_S),
    "books_authors_link": _struct(book=_L, author=_L),
    "books_tags_link": _struct(book=_L, tag=_L),
    "books_series_link": _struct(book=_L, series=_L),
    "books_ratings_link": _struct(book=_L, rating=_L),
    "books_publishers_link": _struct(book=_L, publisher=_L),
    "user_comments": _struct(book_id=_L, library_path=_S, comment_text=_S, created_at=_TS, updated_at=_TS, user_id=_S),
    "book_extended_metadata": _struct(book_id=_L, library_path=_S, translator=_S, first_published=_S),
    "users": _struct(id=_S, username=_S, email=_S, password_hash=_S, role=_S, created_at=_TS, updated_at=_TS),
}

#: (table, columns) that must be unique, and columns that must be set
UNIQUE = {"series": ["name"], "tags": ["name"], "comments": ["book"], "data": ["book", "format"], "identifiers": ["book", "type"], "books_authors_link": ["book", "author"], "books_tags_link": ["book", "tag"]}
REQUIRED = {"books": ["title", "path"], "authors": ["name"], "tags": ["name"], "series": ["name"], "comments": ["book", "text"], "data": ["book", "format"]}

#: the denormalised record of one book
RECORD = T.StructType([
    T.StructField("id", _L), T.StructField("title", _S), T.StructField("authors", T.ArrayType(_ENTITY)), T.StructField("tags", T.ArrayType(_ENTITY)),
    T.StructField("series", _ENTITY), T.StructField("rating", _I), T.StructField("publisher", _S), T.StructField("identifiers", T.MapType(_S, _S)),
    T.StructField("comments", _S), T.StructField("formats", T.ArrayType(_struct(format=_S, filename=_S, path=_S, size=_L))),
])


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def load(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES, views: bool = True) -> dict[str, DataFrame]:
    """All named tables, also as temporary views for ``spark.sql``."""
    out = {n: table(spark, directory, n) for n in names}
    if views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out


def rows(spark: SparkSession, statement: str) -> DataFrame:
    """A raw SQL scan over the loaded views."""
    return spark.sql(statement)


def find_table(spark: SparkSession, root: str, file: str = "metadata.parquet") -> str | None:
    """Path of a catalog file: the root itself, in the root, or one level down."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if root.endswith(file) and fs.exists(path):
        return root
    for pattern in (f"{root}/{file}", f"{root}/*/{file}"):
        hits = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern))
        if hits:
            return sorted(str(h.getPath()) for h in hits)[0]
    return None


def discover(spark: SparkSession, root: str, file: str = "metadata.parquet") -> DataFrame:
    """(name, path) of every catalog one level below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{file}")
    hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    found = [(str(h.getPath().getParent().getName()), str(h.getPath())) for h in hits]
    return spark.createDataFrame(found, "name string, path string")


def merge_sources(sources: list[DataFrame], key: str = "name", dedupe: bool = True) -> DataFrame:
    """Union of discovery sources; with ``dedupe`` a later source wins."""
    all_rows = reduce(DataFrame.unionByName, [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)])
    if not dedupe:
        return all_rows.drop("_priority")
    others = [c for c in all_rows.columns if c not in (key, "_priority")]
    return all_rows.groupBy(key).agg(F.max_by(F.struct(*others), "_priority").alias("x")).select(key, "x.*")


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with every column of ``schema``; missing ones become typed nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) for the unique and required columns of the given tables."""
    parts = []
    for name, columns in UNIQUE.items():
        if name in tables:
            n = tables[name].groupBy(*columns).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
            parts.append(n.select(F.lit(f"unique {name}({','.join(columns)})").alias("check"), "violations"))
    for name, columns in REQUIRED.items():
        if name in tables:
            n = tables[name].agg(F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).alias("violations"))
            parts.append(n.select(F.lit(f"required {name}({','.join(columns)})").alias("check"), "violations"))
    return reduce(DataFrame.unionByName, parts)


# --- roles: the catalog's entities over the driver tables ----------------------------


def books(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.col("p_brand").alias("series"), F.col("p_size").cast("double").alias("series_index"), F.col("p_type").alias("tag"), F.col("p_retailprice").alias("size"))


def authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))


def book_authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("book"), F.col("l_suppkey").alias("author")).distinct()


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """One rating from 1 to 5 for the books that have a line numbered so low."""
    return table(spark, d, "lineitem").filter("l_linenumber <= 5").groupBy(F.col("l_partkey").alias("book")).agg(F.min("l_linenumber").cast("int").alias("rating"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("ts").alias("start"), F.col("value").alias("minutes"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("pages"))
