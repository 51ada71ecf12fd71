"""Exports: CSV, JSON, HTML and Markdown catalogs, per-record files with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.scalars import escape_html, human_size, stars

#: fixed values: columns of a CSV export
CSV_FIELDS = ["id", "title", "authors", "series", "series_index", "rating", "tags", "publisher", "pubdate", "isbn", "languages", "formats", "comments"]


def flat(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Every column as text: lists joined, structs by name, maps as JSON, nulls empty."""
    out = []
    for name in fields or CSV_FIELDS:
        if name not in df.columns:
            continue
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            label = "name" if "name" in kind.elementType.names else kind.elementType.names[0]
            c = F.array_join(c[label], ", ")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ", ")
        elif isinstance(kind, T.StructType) and "name" in kind.names:
            c = c["name"]
        elif isinstance(kind, (T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    flat(df, fields).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, level: str | None = None) -> None:
    """One object per line; nulls are kept."""
    from foliomill.operators.relations import at_detail

    (at_detail(df, level) if level else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def html_rows(df: DataFrame) -> DataFrame:
    """(id, html): one table row for each record; at most five tags."""
    e = lambda c: escape_html(F.coalesce(c.cast("string"), F.lit("")))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    return df.select("id", F.concat(F.lit("<tr>"), cell(e(F.col("title"))), cell(e(F.array_join("authors", ", "))), cell(e(F.array_join(F.slice("tags", 1, 5), ", "))), cell(stars(F.col("rating"))), F.lit("</tr>")).alias("html"))


def html_cards(df: DataFrame) -> DataFrame:
    e = lambda c: escape_html(F.coalesce(c.cast("string"), F.lit("")))
    return df.select("id", F.concat(F.lit('<div class="card"><h3>'), e(F.col("title")), F.lit("</h3><p>"), e(F.array_join("authors", ", ")), F.lit("</p><p>"), stars(F.col("rating")), F.lit("</p></div>")).alias("html"))


def markdown(df: DataFrame) -> DataFrame:
    """(id, md): a heading and a list of the fields that are set."""
    item = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- **{label}:** "), c))
    return df.select("id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), item("Authors", F.array_join("authors", ", ")), item("Tags", F.array_join("tags", ", ")), item("Rating", F.col("rating").cast("string"))).alias("md"))


def write_pages(parts: DataFrame, column: str, path: str) -> None:
    """Fragments as text files, in id order over all files."""
    parts.orderBy("id").select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_library(df: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """One JSON line per record, in folders by id, and the manifest that is written beside them."""
    df.withColumn("bucket", F.pmod(F.col("id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(f"{path}/records")
    manifest = df.agg(F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def export_records(books: DataFrame, text: str = "comments") -> DataFrame:
    """Records for indexing: names as arrays, sorted distinct upper-case formats, comment without tags."""
    from foliomill.functions.scalars import strip_html

    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<id:bigint,name:string>>")), lambda x: x["name"])
    formats = F.array_sort(F.array_distinct(F.transform("formats", lambda f: F.upper(f["format"]))))
    return books.select("id", "title", names("authors").alias("authors"), names("tags").alias("tags"), F.col("series")["name"].alias("series"), formats.alias("formats"), strip_html(F.col(text)).alias("comments")).orderBy("id")


def text_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(id, line): fixed-width lines."""
    from foliomill.functions.scalars import cell

    return df.select("id", F.concat_ws(" | ", *[cell(F.col(c).cast("string"), w) for c, w in widths.items()]).alias("line"))


def size_label(c: Column) -> Column:
    return human_size(c)
