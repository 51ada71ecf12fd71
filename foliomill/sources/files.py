"""File sources: formats by extension, hashes, logs, feeds, JSON, HTML and EPUB-like sections."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: extension -> format of the catalog
FORMATS = {
    "epub": "EPUB", "pdf": "PDF", "mobi": "MOBI", "azw": "AZW", "azw3": "AZW3", "fb2": "FB2", "lit": "LIT", "lrf": "LRF", "pdb": "PDB", "rtf": "RTF",
    "txt": "TXT", "html": "HTML", "htm": "HTML", "docx": "DOCX", "doc": "DOC", "odt": "ODT", "cbz": "CBZ", "cbr": "CBR", "cb7": "CB7", "djvu": "DJVU",
}


def format_of(path: Column) -> Column:
    """Format by the path's extension; unknown ones are UNKNOWN."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit("UNKNOWN"))


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    return {"sha256": lambda c: F.sha2(c, 256), "md5": F.md5, "sha1": F.sha1, "sha512": lambda c: F.sha2(c, 512)}[algorithm](content)


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, format, sha256) of all files below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), format_of(F.col("path")).alias("format"), content_hash(F.col("content")).alias("sha256"))


def table_info(df: DataFrame) -> DataFrame:
    """Row count and size in MB of a file-backed table."""
    per_file = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("rows"), F.round(F.sum("b") / 1048576, 2).alias("mb"))


def five_point(rating: Column) -> Column:
    """A 10-point rating on the 5-point scale."""
    return rating / 2


def read_log(spark: SparkSession, path: str, text: str | None = None, level: str | None = None, tail: int = 100) -> DataFrame:
    """The last ``tail`` lines that hold ``text`` and ``level``; newest first."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    if level:
        lines = lines.filter(F.col("value").contains(level.upper()))
    if text:
        lines = lines.filter(F.lower("value").contains(text.lower()))
    return lines.orderBy(F.desc("n")).limit(tail).select("value")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries: id, title, authors, summary, published, links."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, link array<struct<_href:string,_rel:string,_title:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return raw.select("id", squeeze(F.col("title")).alias("title"), F.transform("author", lambda a: a["name"]).alias("authors"), squeeze(F.col("summary")).alias("summary"), "published", "updated", F.transform("link", lambda x: x["_href"]).alias("links"))


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """Book records of a JSON API page: id, title, authors, format names."""
    schema = "results array<struct<id:long,title:string,authors:array<struct<name:string>>,formats:map<string,string>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("results").alias("r"))
    return raw.select("r.id", "r.title", F.transform("r.authors", lambda a: a["name"]).alias("authors"), F.array_sort(F.map_keys("r.formats")).alias("formats"))


def anchors(html: Column, limit: int | None = None) -> Column:
    """(href, text) of the anchors of an HTML column."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(0))
    parts = F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract(a, r"(?is)>(.*?)</a>$", 1), "<[^>]+>", "")).alias("text")))
    return F.slice(parts, 1, limit) if limit else parts


_TAG = re.compile(rb"<[^>]+>")


def read_chapters(spark: SparkSession, root: str, glob: str = "*.epub") -> DataFrame:
    """(path, location, text): the non-blank documents of zipped books, in order."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
                    texts = [" ".join(_TAG.sub(b" ", z.read(n)).decode("utf-8", "replace").split()) for n in names]
                rows += [(path, f"Chapter {i}", t) for i, t in enumerate(texts, 1) if t]
            yield pd.DataFrame(rows, columns=["path", "location", "text"])

    return raw.mapInPandas(run, "path string, location string, text string")


def read_pages(spark: SparkSession, root: str, extract, glob: str = "*.pdf") -> DataFrame:
    """(path, location, text) of paged files; ``extract`` turns bytes into page texts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, f"Page {i}", t) for p, c in zip(f["path"], f["content"]) for i, t in enumerate(extract(c), 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["path", "location", "text"])

    return raw.mapInPandas(run, "path string, location string, text string")
