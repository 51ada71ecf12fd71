"""A remote catalog as a Python data source, with the connector's query text and retry policy.

``fetch`` is injected (a function from a request path to parsed JSON), so the
source runs against any transport and is testable without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader, StringContains

SCHEMA = "id long, title string, authors array<string>, formats array<string>, author string"
#: columns that the remote search knows, and its names for them
FIELDS = {"title": "title", "author": "authors"}


def field_query(text: str, fields: list[str], operator: str = "AND") -> str:
    """``field:text`` terms joined with AND or OR."""
    joiner = f" {operator.upper()} "
    return joiner.join(f"{f}:{text}" for f in fields) if fields else text


def with_retries(fetch: Callable[[str], dict], tries: int = 3, wait: float = 0.5) -> Callable[[str], dict]:
    """Retry with exponential back-off; the last error is raised."""

    def call(path: str) -> dict:
        for k in range(tries):
            try:
                return fetch(path)
            except OSError:
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError("unreachable")

    return call


def pushed_terms(filters: Iterable[Filter]) -> list[str]:
    """The filters that the remote search can state, as its terms; it ignores case, so Spark looks again."""
    out = []
    for f in filters:
        if isinstance(f, EqualTo) and f.attribute in (("title",), ("author",)):
            out.append(f'{FIELDS[f.attribute[0]]}:"={f.value}"')
        elif isinstance(f, StringContains) and f.attribute in (("title",), ("author",)):
            out.append(f'{FIELDS[f.attribute[0]]}:"{f.value}"')
    return out


def pushed_ids(filters: Iterable[Filter]) -> list[int] | None:
    """The ids that ``id = x`` and ``id in (...)`` leave, or None where neither is among the filters."""
    out: set[int] | None = None
    for f in filters:
        if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
            one = {int(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
            out = one if out is None else out & one
    return None if out is None else sorted(out)


def source(fetch: Callable[[str], dict], batch: int = 100) -> type[DataSource]:
    """A data source class that searches, then reads records in batches of ids.

    Filters on title, author and id go into the request.  Options: ``query`` (more
    search terms), ``page`` (ids of one search request, by default 1000) and
    ``limit`` (records at most; without it all pages are read).  The driver learns
    the number of hits and plans pages; tasks fetch a page's ids and records.  As a
    stream it gives records with ids above those it has read.
    """
    call = with_retries(fetch)

    class Page(InputPartition):
        def __init__(self, terms: str, offset: int, size: int, ids: list[int] | None = None):
            self.terms, self.offset, self.size, self.ids = terms, offset, size, ids

    def found(terms: str, offset: int, size: int) -> dict:
        return call(f"search?query={quote(terms)}&sort=id&sort_order=asc&offset={offset}&num={size}")

    def records(ids: list[int]) -> Iterator[tuple]:
        for i in range(0, len(ids), batch):
            part = ids[i : i + batch]
            got = call("books?ids=" + ",".join(map(str, part)))
            for k in part:
                r = got.get(str(k))
                if r:
                    authors = list(r.get("authors", []))
                    yield k, r.get("title"), authors, sorted(r.get("formats", {})), " & ".join(authors)

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.query, self.page = options.get("query", ""), int(options.get("page", 1000))
            self.limit = int(options["limit"]) if "limit" in options else None
            self.terms: list[str] = []
            self.ids: list[int] | None = None

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
            self.terms, self.ids = pushed_terms(filters), pushed_ids(filters)
            return filters

        def partitions(self) -> list[InputPartition]:
            if self.ids is not None:
                return [Page("", 0, batch, self.ids[i : i + batch]) for i in range(0, len(self.ids), batch)] or [Page("", 0, 0, [])]
            terms = " and ".join([*([self.query] if self.query else []), *self.terms])
            most = self.page if self.limit is None else min(self.page, self.limit)
            first = found(terms, 0, most)
            total = first.get("total_num", len(first.get("book_ids", [])))
            total = total if self.limit is None else min(total, self.limit)
            pages = [Page(terms, at, min(self.page, total - at)) for at in range(0, total, self.page)]
            if pages:  # its ids are known already
                pages[0].ids = first.get("book_ids", [])[: pages[0].size]
            return pages or [Page("", 0, 0, [])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            ids = found(partition.terms, partition.offset, partition.size).get("book_ids", []) if partition.ids is None else partition.ids
            yield from records(ids)

    class Stream(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.query, self.page = options.get("query", ""), int(options.get("page", 1000))

        def initialOffset(self) -> dict:  # noqa: N802
            return {"above": -1}

        def _after(self, above: int) -> list[int]:
            terms = " and ".join([*([self.query] if self.query else []), f"id:>{above}"])
            return sorted(found(terms, 0, self.page).get("book_ids", []))

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            ids = self._after(start["above"])
            return iter(list(records(ids))), {"above": ids[-1] if ids else start["above"]}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
            return iter(list(records([i for i in self._after(start["above"]) if i <= end["above"]])))

    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return "remote_catalog"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
            return Stream(self.options)

    return Remote


def load(spark: SparkSession, **options: str) -> DataFrame:
    """The registered source with filters handed down; a DataFrame's plan keeps the setting it was made with."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("remote_catalog").options(**options).load()


def list_books(spark: SparkSession, author: str | None = None, title: str | None = None, limit: int | None = None) -> DataFrame:
    """Records whose author or title holds a text in any case; the remote side searches and counts to the limit."""
    parts = [f'{FIELDS[k]}:"{v}"' for k, v in (("author", author), ("title", title)) if v]
    options = {"query": " and ".join(parts)} | ({"limit": str(limit)} if limit is not None else {})
    return load(spark, **options)


def by_ids(books: DataFrame, ids: list[int]) -> DataFrame:
    """Records for a list of ids, in its order; missing ids are dropped."""
    spark: SparkSession = books.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, position int")
    return wanted.join(books, "id").orderBy("position").drop("position")


#: source kinds by name; a backend has list_books, get_book and info
class LocalBackend:
    def __init__(self, books: DataFrame, data: DataFrame | None = None):
        self.books, self.data = books, data

    def list_books(self, title: str | None = None, limit: int = 50) -> DataFrame:
        df = self.books if not title else self.books.filter(F.col("title").ilike(f"%{title}%"))
        return df.orderBy("title", "id").limit(limit)

    def get_book(self, book_id: int) -> DataFrame:
        return self.books.filter(F.col("id") == book_id)

    def info(self) -> DataFrame:
        """Number of books, and the size of all files whose book exists."""
        n = self.books.agg(F.count(F.lit(1)).alias("books"))
        if self.data is None:
            return n.withColumn("bytes", F.lit(0).cast("long"))
        kept = self.data.join(self.books.select(F.col("id").alias("book")), "book", "left_semi")
        return n.crossJoin(kept.agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("bytes")))


def backend(name: str, registry: dict[str, LocalBackend]) -> LocalBackend:
    """The backend registered under ``name``, else the local one."""
    return registry.get(name, registry["local"])
