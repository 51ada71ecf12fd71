"""Relational operators of the catalog: filters through link tables, denormalising, paging, sets.

Filters over many-to-many metadata are semi and anti joins, so a book is never
multiplied by its matches and nothing has to be made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def like(c: Column, text: str) -> Column:
    """Case-insensitive substring; % and _ in ``text`` act as wildcards."""
    return F.coalesce(c.ilike(f"%{text}%"), F.lit(False))


def all_words(c: Column, name: str) -> Column:
    """Every word of ``name`` occurs in the same value."""
    return reduce(lambda a, b: a & b, [like(c, w) for w in name.split()], F.lit(True))


def any_like(c: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [like(c, t) for t in texts])


def day_range(c: Column, first: str | None = None, last: str | None = None) -> Column:
    """From the first day's midnight to the end of the last day; unreadable dates do not filter."""
    day = lambda s: F.try_to_date(F.lit(s), "yyyy-MM-dd")
    low = F.lit(True) if first is None else F.coalesce(c >= day(first), day(first).isNull())
    high = F.lit(True) if last is None else F.coalesce(c < F.date_add(day(last), 1), day(last).isNull())
    return low & high


@dataclass
class Linked:
    """An entity reached from a book: link table (book, key) and entity table (id, name)."""

    link: DataFrame
    entity: DataFrame
    key: str
    name: str = "name"

    def books(self, test: Column) -> DataFrame:
        """Ids of the books with an entity that passes."""
        keys = self.entity.filter(test).select(F.col("id").alias(self.key))
        return self.link.join(keys, self.key, "left_semi").select(F.col("book").alias("id"))


def having(books: DataFrame, ids: DataFrame) -> DataFrame:
    return books.join(ids, "id", "left_semi")


def lacking(books: DataFrame, ids: DataFrame) -> DataFrame:
    return books.join(ids, "id", "left_anti")


@dataclass
class BookFilters:
    """Everything a search can ask for; unset fields do not filter."""

    title: str | None = None
    search: str | None = None
    author_id: int | None = None
    author: str | None = None
    authors: list[str] = field(default_factory=list)
    exclude_authors: list[str] = field(default_factory=list)
    series: str | None = None
    exclude_series: list[str] = field(default_factory=list)
    tag_id: int | None = None
    tag: str | None = None
    tags: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)
    comment: str | None = None
    has_cover: bool | None = None
    rating: int | None = None
    min_rating: int | None = None
    max_rating: int | None = None
    unrated: bool = False
    publisher: str | None = None
    publishers: list[str] = field(default_factory=list)
    has_publisher: bool | None = None
    pubdate: tuple[str | None, str | None] = (None, None)
    added: tuple[str | None, str | None] = (None, None)
    min_size: int | None = None
    max_size: int | None = None
    formats: list[str] = field(default_factory=list)
    has_empty_comments: bool | None = None
    equal: dict[str, Any] = field(default_factory=dict)
    limit: int = 50
    offset: int = 0

    def check(self) -> None:
        for r in (self.rating, self.min_rating, self.max_rating):
            if r is not None and not 1 <= r <= 5:
                raise ValueError("ratings are from 1 to 5")
        if self.min_rating and self.max_rating and self.min_rating > self.max_rating:
            raise ValueError("min_rating exceeds max_rating")
        if self.min_size is not None and self.min_size < 0 or (self.min_size and self.max_size and self.min_size > self.max_size):
            raise ValueError("sizes are not negative and in order")
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit is from 1 to 1000, offset not negative")


def apply_filters(books: DataFrame, f: BookFilters, linked: dict[str, Linked], comments: DataFrame | None = None, ratings: DataFrame | None = None, data: DataFrame | None = None) -> DataFrame:
    """Books that pass every set filter.

    ``linked`` has authors, series, tags and publishers; ``ratings`` is (book, rating).
    """
    f.check()
    out = books
    name = F.col("name")
    if f.title:
        out = out.filter(like(F.col("title"), f.title))
    if f.search:
        hits = [linked[k].books(like(name, f.search)) for k in ("authors", "series", "tags") if k in linked]
        hits.append(books.filter(like(F.col("title"), f.search)).select("id"))
        out = having(out, reduce(DataFrame.unionByName, hits))
    for kind, one in (("authors", f.author_id), ("tags", f.tag_id)):
        if one is not None:
            out = having(out, linked[kind].books(F.col("id") == one))
    if f.author:
        out = having(out, linked["authors"].books(all_words(name, f.author)))
    if f.authors:
        out = having(out, linked["authors"].books(reduce(lambda a, b: a | b, [all_words(name, a) for a in f.authors])))
    if f.exclude_authors:
        out = lacking(out, linked["authors"].books(reduce(lambda a, b: a | b, [all_words(name, a) for a in f.exclude_authors])))
    for kind, wanted, unwanted in (("series", [f.series] if f.series else [], f.exclude_series), ("tags", [*([f.tag] if f.tag else [])], []), ("tags", f.tags, f.exclude_tags), ("publishers", [f.publisher] if f.publisher else [], []), ("publishers", f.publishers, [])):
        if wanted:
            out = having(out, linked[kind].books(any_like(name, wanted)))
        if unwanted:
            out = lacking(out, linked[kind].books(any_like(name, unwanted)))
    if f.has_publisher is not None:
        named = linked["publishers"].books(F.coalesce(name, F.lit("")) != "")
        out = having(out, named) if f.has_publisher else lacking(out, named)
    if f.comment:
        out = having(out, comments.filter(like(F.col("text"), f.comment)).select(F.col("book").alias("id")))
    if f.has_empty_comments is not None:
        filled = comments.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select(F.col("book").alias("id"))
        out = lacking(out, filled) if f.has_empty_comments else having(out, filled)
    if f.has_cover is not None:
        out = out.filter(F.col("has_cover") == int(f.has_cover))
    if f.unrated:
        out = lacking(out, ratings.select(F.col("book").alias("id")))
    bounds = [F.col("rating") == f.rating] * (f.rating is not None) + [F.col("rating") >= f.min_rating] * (f.min_rating is not None) + [F.col("rating") <= f.max_rating] * (f.max_rating is not None)
    if bounds:
        out = having(out, ratings.filter(reduce(lambda a, b: a & b, bounds)).select(F.col("book").alias("id")))
    if f.pubdate != (None, None):
        out = out.filter(day_range(F.col("pubdate"), *f.pubdate))
    if f.added != (None, None):
        out = out.filter(day_range(F.col("timestamp"), *f.added))
    if f.formats:
        out = having(out, data.filter(F.upper("format").isin([x.upper() for x in f.formats])).select(F.col("book").alias("id")))
    if f.min_size is not None or f.max_size is not None:
        total = data.groupBy("book").agg(F.sum("uncompressed_size").alias("s"))
        test = (F.col("s") >= f.min_size if f.min_size is not None else F.lit(True)) & (F.col("s") <= f.max_size if f.max_size is not None else F.lit(True))
        out = having(out, total.filter(test).select(F.col("book").alias("id")))
    for column, value in f.equal.items():
        if column not in books.columns:
            raise ValueError(f"unknown column {column}")
        out = out.filter(F.col(column).isin(value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return out


# --- sorting and paging ---------------------------------------------------------------


def ordered(df: DataFrame, by: str, descending: bool = False, columns: dict[str, str] | None = None, default: str = "title", tie: str = "id", nulls_last: bool = True) -> DataFrame:
    """Sorted by a named field, or the default if there is none of that name; ties by id."""
    c = F.col((columns or {}).get(by, by if by in df.columns else default))
    if descending:
        key = c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    else:
        key = c.asc_nulls_last() if nulls_last else c.asc_nulls_first()
    return df.orderBy(key, F.col(tie))


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a totally ordered relation."""
    return df.offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(total, page, page_size, total_pages); at least one page."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(offset // limit + 1).cast("long").alias("page"), F.lit(limit).cast("long").alias("page_size"), F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long").alias("total_pages"))


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def by_letter(df: DataFrame, column: str, letter: str) -> DataFrame:
    """Rows whose value begins with a letter, in order; nothing for other signs."""
    if len(letter) != 1 or not letter.isalpha():
        return df.limit(0)
    return df.filter(F.col(column).ilike(f"{letter}%")).orderBy(column, "id")


def by_key_or_uuid(df: DataFrame, key: str) -> DataFrame:
    """A row by number, or by uuid where the key is not a number."""
    n = F.lit(key).try_cast("long")
    return df.filter(F.when(n.isNotNull(), F.col("id") == n).otherwise(F.col("uuid") == key))


# --- denormalising --------------------------------------------------------------------


def gathered(link: DataFrame, entity: DataFrame, key: str, out: str) -> DataFrame:
    """(id, out): each book's entities as an array of (id, name), by id."""
    rows = link.join(entity.select(F.col("id").alias(key), "name"), key)
    return rows.groupBy(F.col("book").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), "name"))).alias(out))


def denormalise(t: dict[str, DataFrame]) -> DataFrame:
    """One record per book; each child is aggregated before it is joined, so rows never multiply."""
    out = t["books"]
    for table_, key, name in (("books_authors_link", "author", "authors"), ("books_tags_link", "tag", "tags")):
        out = out.join(gathered(t[table_], t[name], key, name), "id", "left")
    series = t["books_series_link"].join(t["series"].select(F.col("id").alias("series"), F.col("name").alias("n")), "series").groupBy(F.col("book").alias("id")).agg(F.min(F.struct(F.col("series").alias("id"), F.col("n").alias("name"))).alias("series"))
    rating = t["books_ratings_link"].join(t["ratings"].select(F.col("id").alias("rating"), F.col("rating").alias("r")), "rating").groupBy(F.col("book").alias("id")).agg(F.min("r").alias("rating"))
    comment = t["comments"].select(F.col("book").alias("id"), F.col("text").alias("comments"))
    formats = t["data"].groupBy(F.col("book").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.upper("format").alias("format"), "name", F.col("uncompressed_size").alias("size")))).alias("formats"))
    for child in (series, rating, comment, formats):
        out = out.join(child, "id", "left")
    if "identifiers" in t:
        ids = t["identifiers"].groupBy(F.col("book").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "val")))).alias("identifiers"))
        out = out.join(ids, "id", "left")
    if "publishers" in t:
        names = gathered(t["books_publishers_link"], t["publishers"], "publisher", "p")
        out = out.join(names.select("id", F.array_join(F.transform("p", lambda x: x["name"]), ", ").alias("publisher")), "id", "left")
    return out


def joined_names(link: DataFrame, entity: DataFrame, key: str, separator: str = "|") -> DataFrame:
    """(id, names): distinct names in order, in one string."""
    rows = link.join(entity.select(F.col("id").alias(key), "name"), key)
    return rows.groupBy(F.col("book").alias("id")).agg(F.concat_ws(separator, F.array_sort(F.collect_set("name"))).alias("names"))


def split_names(c: Column) -> Column:
    """The names of a joined string, blanks dropped."""
    return F.filter(F.split(c, r"\|"), lambda v: v != "")


def read_timestamp(c: Column) -> Column:
    """Two spellings of a timestamp."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


#: fixed values: columns of the detail levels
DETAIL = {
    "minimal": ["id", "title", "authors"],
    "standard": ["id", "title", "authors", "tags", "series", "rating"],
    "full": ["id", "title", "authors", "tags", "series", "rating", "publisher", "identifiers", "comments", "formats"],
}


def at_detail(df: DataFrame, level: str = "standard") -> DataFrame:
    return df.select(*[c for c in DETAIL[level] if c in df.columns])


def across(catalogs: dict[str, DataFrame], query: Callable[[DataFrame], DataFrame], limit: int = 50) -> DataFrame:
    """The same query over several catalogs of their own, rows tagged with the catalog, the first ``limit``."""
    parts = [query(df).withColumn("library_name", F.lit(n)) for n, df in catalogs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("library_name", "id").limit(limit)


def within(rows: DataFrame, query: Callable[[DataFrame], DataFrame], limit: int = 50) -> DataFrame:
    """The same over rows that carry their ``library_name``: one scan however many libraries there are."""
    return query(rows).orderBy("library_name", "id").limit(limit)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, since: list[str]) -> DataFrame:
    """(key, change): rows added, modified (in the ``since`` columns) or deleted."""
    pick = lambda df, p: df.select(F.col(key).alias(f"{p}_k"), F.struct(*since).alias(f"{p}_v"))
    both = pick(old, "o").join(pick(new, "n"), F.col("o_k") == F.col("n_k"), "full")
    change = F.when(F.col("o_k").isNull(), "added").when(F.col("n_k").isNull(), "deleted").when(~F.col("o_v").eqNullSafe(F.col("n_v")), "modified")
    return both.select(F.coalesce("n_k", "o_k").alias(key), change.alias("change")).filter("change is not null")
