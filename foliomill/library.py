"""A catalog and its operations by name: ``Library(tables).run(tool, operation, **arguments)``.

Every operation returns a DataFrame.  Operations that change something return the
new relation and keep it in ``tables``, so later operations see it; nothing is
written until the caller writes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import nlquery
from foliomill.functions import scalars as S
from foliomill.functions import text as X
from foliomill.operators import dedupe, exports, fusion, mutations, predicates, relations, sequence, stats
from foliomill.operators.relations import BookFilters, Linked
from foliomill.operators.textindex import TextIndex

Operation = Callable[..., DataFrame]

#: entity -> (its link table, the key there)
ENTITIES = {"authors": ("books_authors_link", "author"), "tags": ("books_tags_link", "tag"), "series": ("books_series_link", "series"), "publishers": ("books_publishers_link", "publisher")}


class Library:
    """Operations over a dictionary of catalog tables."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)
        self.collections = predicates.Collections()
        self.text_index: TextIndex | None = None
        self.operations: dict[tuple[str, str], Operation] = {}
        for kind in ENTITIES:
            if ENTITIES[kind][0] in self.tables:
                self._entity(kind)
        self._books()
        self._analysis()
        self._changes()

    def run(self, tool: str, operation: str, **arguments: Any) -> DataFrame:
        if (tool, operation) not in self.operations:
            raise KeyError(f"no operation {operation!r} of {tool!r}")
        return self.operations[tool, operation](**arguments)

    def names(self) -> list[tuple[str, str]]:
        return sorted(self.operations)

    def _add(self, tool: str, **operations: Operation) -> None:
        self.operations |= {(tool, name): f for name, f in operations.items()}

    # --- entities --------------------------------------------------------------------

    def _used(self, kind: str) -> DataFrame:
        link, key = ENTITIES[kind]
        return stats.usage(self.tables[kind].select("id", "name"), self.tables[link], key)

    def _entity(self, kind: str) -> None:
        link, key = ENTITIES[kind]

        def listed(search: str | None = None, unused_only: bool = False, min_books: int = 0, max_books: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
            u = self._used(kind).filter(F.col("books") >= min_books)
            if search:
                u = u.filter(relations.like(F.col("name"), search))
            if unused_only:
                u = u.filter("books = 0")
            if max_books is not None:
                u = u.filter(F.col("books") <= max_books)
            return relations.page(u.orderBy("name", "id"), limit, offset)

        def get(id: int | None = None, name: str | None = None) -> DataFrame:  # noqa: A002
            u = self._used(kind)
            return u.filter(F.col("id") == id) if id is not None else u.filter(F.lower("name") == (name or "").lower())

        def books(id: int, limit: int = 50, offset: int = 0) -> DataFrame:  # noqa: A002
            ids = self.tables[link].filter(F.col(key) == id).select(F.col("book").alias("id"))
            order = ["series_index", "id"] if kind == "series" else ["sort", F.desc("pubdate"), "id"]
            return relations.page(relations.having(self.tables["books"], ids).orderBy(*order), limit, offset)

        def totals(top: int = 10) -> DataFrame:
            u = self._used(kind)
            best = u.orderBy(F.desc("books"), "name").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("books")).alias("k"), "name", "books"))).alias("x"))
            letters = stats.first_letters(u, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "n")))).alias("letters"))
            return stats.one_row({"u": stats.usage_stats(u), "l": letters, "t": best.select(F.transform("x", lambda e: F.struct(e["name"], e["books"])).alias("top"))})

        tool = f"manage_{kind}"
        self._add(tool, list=listed, get=get, get_books=books, stats=totals, by_letter=lambda letter: relations.by_letter(self.tables[kind], "name", letter))

        def keep(table: str, df: DataFrame) -> DataFrame:
            self.tables[table] = df
            return df

        if kind == "tags":
            doubles = lambda least=0.8: dedupe.fuzzy_groups(self._used("tags"), None, least)

            def merge(sources: list[int], target: int) -> DataFrame:
                n = mutations.affected(self.tables[link], key, sources)
                count = n.sparkSession.createDataFrame(n.collect(), n.schema)  # before the change
                keep(link, mutations.merge_keys(self.tables[link], key, sources, target))
                keep("tags", mutations.delete(self.tables["tags"], sources))
                return count

            self._add(
                tool,
                create=lambda new: keep("tags", mutations.add_unique(self.tables["tags"], new, normalise=S.tag_name)),
                update=lambda id, name: keep("tags", mutations.update(self.tables["tags"], id, {"name": name})),
                delete=lambda id: (keep(link, self.tables[link].filter(F.col(key) != id)), keep("tags", mutations.delete(self.tables["tags"], [id])))[1],
                find_duplicates=doubles,
                merge=merge,
                get_unused=lambda: self._used("tags").filter("books = 0"),
                delete_unused=lambda: keep("tags", mutations.drop_unused(self.tables["tags"], self.tables[link], key)),
                statistics=lambda: stats.usage_stats(self._used("tags")),
            )
        else:
            self._add(
                tool,
                create=lambda new: keep(kind, mutations.add_unique(self.tables[kind], new)),
                update=lambda id, name: keep(kind, mutations.update(self.tables[kind], id, {"name": name})),
                delete=lambda id: keep(kind, mutations.restrict_delete(self.tables[kind], self.tables[link], key, id)),
            )

    # --- books -----------------------------------------------------------------------

    def linked(self) -> dict[str, Linked]:
        return {k: Linked(self.tables[link], self.tables[k], key) for k, (link, key) in ENTITIES.items() if link in self.tables}

    def ratings(self) -> DataFrame:
        r = self.tables["ratings"].select(F.col("id").alias("rating"), F.col("rating").alias("stars"))
        return self.tables["books_ratings_link"].join(r, "rating").select("book", F.col("stars").alias("rating"))

    def _books(self) -> None:
        t = self.tables

        def search(filters: BookFilters | None = None, sort_by: str = "title", descending: bool = False, **fields: Any) -> DataFrame:
            f = filters or BookFilters(**fields)
            hits = relations.apply_filters(t["books"], f, self.linked(), t.get("comments"), self.ratings(), t.get("data"))
            if sort_by == "rating":
                hits = hits.join(self.ratings().groupBy(F.col("book").alias("id")).agg(F.max("rating").alias("rating")), "id", "left")
            return relations.page(relations.ordered(hits, sort_by, descending), f.limit, f.offset)

        def ask(query: str, now: Any, **fields: Any) -> DataFrame:
            """A request in natural language; explicit fields win over parsed ones.

            A request that reads as a question goes to the text index first, if there is
            one; the parsed search answers where the index finds nothing.
            """
            p = nlquery.parse(query, now)
            parsed: dict[str, Any] = {"author": p.author, "tag": p.tag, "series": p.series, "rating": p.rating, "search": p.text or None}
            if p.pubdate:
                parsed["pubdate"] = (f"{p.pubdate}-01-01", f"{p.pubdate}-12-31")
            if p.added_after:
                parsed["added"] = (p.added_after, p.added_before)
            found = search(**({k: v for k, v in parsed.items() if v is not None} | fields))
            if not p.prefer_semantic_search or self.text_index is None:
                return found
            words = nlquery.without_question(F.lit(query))
            subject = found.sparkSession.range(1).select(words.alias("s")).first()["s"]
            hits = self.text_index.search(" OR ".join(re.findall(r"[^\W_]+", subject)) or subject, fields.get("limit", 50))
            one = lambda df, *order: df.select(F.lit(1).alias("question"), "id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # noqa: E731  a page of rows
            chosen = fusion.first_or_else(one(hits, F.desc("score"), "id"), one(found, "title", "id"))
            return t["books"].join(chosen.select("id", "rank", "fallback"), "id").orderBy("rank")

        self._add(
            "query_books",
            search=search,
            ask=ask,
            list=lambda limit=50, offset=0: relations.page(relations.ordered(t["books"], "title"), limit, offset),
            recent=lambda limit=10: t["books"].orderBy(F.desc_nulls_last("timestamp"), "id").limit(limit),
            by_author=lambda author, **f: search(author=author, **f),
            by_series=lambda series, **f: search(series=series, sort_by="series_index", **f),
        )
        self._add("manage_books", get=lambda key: relations.by_key_or_uuid(t["books"], str(key)), details=lambda key: relations.by_key_or_uuid(relations.denormalise(t), str(key)))
        if "comments" in t:
            c = lambda: t["books"].select("id", "title").join(t["comments"].select(F.col("book").alias("id"), "text"), "id", "left")
            filled = F.coalesce(F.trim("text"), F.lit("")) != ""
            self._add(
                "manage_descriptions",
                list=lambda has_description=None, search=None: c().filter(F.lit(True) if has_description is None else filled if has_description else ~filled).filter(F.lit(True) if not search else relations.like(F.col("text"), search)).withColumn("preview", S.preview(F.col("text"))),
                get=lambda id: c().filter(F.col("id") == id),
                stats=lambda: stats.coverage(c(), filled, F.length("text")),
                by_letter=lambda letter: relations.by_letter(c().filter(filled), "title", letter),
            )
            self._add(
                "search_fulltext",
                search=lambda query, limit=20, offset=0, stemmed=False: X.bm25(t["comments"], "book", "text", query, limit, offset, stemmed),
                build_index=self._build_text_index,
                update_index=lambda changed, id="book", text="text": self._indexed().upsert(changed, id, text).texts().select("id", "n"),  # noqa: A002
                find=self._find,
            )
        self._add(
            "manage_times",
            added_in_range=lambda first=None, last=None, limit=50, offset=0: relations.page(t["books"].filter(relations.day_range(F.col("timestamp"), first, last)).orderBy(F.desc("timestamp"), "id"), limit, offset),
            published_in_range=lambda first=None, last=None, limit=50, offset=0: relations.page(t["books"].filter(relations.day_range(F.col("pubdate"), first, last)).orderBy(F.desc("pubdate"), "id"), limit, offset),
            recent_additions=lambda limit=10: t["books"].orderBy(F.desc_nulls_last("timestamp"), "id").limit(limit),
            stats_by_month_added=lambda year=None: stats.monthly(t["books"], "timestamp", year),
            stats_by_month_published=lambda year=None: stats.monthly(t["books"], "pubdate", year),
            date_stats=lambda: t["books"].agg(F.min("timestamp").alias("first_added"), F.max("timestamp").alias("last_added"), F.min("pubdate").alias("first_published"), F.max("pubdate").alias("last_published")),
        )
        self._add(
            "manage_smart_collections",
            create=lambda name, rules, match_all=True: self._named(self.collections.create(name, rules, match_all)),
            create_series=lambda series: self._named(self.collections.create_series(series)),
            update=lambda name, **changes: (self.collections.update(name, **changes), self._named(name))[1],
            delete=lambda name: (self.collections.delete(name), self._named(*self.collections.names()))[1],
            list=lambda: self._named(*self.collections.names()),
            query=lambda name, limit=50, offset=0: relations.page(self.collections.query(name, t["books"]).orderBy("id"), limit, offset),
        )

    def _indexed(self) -> TextIndex:
        if self.text_index is None:
            raise ValueError("build the index first: search_fulltext, build_index")
        return self.text_index

    def _build_text_index(self, path: str, stemmed: bool = False) -> DataFrame:
        """A persisted index over the descriptions; (id, n) of what it holds."""
        self.text_index = TextIndex(self.tables["books"].sparkSession, path).create(self.tables["comments"], "book", "text", stemmed)
        return self.text_index.texts().select("id", "n")

    def _find(self, query: str, limit: int = 20, offset: int = 0, enrich: bool = False) -> DataFrame:
        """Ranked hits of the index with snippets, places and the total; with ``enrich`` the books' records too."""
        hits = self._indexed().find(query, limit, offset)
        return hits.join(relations.denormalise(self.tables), "id", "left").orderBy("rank") if enrich else hits.orderBy("rank")

    def _named(self, *names: str) -> DataFrame:
        return self.tables["books"].sparkSession.createDataFrame([(n,) for n in names], "name string")

    # --- analysis --------------------------------------------------------------------

    def _in_series(self) -> DataFrame:
        s = self.tables["series"].select(F.col("id").alias("series"), F.col("name").alias("series_name"))
        return self.tables["books_series_link"].join(s, "series").join(self.tables["books"], F.col("book") == F.col("id")).select("id", "title", "series_name", "series_index")

    def _analysis(self) -> None:
        t = self.tables
        self._add(
            "analyze_library",
            tag_statistics=lambda: stats.usage_stats(self._used("tags")),
            duplicates=lambda: stats.exact_duplicates(t["books"], ["title", "author_sort"]),
            series=lambda: sequence.gaps(self._in_series(), "series_name", "series_index").join(sequence.reading_order(self._in_series(), "series_name", "series_index", "title").drop("n"), "series_name"),
            health=lambda: stats.missing_metadata(t["books"], {"author": t["books_authors_link"].select(F.col("book").alias("id")), "comment": t["comments"].select(F.col("book").alias("id"))}, ["pubdate"]),
            unread_priority=lambda limit=20: t["books"].join(self.ratings().groupBy(F.col("book").alias("id")).agg(F.max("rating").alias("rating")), "id").orderBy(F.desc("rating"), "id").limit(limit).select("id", "title", "rating"),
            reading_stats=lambda: self.ratings().agg(F.count(F.lit(1)).alias("rated"), F.round(F.avg("rating"), 2).alias("mean_rating")),
        )
        self._add(
            "manage_library_operations",
            analyze_series=lambda: sequence.gaps(self._in_series(), "series_name", "series_index", from_one=True),
            fix_series_metadata=lambda: sequence.renumber(self._in_series(), "series_name", "series_index"),
            merge_series=lambda source, target: sequence.merge_series(self._in_series(), "series_name", "series_index", source, target),
            list_books=lambda limit=50, offset=0: relations.page(relations.ordered(t["books"], "title"), limit, offset),
        )
        data = t.get("data")
        if data is not None:
            self._add("manage_libraries", stats=lambda: stats.histogram(data, F.upper("format"), "format"), info=lambda: stats.one_row({"b": t["books"].agg(F.count(F.lit(1)).alias("books")), "d": data.join(t["books"].select(F.col("id").alias("book")), "book", "left_semi").agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("bytes"))}))

    # --- changes ---------------------------------------------------------------------

    def _changes(self) -> None:
        t = self.tables

        def keep(table: str, df: DataFrame) -> DataFrame:
            t[table] = df
            return df

        def add(new: DataFrame, authors: DataFrame) -> DataFrame:
            """Books with their author links, unless a link names an author that does not exist."""
            missing = mutations.missing_references(authors, t["authors"], "author")
            if not missing.isEmpty():
                raise ValueError("authors do not exist")
            keep("books_authors_link", t["books_authors_link"].unionByName(authors))
            return keep("books", mutations.insert(t["books"], new))

        self._add("manage_books", add=add, update=lambda id, **values: keep("books", mutations.update(t["books"], id, values)), delete=lambda id: keep("books", mutations.delete(t["books"], [id])), set_authors=lambda links: keep("books_authors_link", mutations.replace_links(t["books_authors_link"], links)))
        for tool, table, keys, text in (("manage_user_comments", "user_comments", ["book_id", "library_path"], "comment_text"), ("manage_comments", "comments", ["book"], "text")):
            if table in t:
                self._add(
                    tool,
                    create=lambda new, table=table, keys=keys: keep(table, mutations.upsert(t[table], new, keys)),
                    update=lambda new, table=table, keys=keys: keep(table, mutations.upsert(t[table], new, keys)),
                    append=lambda new, table=table, keys=keys, text=text: keep(table, mutations.append_text(t[table], new, keys, text)),
                    read=lambda id, table=table, keys=keys: t[table].filter(F.col(keys[0]) == id),
                    delete=lambda id, table=table, keys=keys: keep(table, t[table].filter(F.col(keys[0]) != id)),
                )
        if "book_extended_metadata" in t:
            name = "book_extended_metadata"
            self._add("manage_extended_metadata", get=lambda id: t[name].filter(F.col("book_id") == id), upsert=lambda new: keep(name, mutations.upsert(t[name], new, ["book_id", "library_path"])), delete=lambda id: keep(name, t[name].filter(F.col("book_id") != id)))
        self._add("manage_metadata", update=lambda updates, fields: mutations.pivot_updates(updates, fields), show=lambda title: relations.denormalise(t).filter(relations.like(F.col("title"), title)).orderBy("id").limit(1))
        self._add("export_books", csv=lambda fields=None: exports.flat(relations.denormalise(t), fields), json=lambda level="standard": relations.at_detail(relations.denormalise(t), level), records=lambda: exports.export_records(relations.denormalise(t)))
