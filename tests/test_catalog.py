"""Hand-computed answers on the four-book library, and properties of paging and filters."""

import pytest
from pyspark.sql import functions as F

from foliomill.operators import exports, predicates, relations, stats
from foliomill.operators.relations import BookFilters, Linked, apply_filters
from foliomill.sources import catalog
from tests.conftest import ids


@pytest.fixture(scope="module")
def search(library):
    linked = {"authors": Linked(library["books_authors_link"], library["authors"], "author"), "tags": Linked(library["books_tags_link"], library["tags"], "tag"), "series": Linked(library["books_series_link"], library["series"], "series")}
    r = library["books_ratings_link"].select("book", "rating")

    def run(**f):
        return apply_filters(library["books"], BookFilters(**f), linked, comments=library["comments"], ratings=r, data=library["data"])

    return run


@pytest.mark.parametrize(("filters", "expected"), [
    ({"author": "conan doyle"}, [1, 2]), ({"author": "doyle austen"}, []), ({"authors": ["Doyle", "Twain"]}, [1, 2, 4]), ({"exclude_authors": ["doyle"]}, [3, 4]), ({"tag": "CLASSIC"}, [1, 2, 3, 4]),
    ({"tags": ["romance", "adventure"]}, [3, 4]), ({"exclude_tags": ["mystery", "romance"]}, [4]), ({"series": "holmes"}, [1, 2]), ({"exclude_series": ["holmes"]}, [3, 4]), ({"min_rating": 5}, [1, 3]), ({"rating": 4}, [2, 4]),
    ({"unrated": True}, []), ({"formats": ["pdf", "cbz"]}, [1, 4]), ({"min_size": 2500}, [1, 4]), ({"has_cover": True}, [2]), ({"search": "austen"}, [3]), ({"title": "%s%r"}, [1, 2, 4]), ({"comment": "comment"}, [1, 2, 3, 4]),
    ({"has_empty_comments": True}, []), ({"author_id": 3}, [4]), ({"tag_id": 4}, [3]), ({"title": "the", "exclude_authors": ["twain"]}, [2]),
])
def test_filters(search, filters, expected):
    assert ids(search(**filters)) == expected


def test_filter_bounds():
    for bad in ({"rating": 6}, {"min_rating": 4, "max_rating": 2}, {"limit": 0}, {"offset": -1}, {"min_size": -1}):
        with pytest.raises(ValueError):
            BookFilters(**bad).check()


def test_include_and_exclude_partition_the_books(search, library):
    assert sorted(ids(search(tags=["mystery"])) + ids(search(exclude_tags=["mystery"]))) == ids(library["books"])


def test_pages_concatenate_to_the_whole(library):
    b = relations.ordered(library["books"], "title")
    whole = [r.id for r in b.collect()]
    assert [r.id for k in range(3) for r in relations.page(b, 2, 2 * k).collect()] == whole
    assert relations.page_info(library["books"], 3, 3).first().asDict() == {"total": 4, "page": 2, "page_size": 3, "total_pages": 2}


def test_denormalise_keeps_one_row_per_book(library):
    rows = {r.id: r for r in relations.denormalise(library).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert [t.name for t in rows[1].tags] == ["mystery", "detective", "classic"]
    assert rows[3].series is None and rows[1].series.name == "Sherlock Holmes" and rows[2].rating == 4
    assert [f.format for f in rows[4].formats] == ["CBZ", "EPUB"]


def test_statistics(library):
    used = stats.usage(library["tags"], library["books_tags_link"], "tag")
    assert stats.usage_stats(used).first().asDict() == {"total": 5, "unused": 0, "used": 5, "mean_books": 2.0}
    assert [(r.key, r.n) for r in stats.histogram(library["data"], F.col("format")).collect()] == [("EPUB", 4), ("CBZ", 1), ("PDF", 1)]


def test_constraints(library):
    assert {r.violations for r in catalog.violations(library).collect()} == {0}
    twice = library | {"tags": library["tags"].union(library["tags"].limit(1))}
    assert [r.check for r in catalog.violations(twice).collect() if r.violations] == ["unique tags(name)"]


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1, None, None, ["a", "B"]), (2, "x", 3, None), (3, "", 0, [])], "id int, s string, n int, l array<string>")
    hit = lambda p: ids(df.filter(p))
    s, r, c = predicates.search, predicates.rule, predicates.condition
    assert hit(s(df, "n", "!=", 3)) == [1, 3] and hit(s(df, "s", "not_contains", "x")) == [1, 3] and hit(s(df, "l", "contains", "b")) == [1]
    assert hit(s(df, "s", "exists")) == [2] and hit(s(df, "s", ">", 5)) == [] and hit(s(df, "nope", "not_exists")) == [1, 2, 3] and hit(s(df, "n", "in", [0, 3])) == [2]
    assert hit(r(df, "l", "contains", "b")) == [] and hit(r(df, "l", "contains", "B")) == [1] and hit(r(df, "n", "not_in", [3])) == [1, 3]
    assert hit(c(df, "n", "greater_than", 1)) == [2] and hit(c(df, "s", "is_not_set")) == [1, 3] and hit(c(df, "n.x", "equals", None)) == [1, 2, 3]
    assert hit(predicates.matches_rules(df, [])) == [1, 2, 3]


def test_collections_registry(spark):
    df = spark.createDataFrame([(1, "unread"), (2, "read")], "id int, read_status string")
    c = predicates.Collections()
    name = c.create_unread()
    assert ids(c.query(name, df)) == [1] and c.names() == ["Unread"]
    with pytest.raises(ValueError):
        c.create_unread()
    c.update(name, rules=[("read_status", "==", "read")])
    assert ids(c.query(name, df)) == [2] and c.delete(name) and not c.delete(name)


def test_exports(library, tmp_path, spark):
    records = relations.denormalise(library)
    row = {r.id: r for r in exports.export_records(records).collect()}[1]
    assert row.formats == ["EPUB", "PDF"] and row.comments == "Comment & 1"
    exports.write_csv(records, str(tmp_path / "c"), ["id", "title", "authors", "series", "rating"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "c"))
    assert {r.id: r.authors for r in back.collect()}["3"] == "Jane Austen"
    assert exports.write_library(records.select("id", "title"), str(tmp_path / "lib")).first().records == 4
    exports.write_json(records, str(tmp_path / "j"), "minimal")
    assert spark.read.json(str(tmp_path / "j")).columns == ["authors", "id", "title"]
