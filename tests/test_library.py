"""Operations by name over the four-book library."""

from datetime import date

import pytest

from foliomill.library import Library
from tests.conftest import ids


@pytest.fixture
def lib(library):
    return Library(library)


def test_reading_operations(lib, spark):
    assert ids(lib.run("query_books", "search", author="doyle")) == [1, 2]
    assert ids(lib.run("query_books", "ask", query="books by conan doyle", now=date(2024, 5, 1))) == [1, 2]
    assert ids(lib.run("query_books", "ask", query="tagged as romance", now=date(2024, 5, 1))) == [3]
    assert [r.id for r in lib.run("query_books", "search", sort_by="rating", descending=True).collect()] == [1, 3, 2, 4]
    assert [r.id for r in lib.run("query_books", "by_series", series="sherlock").collect()] == [1, 2]
    assert lib.run("manage_books", "details", key="u3").first().authors[0].name == "Jane Austen"
    assert lib.run("manage_authors", "get", name="mark twain").first().books == 1
    assert ids(lib.run("manage_authors", "get_books", id=1)) == [1, 2] and ids(lib.run("manage_authors", "by_letter", letter="j")) == [2]
    s = lib.run("manage_tags", "stats", top=1).first()
    assert (s.total, s.mean_books, s.top[0].name, s.letters["C"]) == (5, 2.0, "classic", 1)
    assert lib.run("analyze_library", "reading_stats").first().mean_rating == 4.5
    assert [r.missing for r in lib.run("analyze_library", "series").collect()] == [[]]
    assert lib.run("analyze_library", "duplicates").count() == 0
    assert lib.run("manage_descriptions", "stats").first().percent == 100.0
    assert ids(lib.run("search_fulltext", "search", query="comment")) == [1, 2, 3, 4]
    assert lib.run("manage_libraries", "info").first().asDict() == {"books": 4, "bytes": 10992}
    assert lib.run("export_books", "csv", fields=["id", "authors"]).count() == 4
    assert lib.run("manage_metadata", "show", title="scarlet").first().id == 1
    lib.run("manage_smart_collections", "create", name="c", rules=[("title", "contains", "Four")])
    assert ids(lib.run("manage_smart_collections", "query", name="c")) == [2]
    with pytest.raises(KeyError):
        lib.run("manage_books", "burn")


def test_changes_are_seen_by_later_operations(lib, spark):
    assert lib.run("manage_tags", "merge", sources=[1], target=2).first().affected == 2
    assert ids(lib.run("manage_tags", "list")) == [2, 3, 4, 5]
    assert ids(lib.run("query_books", "search", tag="detective")) == [1, 2]
    new = spark.createDataFrame([(9, " gothic novel"), (10, "CLASSIC")], "id long, name string")
    lib.run("manage_tags", "create", new=new)
    assert {r.name for r in lib.run("manage_tags", "get_unused").collect()} == {"Gothic Novel"}
    lib.run("manage_tags", "delete_unused")
    assert 9 not in ids(lib.run("manage_tags", "list"))
    lib.run("manage_authors", "delete", id=1)
    assert 1 in ids(lib.run("manage_authors", "list"))
    lib.run("manage_books", "delete", id=4)
    lib.run("manage_authors", "update", id=2, name="J. Austen")
    assert ids(lib.run("query_books", "search", author="j. austen")) == [3]
    with pytest.raises(ValueError):
        lib.run("manage_books", "add", new=lib.tables["books"].limit(0), authors=spark.createDataFrame([(5, 77)], "book long, author long"))
    lib.run("manage_comments", "append", new=spark.createDataFrame([(1, "more")], "book long, text string"))
    assert lib.run("manage_comments", "read", id=1).first().text.endswith("\nmore")
