import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from foliomill.session import build_session

    s = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def library(spark):
    """Four books with links, as the smallest whole catalog."""
    from foliomill.sources.catalog import SCHEMAS, evolve

    def make(name, columns, rows):
        kinds = {f.name: f.dataType for f in SCHEMAS[name].fields}
        ddl = ", ".join(f"{c} {kinds[c].simpleString()}" for c in columns)
        return evolve(spark.createDataFrame(rows, ddl), SCHEMAS[name])

    return {
        "books": make("books", ["id", "title", "sort", "series_index", "author_sort", "path", "uuid", "has_cover"], [(1, "A Study in Scarlet", "Study in Scarlet, A", 1.0, "Doyle", "p1", "u1", 0), (2, "The Sign of the Four", "Sign of the Four, The", 2.0, "Doyle", "p2", "u2", 1), (3, "Pride and Prejudice", "Pride and Prejudice", 1.0, "Austen", "p3", "u3", 0), (4, "The Adventures of Tom Sawyer", "Adventures of Tom Sawyer, The", 1.0, "Twain", "p4", "u4", 0)]),
        "authors": make("authors", ["id", "name", "sort"], [(1, "Arthur Conan Doyle", "Doyle, Arthur Conan"), (2, "Jane Austen", "Austen, Jane"), (3, "Mark Twain", "Twain, Mark")]),
        "tags": make("tags", ["id", "name"], [(1, "mystery"), (2, "detective"), (3, "classic"), (4, "romance"), (5, "adventure")]),
        "series": make("series", ["id", "name"], [(1, "Sherlock Holmes")]),
        "ratings": make("ratings", ["id", "rating"], [(i, i) for i in range(1, 6)]),
        "comments": make("comments", ["id", "book", "text"], [(i, i, f"<p>Comment &amp; {i}</p>") for i in range(1, 5)]),
        "data": make("data", ["id", "book", "format", "uncompressed_size", "name"], [(1, 1, "EPUB", 2456, "a"), (2, 1, "PDF", 656, "a"), (3, 2, "EPUB", 2456, "b"), (4, 3, "EPUB", 2456, "c"), (5, 4, "EPUB", 2456, "d"), (6, 4, "CBZ", 512, "d")]),
        "books_authors_link": make("books_authors_link", ["book", "author"], [(1, 1), (2, 1), (3, 2), (4, 3)]),
        "books_tags_link": make("books_tags_link", ["book", "tag"], [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3), (3, 4), (4, 3), (4, 5)]),
        "books_series_link": make("books_series_link", ["book", "series"], [(1, 1), (2, 1)]),
        "books_ratings_link": make("books_ratings_link", ["book", "rating"], [(1, 5), (2, 4), (3, 5), (4, 4)]),
    }


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())
