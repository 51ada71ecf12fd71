"""The remote source with filters handed down, the export that commits once, and three-way synchronisation."""

import hashlib
import json
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from foliomill.operators import relations, sync
from foliomill.sources import librarywriter, remote

BOOKS = {i: {"title": f"Book {i}" if i % 3 else "The Sea", "authors": [f"Author {i % 7}", "Other"][: 1 + i % 2], "formats": {"EPUB": 1}} for i in range(1, 2501)}


def server(log):
    """A transport over ``BOOKS`` that writes down its requests, one file a task."""

    def fetch(path):
        with open(log, "a") as f:
            f.write(unquote(path) + "\n")
        if path.startswith("books?ids="):
            return {i: BOOKS[int(i)] for i in path[10:].split(",") if int(i) in BOOKS}
        args = dict(x.split("=", 1) for x in unquote(path)[7:].split("&"))
        hits = sorted(BOOKS)
        for field, exact, text in re.findall(r'(title|authors):"(=?)([^"]*)"', args["query"]):
            value = lambda i, field=field: BOOKS[i]["title"] if field == "title" else " & ".join(BOOKS[i]["authors"])
            hits = [i for i in hits if (value(i).lower() == text.lower() if exact else text.lower() in value(i).lower())]
        if above := re.search(r"id:>(-?\d+)", args["query"]):
            hits = [i for i in hits if i > int(above[1])]
        return {"total_num": len(hits), "book_ids": hits[int(args["offset"]) : int(args["offset"]) + int(args["num"])]}

    return fetch


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.dataSource.register(remote.source(server(path), batch=200))
    return path


def requests(log):
    with open(log) as f:
        return f.read().splitlines()


def test_no_record_is_lost_beyond_a_page(spark, log):
    assert sorted(r.id for r in remote.load(spark, page="300").collect()) == sorted(BOOKS)
    assert sum(x.startswith("search") for x in requests(log)) == 9 and not any("num=2500" in x for x in requests(log))


def test_filters_are_in_the_request(spark, log):
    got = remote.load(spark).filter((F.col("title") == "The Sea") & F.col("author").contains("Author 3") & (F.size("authors") == 1)).collect()
    want = [i for i, b in BOOKS.items() if b["title"] == "The Sea" and "Author 3" in " & ".join(b["authors"]) and len(b["authors"]) == 1]
    assert sorted(r.id for r in got) == want
    assert any('title:"=The Sea"' in x and 'authors:"Author 3"' in x for x in requests(log))


def test_ids_need_no_search(spark, log):
    assert sorted(r.id for r in remote.load(spark).filter("id in (5, 9, 99999) and id <> 9").collect()) == [5]
    assert not any(x.startswith("search") for x in requests(log))


def test_what_cannot_be_handed_down_stays(spark, log):
    # the remote search ignores case, Spark does not
    assert remote.load(spark).filter(F.col("title") == "the sea").count() == 0
    assert remote.load(spark).filter(F.col("title").contains("Book") & (F.col("id") > 2490)).count() == sum(1 for i in range(2491, 2501) if i % 3)
    assert remote.pushed_terms([GreaterThan(("id",), 3), StringContains(("formats",), "x")]) == []
    assert remote.pushed_ids([In(("id",), (1, 2, None)), EqualTo(("id",), 2)]) == [2] and remote.pushed_ids([EqualTo(("title",), "x")]) is None


def test_listing_with_author_title_and_limit(spark, log):
    got = remote.list_books(spark, author="author 3", title="book", limit=10).collect()
    want = [i for i, b in BOOKS.items() if "Author 3" in b["authors"] and b["title"].startswith("Book")][:10]
    assert sorted(r.id for r in got) == want
    assert any('authors:"author 3" and title:"book"' in x and "num=10" in x for x in requests(log))


def test_stream_goes_on_above_what_it_read(spark, log, tmp_path):
    stream = spark.readStream.format("remote_catalog").option("page", "1000").load()

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    run()
    first = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert first and first == sorted(set(first)) and set(first) <= set(BOOKS)
    while len(first) < len(BOOKS):
        before = len(first)
        run()
        first = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert first == sorted(set(first)) and len(first) > before
    assert first == sorted(BOOKS)


# --- export -------------------------------------------------------------------------------


def test_export_is_whole(spark, library, tmp_path):
    path = str(tmp_path / "e")
    books = library["books"].select("id", "title", "series_index")
    librarywriter.export(books.repartition(3), path, library="mine")
    manifest = librarywriter.read_manifest(path)
    assert (manifest["total_books"], manifest["first_id"], manifest["last_id"], manifest["library"]) == (4, 1, 4, "mine")
    for f in manifest["files"]:
        with open(f"{path}/records/{f['name']}", "rb") as g:
            body = g.read()
        assert hashlib.sha256(body).hexdigest() == f["sha256"] and body.count(b"\n") == f["records"]
    assert sorted(map(tuple, librarywriter.read_export(spark, path, "id long, title string, series_index double").collect())) == sorted(map(tuple, books.collect()))
    assert sorted(p.name for p in (tmp_path / "e").iterdir()) == ["manifest.json", "records"]
    with pytest.raises(Exception, match="holds an export"):
        librarywriter.export(books, path)
    assert librarywriter.read_manifest(path) == manifest
    librarywriter.export(books, path, ids=spark.createDataFrame([(2,), (2,), (9,)], "id long"), overwrite=True)
    assert [r.id for r in librarywriter.read_export(spark, path, "id long").collect()] == [2]
    librarywriter.export(books.limit(0), str(tmp_path / "none"))
    assert librarywriter.read_manifest(str(tmp_path / "none"))["total_books"] == 0 and librarywriter.read_export(spark, str(tmp_path / "none"), "id long").collect() == []


def test_a_task_that_is_tried_again_gives_each_record_once(spark, tmp_path):
    path = str(tmp_path / "e")
    schema = spark.createDataFrame([(1, "a")], "id long, title string").schema
    writer = librarywriter.LibraryWriter({"path": path}, schema, False)

    def lost():
        yield Row(id=1, title="a")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(lost())
    twice = [writer.write(iter([Row(id=1, title="a"), Row(id=2, title="b")])) for _ in range(2)]
    writer.commit([twice[1], None, writer.write(iter([Row(id=3, title=None)]))])
    lines = [json.loads(x) for f in librarywriter.read_manifest(path)["files"] for x in open(f"{path}/records/{f['name']}")]
    assert sorted(x["id"] for x in lines) == [1, 2, 3] and sorted(p.name for p in (tmp_path / "e").iterdir()) == ["manifest.json", "records"]


def test_an_export_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "e")
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("title"))
    with pytest.raises(Exception, match="broken"):
        librarywriter.export(bad, path)
    assert list((tmp_path / "e").iterdir()) == []
    with pytest.raises(FileNotFoundError):
        librarywriter.read_manifest(path)


# --- synchronisation ----------------------------------------------------------------------

COLUMNS = "id long, title string, tags array<string>, n int"


def test_three_sides(spark):
    make = lambda rows: spark.createDataFrame(rows, COLUMNS)
    base = make([(1, "a", ["x"], 1), (2, "b", ["x"], 2), (3, "c", None, 3), (4, "d", [], 4), (5, "e", ["y"], 5), (6, None, ["z"], 6)])
    local = make([(1, "A", ["x", "l"], 1), (2, "b", ["x"], 9), (4, "d", [], 4), (6, "f", ["z"], None), (7, "new", ["l"], 7), (8, "same", [], 8)])
    remote_ = make([(1, "AA", ["x", "r"], 1), (2, "B", ["x"], 2), (3, "C", None, 3), (5, "e", ["y"], 5), (6, "f", ["z"], 0), (7, "new", ["r"], 70), (8, "same", [], 8)])
    run = lambda policy: sorted((tuple(r) for r in sync.merged(base, local, remote_, ["id"], ["title", "tags", "n"], policy).collect()), key=str)
    same = [(2, "B", ["x"], 9, False), (8, "same", [], 8, False)]
    assert run("keep_local") == sorted([(1, "A", ["x", "l"], 1, False), (6, "f", ["z"], None, False), (7, "new", ["l"], 7, False), *same], key=str)
    assert run("keep_remote") == sorted([(1, "AA", ["x", "r"], 1, False), (3, "C", None, 3, False), (6, "f", ["z"], 0, False), (7, "new", ["r"], 70, False), *same], key=str)
    assert run("keep_both") == sorted([(1, "A", ["x", "l"], 1, False), (1, "AA", ["x", "r"], 1, True), (3, "C", None, 3, False), (6, "f", ["z"], None, False), (6, "f", ["z"], 0, True), (7, "new", ["l"], 7, False), (7, "new", ["r"], 70, True), *same], key=str)
    assert run("merge") == sorted([(1, "A\nAA", ["x", "l", "r"], 1, False), (3, "C", None, 3, False), (6, "f", ["z"], 0, False), (7, "new", ["l", "r"], 70, False), *same], key=str)
    found = sorted((r.id, r.field, r.local, r.remote) for r in sync.conflicts(base, local, remote_, ["id"], ["title", "tags", "n"]).collect() if r.field in ("title", "*"))
    assert found == [(1, "title", "A", "AA"), (3, "*", "deleted", "changed")]
    assert {(r.id, r.change) for r in sync.changes(base, local, ["id"], ["title", "tags", "n"]).collect()} == {(1, "modified"), (2, "modified"), (3, "deleted"), (5, "deleted"), (6, "modified"), (7, "added"), (8, "added")}
    with pytest.raises(ValueError):
        sync.merged(base, local, remote_, ["id"], ["title"], "guess")
    none = base.limit(0)
    assert sync.merged(none, none, none, ["id"], ["title"]).collect() == [] and sync.conflicts(none, none, none, ["id"], ["title"]).collect() == []


def test_unrated_and_unused_are_found(spark, library):
    books, ratings = library["books"], spark.createDataFrame([(1, 5), (3, 2)], "book long, rating int")
    assert sorted(r.id for r in relations.apply_filters(books, relations.BookFilters(unrated=True), {}, ratings=ratings).collect()) == [2, 4]
    from foliomill.operators import mutations, stats

    tags = library["tags"].unionByName(library["tags"].limit(1).withColumn("id", F.lit(99).cast(library["tags"].schema["id"].dataType)).withColumn("name", F.lit("unused")))
    assert [r.id for r in stats.usage(tags.select("id", "name"), library["books_tags_link"], "tag").filter("books = 0").collect()] == [99]
    assert sorted(r.id for r in mutations.drop_unused(tags, library["books_tags_link"], "tag").collect()) == [1, 2, 3, 4, 5]
