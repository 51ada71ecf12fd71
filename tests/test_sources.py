"""Sources over small files, and the remote source over an injected transport."""

import zipfile

from foliomill.sources import catalog, files, remote


def test_files(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(b"x")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.PDF").write_bytes(b"yy")
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.format, len(r.sha256)) for r in files.files(spark, str(tmp_path)).collect()}
    assert got == {"a.epub": (1, "EPUB", 64), "c.PDF": (2, "PDF", 64)}


def test_chapters(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("1.xhtml", "<p>One</p>")
        z.writestr("2.xhtml", "<p> </p>")
        z.writestr("3.xhtml", "<h1>Two</h1> words")
    got = [(r.location, r.text) for r in files.read_chapters(spark, str(tmp_path)).collect()]
    assert got == [("Chapter 1", "One"), ("Chapter 3", "Two words")]
    pages = files.read_pages(spark, str(tmp_path), lambda b: ["p1", " ", "p3"], "*.epub").collect()
    assert [(r.location, r.text) for r in pages] == [("Page 1", "p1"), ("Page 3", "p3")]


def test_feed_api_and_log(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><id>1</id><title>A\n  B</title><summary>s</summary><author><name>X</name></author><author><name>Y</name></author><link href="u" rel="alternate"/></entry></feed>')
    r = files.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert (r.id, r.title, r.authors, r.links) == ("1", "A B", ["X", "Y"], ["u"])
    (tmp_path / "a.json").write_text('{"results": [{"id": 5, "title": "T", "authors": [{"name": "N"}], "formats": {"b": "1", "a": "2"}}]}')
    assert files.read_api(spark, str(tmp_path / "a.json")).first().asDict() == {"id": 5, "title": "T", "authors": ["N"], "formats": ["a", "b"]}
    (tmp_path / "x.log").write_text("INFO a\nERROR disk\nERROR net\n")
    assert [r.value for r in files.read_log(spark, str(tmp_path / "x.log"), level="error", tail=1).collect()] == ["ERROR net"]


def test_discovery(spark, tmp_path):
    for n in ("one", "two"):
        spark.range(3).write.parquet(str(tmp_path / n / "metadata.parquet"))
    assert sorted(r.name for r in catalog.discover(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert catalog.find_table(spark, str(tmp_path)).endswith("one/metadata.parquet")
    assert catalog.find_table(spark, str(tmp_path / "two")).endswith("two/metadata.parquet")
    assert catalog.find_table(spark, str(tmp_path / "none")) is None
    assert files.table_info(spark.read.parquet(str(tmp_path / "one" / "metadata.parquet"))).first().rows == 3


def _fetch(path):
    if path.startswith("search"):
        return {"book_ids": [3, 1, 9]}
    return {"1": {"title": "A", "authors": ["X"], "formats": {"pdf": 1}}, "3": {"title": "C", "authors": []}}


def test_remote(spark):
    spark.dataSource.register(remote.source(_fetch, batch=2))
    got = [(r.id, r.title, r.formats) for r in spark.read.format("remote_catalog").option("query", "x").load().collect()]
    assert sorted(got) == [(1, "A", ["pdf"]), (3, "C", [])]
    assert remote.field_query("x", ["title", "tag"], "or") == "title:x OR tag:x"


def test_retries():
    calls = []

    def flaky(path):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("down")
        return {"ok": 1}

    assert remote.with_retries(flaky, wait=0)("p") == {"ok": 1} and len(calls) == 3
