"""Mutations as new relations, duplicates, exports, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import dedupe as D
from foliomill.operators import exports as X
from foliomill.operators import mutations as M
from foliomill.plans.search import sql
from foliomill.registry import query
from foliomill.session import shared_folder
from foliomill.sources import catalog as C
from foliomill.streaming import sessions as W


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 100, 'NEW'")
def insert_update_delete(s: SparkSession, d: str) -> DataFrame:
    n = C.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return M.insert(M.update(M.delete(n, [5]), 3, {"name": "RENAMED"}), s.createDataFrame([(100, "NEW")], "id int, name string"))


@query("SELECT 9001 AS id UNION ALL SELECT 9002")
def missing_references(s: SparkSession, d: str) -> DataFrame:
    wanted = s.createDataFrame([(3,), (9001,), (9002,)], "author long")
    return M.missing_references(wanted, C.authors(s, d), "author")


@query("SELECT s_suppkey AS id FROM supplier")
def restricted_delete(s: SparkSession, d: str) -> DataFrame:
    return M.restrict_delete(C.authors(s, d), C.book_authors(s, d), "author", 3).select("id")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 201, 'Brand New'")
def add_unique_names(s: SparkSession, d: str) -> DataFrame:
    n = C.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    new = s.createDataFrame([(200, "nation_3"), (201, " brand new"), (202, "BRAND NEW ")], "id int, name string")
    return M.add_unique(n, new, normalise=S.tag_name)


@query(sql("SELECT book, author FROM links WHERE book NOT IN (1, 2) UNION ALL SELECT 1, 50 UNION ALL SELECT 1, 51 UNION ALL SELECT 2, 50"))
def replace_links(s: SparkSession, d: str) -> DataFrame:
    new = s.createDataFrame([(1, 50), (1, 51), (2, 50)], "book long, author long")
    return M.replace_links(C.book_authors(s, d), new)


@query(sql("SELECT DISTINCT book, CASE WHEN author IN (3, 4) THEN 5 ELSE author END AS author FROM links"))
def merge_tags(s: SparkSession, d: str) -> DataFrame:
    return M.merge_keys(C.book_authors(s, d), "author", [3, 4], 5)


@query(sql("SELECT count(DISTINCT book) AS affected FROM links WHERE author IN (3, 4)"))
def merge_tags_affected(s: SparkSession, d: str) -> DataFrame:
    return M.affected(C.book_authors(s, d), "author", [3, 4])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def delete_unused(s: SparkSession, d: str) -> DataFrame:
    c = C.table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return M.drop_unused(c, C.table(s, d, "orders"), "o_custkey")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 2 THEN 'TWO' ELSE n_name END AS name, n_regionkey AS region FROM nation UNION ALL SELECT 77, 'SEVENTY', 1")
def upsert_merge(s: SparkSession, d: str) -> DataFrame:
    n = C.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return M.upsert(n, s.createDataFrame([(2, "TWO", None), (77, "SEVENTY", 1), (4, None, None)], "id int, name string, region int"), ["id"])


@query("SELECT n_nationkey AS id, n_name || CASE WHEN n_nationkey = 1 THEN chr(10) || 'more' ELSE '' END AS text FROM nation UNION ALL SELECT 88, 'new'")
def append_comments(s: SparkSession, d: str) -> DataFrame:
    n = C.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    return M.append_text(n, s.createDataFrame([(1, "more"), (88, "new")], "id int, text string"), ["id"], "text")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, least(100.0, max_by(value, (ts, event_id))) AS progress FROM events GROUP BY 1")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    out = M.latest(C.table(s, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id")
    return out.select("user_id", "event_id", M.clamp_percent(F.col("value")).alias("progress"))


@query("SELECT o_orderkey AS book, CAST(o_orderkey % 7 AS VARCHAR) AS rating, CASE WHEN o_orderkey % 2 = 0 THEN 'soon' END AS pubdate, concat_ws(',', CASE WHEN o_orderkey % 7 NOT BETWEEN 1 AND 5 THEN 'rating' END, CASE WHEN o_orderkey % 2 = 0 THEN 'pubdate' END) AS invalid FROM orders")
def pivot_updates(s: SparkSession, d: str) -> DataFrame:
    o = C.table(s, d, "orders").select(F.col("o_orderkey").alias("book"))
    r = o.select("book", F.lit("rating").alias("field"), (F.col("book") % 7).cast("string").alias("value"))
    p = o.filter("book % 2 = 0").select("book", F.lit("pubdate").alias("field"), F.lit("soon").alias("value"))
    return M.pivot_updates(r.unionByName(p), ["rating", "pubdate"]).withColumn("invalid", F.array_join("invalid", ","))


@query(sql("SELECT CAST(floor(id / 100) AS BIGINT) AS batch, CASE WHEN size < 1000 THEN 'success' ELSE 'failed' END AS status, count(*) AS n FROM books GROUP BY 1, 2"))
def batch_tally(s: SparkSession, d: str) -> DataFrame:
    b = M.batches(C.books(s, d), 100)
    return b.groupBy("batch", F.when(F.col("size") < 1000, "success").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT id FROM books WHERE tag <> 'PROMO'"))
def needs_conversion(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d).withColumn("formats", F.array("tag", F.lit("EPUB")))
    return M.needs_conversion(b, "promo").select("id")


@query("SELECT source AS path FROM (SELECT source, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS n FROM documents GROUP BY source) WHERE n > 5")
def rotate_backups(s: SparkSession, d: str) -> DataFrame:
    b = C.table(s, d, "documents").groupBy(F.col("source").alias("path")).agg(F.sum("n_chars").alias("modified"))
    return M.keep_newest(b, 5).select("path")


@query(sql("SELECT id, tag || '/' || CASE WHEN id % 3 = 0 THEN title || '.epub' ELSE series || '/' || lpad(CAST(CAST(series_index AS INT) AS VARCHAR), 3, '0') || ' - ' || title || '.epub' END AS path, regexp_matches(title, '^red .*t$') AS matched FROM books"))
def organised_paths(s: SparkSession, d: str) -> DataFrame:
    series = F.when(F.col("id") % 3 != 0, F.col("series"))
    return C.books(s, d).select("id", M.target_path(F.col("tag"), series, F.col("series_index"), F.col("title"), F.lit("epub")).alias("path"), M.glob_match(F.col("title"), "red *t").alias("matched"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 4 AND o_orderstatus IN ('O', 'P') THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def job_transition(s: SparkSession, d: str) -> DataFrame:
    j = C.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return M.transition(j, 4, ["O", "P"], "X")


@query("SELECT DISTINCT user_id AS src, CAST(length(event_type) AS INT) AS dst FROM events UNION SELECT 1, 99")
def follow_edges(s: SparkSession, d: str) -> DataFrame:
    e = C.table(s, d, "events").select(F.col("user_id").alias("src"), F.length("event_type").alias("dst"))
    return M.toggle(e, s.createDataFrame([(1, 99)], "src long, dst int"), add=True)


@query("SELECT lang, source, n_chars, round(n_chars * 100.0 / 50000, 1) AS done FROM documents")
def progress_percent(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").select("lang", "source", "n_chars", M.percent_done(F.col("n_chars"), F.lit(50000)).alias("done"))


# --- duplicates ---------------------------------------------------------------------------


@query()
def fuzzy_tag_groups(s: SparkSession, d: str) -> DataFrame:
    names = C.books(s, d).groupBy(F.col("title").alias("name")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("books"))
    return D.fuzzy_groups(names, least=0.8)


@query()
def similar_name_pairs(s: SparkSession, d: str) -> DataFrame:
    names = C.books(s, d).groupBy(F.col("title").alias("name")).agg(F.min("id").alias("id"))
    return D.similar_pairs(names, least=0.75)


@query(sql("SELECT a.id AS a, b.id AS b, round((0.5 * (1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title))) + 0.4 * (a.tag = b.tag)::INT) / 0.9, 6) AS similarity FROM books a JOIN books b ON a.series = b.series AND a.series_index = b.series_index AND a.id < b.id WHERE (0.5 * (1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title))) + 0.4 * (a.tag = b.tag)::INT) / 0.9 >= 0.6"))
def weighted_duplicate_pairs(s: SparkSession, d: str) -> DataFrame:
    block = F.concat_ws("|", "series", F.col("series_index").cast("string"))
    return D.weighted_duplicates(C.books(s, d), block, {"title": ("text", 0.5), "tag": ("exact", 0.4)}, 0.6).withColumn("similarity", F.round("similarity", 6))


@query()
def similar_tags(s: SparkSession, d: str) -> DataFrame:
    return D.similar_tags(C.books(s, d).select(F.col("title").alias("name")).distinct(), 0.8)


@query(sql("SELECT id, upper(substr(tag, 1, 1)) || lower(substr(tag, 2)) AS cleaned, true AS changed FROM books"))
def cleaned_tags(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d).select("id", F.array("tag", F.lower("tag"), F.lit(" "), F.lit("x")).alias("tags"))
    return D.clean_tags(b, "tags").select("id", F.array_join("cleaned", ",").alias("cleaned"), "changed")


# --- exports ------------------------------------------------------------------------------


def _records(s: SparkSession, d: str) -> DataFrame:
    from foliomill.operators.relations import gathered

    a = gathered(C.book_authors(s, d), C.authors(s, d), "author", "authors")
    r = C.ratings(s, d).select(F.col("book").alias("id"), "rating")
    return C.books(s, d).join(a, "id").join(r, "id", "left").withColumn("tags", F.array("tag", F.lower("tag")))


@query(sql("SELECT CAST(b.id AS VARCHAR) AS id, title, string_agg(name, ', ' ORDER BY a.id) AS authors, series, coalesce(CAST(any_value(rating) AS VARCHAR), '') AS rating, tag || ', ' || lower(tag) AS tags FROM books b JOIN links ON book = b.id JOIN authors a ON a.id = author LEFT JOIN ratings r ON r.book = b.id GROUP BY ALL"))
def csv_export(s: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read back."""
    path = f"{shared_folder(s)}/exports/{s.sparkContext.applicationId}/csv"
    X.write_csv(_records(s, d), path, ["id", "title", "authors", "series", "rating", "tags"])
    schema = "id string, title string, authors string, series string, rating string, tags string"
    return s.read.schema(schema).option("header", "true").option("escape", '"').csv(path).fillna("")


@query(sql("SELECT id, '<tr><td>' || title || '</td><td>' || names || '</td><td>' || tag || ', ' || lower(tag) || '</td><td>' || repeat('★', coalesce(rating, 0)) || '</td></tr>' AS html FROM books b JOIN (SELECT book, string_agg(name, ', ' ORDER BY a.id) AS names FROM links JOIN authors a ON a.id = author GROUP BY 1) n ON n.book = b.id LEFT JOIN ratings r ON r.book = b.id"))
def html_catalog(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).withColumn("authors", F.transform("authors", lambda a: a["name"]))
    return X.html_rows(r)


@query(sql("SELECT id, '## ' || title || chr(10) || '- **Tags:** ' || tag || CASE WHEN rating IS NULL THEN '' ELSE chr(10) || '- **Rating:** ' || rating END AS md FROM books b LEFT JOIN ratings r ON r.book = b.id"))
def markdown_catalog(s: SparkSession, d: str) -> DataFrame:
    r = C.ratings(s, d).select(F.col("book").alias("id"), "rating")
    b = C.books(s, d).join(r, "id", "left").withColumn("authors", F.array().cast("array<string>")).withColumn("tags", F.array("tag"))
    return X.markdown(b)


# --- streams ------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    out = W.tumbling(C.table(s, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY 1, 2")
def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    return W.tumbling(C.table(s, d, "events"), "12 hours", slide="6 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM i GROUP BY user_id, s")
def session_windows(s: SparkSession, d: str) -> DataFrame:
    out = W.sessions(C.table(s, d, "events"), "6 hours")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def streamed_totals(s: SparkSession, d: str) -> DataFrame:
    """The events read as a stream and aggregated to the end."""
    e = W.read_events(s, f"{d}/events.parque[t]")
    done = W.run_once(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), f"{shared_folder(s)}/totals-{uuid.uuid4().hex}", "complete")
    return done.select("event_type", "n", F.round("total", 4).alias("total"))
