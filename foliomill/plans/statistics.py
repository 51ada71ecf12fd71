"""Statistics: totals, histograms, facets, coverage, sessions, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import sequence as Q
from foliomill.operators import stats as T
from foliomill.plans.search import sql
from foliomill.registry import query
from foliomill.sources import catalog as C

SESSIONS = "s AS (SELECT event_id AS id, user_id AS \"user\", ts AS start, value AS minutes, event_type AS kind, CAST(json_extract(props, '$.k') AS INT) AS pages FROM events)"


@query(sql("""SELECT (SELECT count(*) FROM books) AS books, (SELECT count(DISTINCT author) FROM links) AS authors, (SELECT count(DISTINCT tag) FROM books) AS tags,
(SELECT count(DISTINCT series) FROM books) AS series, (SELECT max(o_orderdate) FROM orders) AS newest"""))
def library_totals(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d).agg(F.count(F.lit(1)).alias("books"), F.countDistinct("tag").alias("tags"), F.countDistinct("series").alias("series"))
    a = C.table(s, d, "lineitem").agg(F.countDistinct("l_suppkey").alias("authors"))
    o = C.table(s, d, "orders").agg(F.max("o_orderdate").alias("newest"))
    return T.one_row({"b": b, "a": a, "o": o})


_NINE = {"format": "l_returnflag", "language": "l_linestatus", "publisher": "p_brand", "series": "p_name", "rating": "l_linenumber", "year": "year(l_shipdate)", "day": "dayname(l_shipdate)", "tag": "p_type", "author": "s_name"}


_EACH = " UNION ALL ".join(f"SELECT '{k}' AS field, CAST({c} AS VARCHAR) AS value FROM j" for k, c in _NINE.items())


@query(f"WITH j AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT field, value, count(*) AS n FROM ({_EACH}) GROUP BY ALL")
def nine_histograms(s: SparkSession, d: str) -> DataFrame:
    """The nine fields of a library's statistics, counted in one pass over its lines."""
    lines = C.table(s, d, "lineitem").join(C.table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(C.table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    own = {"year": F.year("l_shipdate"), "day": F.date_format("l_shipdate", "EEEE")}
    return T.histograms(lines, {k: own[k] if k in own else F.col(c) for k, c in _NINE.items()})


@query("SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, key")
def format_histogram(s: SparkSession, d: str) -> DataFrame:
    return T.histogram(C.table(s, d, "orders"), F.col("o_orderpriority"))


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'Unknown') AS key, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def histogram_unknown(s: SparkSession, d: str) -> DataFrame:
    j = C.table(s, d, "documents").select("doc_id").join(C.table(s, d, "labels"), "doc_id", "left")
    return T.histogram(j, F.coalesce(F.col("quality").cast("string"), F.lit("Unknown")))


@query(sql("SELECT rating AS key, count(*) AS n FROM ratings WHERE rating BETWEEN 1 AND 5 GROUP BY 1"))
def rating_histogram(s: SparkSession, d: str) -> DataFrame:
    return T.histogram(C.ratings(s, d).filter("rating between 1 and 5"), F.col("rating"))


@query(sql("SELECT count(*) AS files, CAST(sum(size) AS DOUBLE) AS total, avg(size) AS mean, min(size) AS smallest, max(size) AS largest FROM books"))
def size_totals(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total"), F.avg("size").alias("mean"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


@query("SELECT source AS library, count(*) AS books, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS DOUBLE) AS size, max_by(doc_id, (n_chars, doc_id)) AS longest FROM documents GROUP BY source")
def per_library_stats(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").groupBy(F.col("source").alias("library")).agg(F.count(F.lit(1)).alias("books"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").cast("double").alias("size"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest"))


@query("SELECT count(DISTINCT source) AS libraries, (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 40)) AS large FROM documents")
def library_summary(s: SparkSession, d: str) -> DataFrame:
    n = C.table(s, d, "documents").groupBy("source").count()
    return n.agg(F.count(F.lit(1)).alias("libraries"), F.count_if(F.col("count") > 40).alias("large"))


@query(sql("SELECT upper(substr(title, 1, 1)) AS letter, count(*) AS n FROM books GROUP BY 1"))
def first_letter_histogram(s: SparkSession, d: str) -> DataFrame:
    return T.first_letters(C.books(s, d), "title")


@query(sql("SELECT a.name AS key, count(*) AS n FROM links JOIN authors a ON a.id = author GROUP BY 1 ORDER BY n DESC, key LIMIT 10"))
def top_authors(s: SparkSession, d: str) -> DataFrame:
    counted = C.book_authors(s, d).groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(C.authors(s, d).select(F.col("id").alias("author"), F.col("name").alias("key")), "author").select("key", "n").orderBy(F.desc("n"), "key").limit(10)


@query("SELECT count(*) AS single, CAST(sum(n) AS BIGINT) AS parts, (SELECT min(length(p_name)) FROM part) AS shortest, (SELECT max(length(p_name)) FROM part) AS longest, (SELECT round(avg(length(p_name)), 6) FROM part) AS mean FROM (SELECT p_name, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) = 1)")
def single_book_authors(s: SparkSession, d: str) -> DataFrame:
    """Groups of exactly one, and the lengths of all names."""
    p = C.table(s, d, "part")
    one = p.groupBy("p_name", "p_brand", "p_size").count().filter("count = 1").agg(F.count(F.lit(1)).alias("single"), F.sum("count").alias("parts"))
    n = F.length("p_name")
    return T.one_row({"a": one, "b": p.agg(F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"))})


def _tag_usage(s: SparkSession, d: str) -> DataFrame:
    """Users as tags of the events."""
    users = C.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return T.usage(users, C.table(s, d, "events"), "user_id")


_USAGE = "u AS (SELECT c_custkey AS id, c_name AS name, coalesce(n, 0) AS books FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey)"


@query(f"WITH {_USAGE} SELECT count(*) AS total, count(*) FILTER (books = 0) AS unused, count(*) FILTER (books > 0) AS used, round(avg(books), 6) AS mean_books FROM u")
def tag_statistics(s: SparkSession, d: str) -> DataFrame:
    return T.usage_stats(_tag_usage(s, d))


@query(f"WITH {_USAGE} SELECT id, name FROM u WHERE books = 0")
def unused_tags(s: SparkSession, d: str) -> DataFrame:
    return _tag_usage(s, d).filter("books = 0").select("id", "name")


@query(f"WITH {_USAGE} SELECT id, books FROM u WHERE books BETWEEN 1 AND 80 ORDER BY books DESC, id LIMIT 50")
def tags_by_count(s: SparkSession, d: str) -> DataFrame:
    return _tag_usage(s, d).filter("books between 1 and 80").select("id", "books").orderBy(F.desc("books"), "id").limit(50)


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def monthly_added(s: SparkSession, d: str) -> DataFrame:
    return T.monthly(C.table(s, d, "orders"), "o_orderdate")


@query("SELECT 1996 AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 2")
def monthly_added_in_year(s: SparkSession, d: str) -> DataFrame:
    return T.monthly(C.table(s, d, "orders"), "o_orderdate", 1996)


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(o_orderdate) AS dated FROM orders")
def date_stats(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("o_orderdate").alias("dated"))


@query("SELECT count(*) AS total, count(*) FILTER (length(text) >= 500) AS with_text, count(*) FILTER (length(text) < 500) AS without_text, round(100.0 * count(*) FILTER (length(text) >= 500) / count(*), 1) AS percent, CAST(floor(avg(length(text)) FILTER (length(text) >= 500)) AS BIGINT) AS mean_length FROM documents")
def coverage_percent(s: SparkSession, d: str) -> DataFrame:
    return T.coverage(C.table(s, d, "documents"), F.length("text") >= 500, F.length("text"))


@query("SELECT md5(text) AS key, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    keyed = C.table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return T.exact_duplicates(keyed, ["key"], "doc_id").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("""SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM (
SELECT 'publisher' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'tag', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'words', w, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 2)) WHERE rank <= 10""")
def facets_top10(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d).withColumn("words", F.split("title", " "))
    return T.facets(b, ["publisher", "tag"], ["words"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {SESSIONS}, v AS (SELECT *, CASE WHEN minutes > 0 THEN pages / minutes END AS sp FROM s) SELECT "user", count(*) AS n_sessions, round(sum(minutes), 2) AS total_minutes, CAST(sum(pages) AS BIGINT) AS total_pages, count(DISTINCT kind) AS n_kinds,
round(avg(minutes), 2) AS mean_minutes, round(avg(pages), 2) AS mean_pages, round(quantile_cont(sp, 0.5), 2) AS median_speed, round(min(sp), 2) AS min_speed, round(max(sp), 2) AS max_speed FROM v GROUP BY 1""")
def session_stats(s: SparkSession, d: str) -> DataFrame:
    return T.session_stats(C.sessions(s, d), ["user"])


@query("SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 3")
def favourite_hours(s: SparkSession, d: str) -> DataFrame:
    return T.favourite_hours(C.sessions(s, d))


@query("SELECT CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS part, dayname(ts) AS weekday, round(sum(value), 4) AS minutes FROM events GROUP BY 1, 2")
def daypart_minutes(s: SparkSession, d: str) -> DataFrame:
    e = C.sessions(s, d)
    return e.groupBy(S.day_part(F.col("start")).alias("part"), F.date_format("start", "EEEE").alias("weekday")).agg(F.round(F.sum("minutes"), 4).alias("minutes"))


@query(f"WITH {SESSIONS}, t AS (SELECT \"user\", CASE WHEN hour(start) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(start) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(start) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS part, sum(minutes) AS m FROM s GROUP BY 1, 2) SELECT \"user\", CASE WHEN max(m) > 0 THEN max_by(part, (m, part)) ELSE 'unknown' END AS favourite FROM t GROUP BY 1")
def favourite_daypart(s: SparkSession, d: str) -> DataFrame:
    t = C.sessions(s, d).groupBy("user", S.day_part(F.col("start")).alias("part")).agg(Q.added("minutes").alias("m"))
    return t.groupBy("user").agg(F.when(F.max("m") > 0, F.max_by("part", F.struct("m", "part"))).otherwise("unknown").alias("favourite"))


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS DOUBLE) AS total FROM events GROUP BY 1")
def pages_per_day(s: SparkSession, d: str) -> DataFrame:
    return T.daily(C.sessions(s, d), "start", "pages")


@query("SELECT CAST(g AS DATE) AS day, coalesce(t, 0.0) AS total FROM generate_series((SELECT CAST(max(ts) AS DATE) - 40 FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY) x(g) LEFT JOIN (SELECT CAST(ts AS DATE) AS dd, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS DOUBLE) AS t FROM events GROUP BY 1) ON dd = CAST(g AS DATE)")
def dense_calendar(s: SparkSession, d: str) -> DataFrame:
    return T.dense_days(C.sessions(s, d), "start", "pages", 40)


@query("SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM documents GROUP BY lang")
def group_concat_distinct(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").groupBy("lang").agg(F.concat_ws("|", F.array_sort(F.collect_set("source"))).alias("sources"))


@query("SELECT d.doc_id AS id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'label' END, CASE WHEN q.doc_id IS NULL THEN 'good' END) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) q ON q.doc_id = d.doc_id WHERE l.doc_id IS NULL OR q.doc_id IS NULL")
def books_without_metadata(s: SparkSession, d: str) -> DataFrame:
    """Texts without a label, or without a good one."""
    labels = C.table(s, d, "labels")
    parts = {"label": labels.select(F.col("doc_id").alias("id")), "good": labels.filter("quality = 1").select(F.col("doc_id").alias("id"))}
    out = T.missing_metadata(C.table(s, d, "documents").select(F.col("doc_id").alias("id")), parts, [])
    return out.select("id", F.array_join("missing", ",").alias("missing"))


@query("SELECT 'lang missing' AS \"check\", CAST(count(*) FILTER (lang IS NULL) AS DOUBLE) AS value, CASE WHEN count(*) FILTER (lang IS NULL) <= 0 THEN 'ok' ELSE 'warning' END AS status FROM documents UNION ALL SELECT 'very long', CAST(count(*) FILTER (n_chars > 20000) AS DOUBLE), CASE WHEN count(*) FILTER (n_chars > 20000) <= 2 THEN 'ok' ELSE 'warning' END FROM documents")
def library_health(s: SparkSession, d: str) -> DataFrame:
    return T.health({"lang missing": (F.count_if(F.col("lang").isNull()), 0), "very long": (F.count_if(F.col("n_chars") > 20000), 2)}, C.table(s, d, "documents"))


@query("WITH b AS (SELECT doc_id FROM documents), m AS (SELECT doc_id FROM b WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT (SELECT count(*) FROM b) AS books, (SELECT count(*) FROM m) AS missing, round(greatest(0, 100 - (SELECT count(*) FROM m) * 100.0 / (SELECT count(*) FROM b)), 2) AS score")
def health_score(s: SparkSession, d: str) -> DataFrame:
    b = C.table(s, d, "documents").select("doc_id")
    return T.health_score(b, b.join(C.table(s, d, "labels"), "doc_id", "left_anti"))


@query("SELECT l_suppkey AS user, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def graph_degrees(s: SparkSession, d: str) -> DataFrame:
    edges = C.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return T.degrees(edges).select("user", "n")


@query("SELECT event_id AS id, value AS rating FROM events WHERE user_id = 5 AND event_type <> 'error' ORDER BY value DESC, event_id LIMIT 10 OFFSET 5")
def item_reviews(s: SparkSession, d: str) -> DataFrame:
    e = C.sessions(s, d).filter("user = 5 and kind <> 'error'")
    return e.select("id", F.col("minutes").alias("rating")).orderBy(F.desc("rating"), "id").offset(5).limit(10)


@query("SELECT p_brand AS publisher, count(*) AS books FROM part GROUP BY 1 ORDER BY books DESC, publisher LIMIT 10")
def publisher_counts(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).groupBy("publisher").agg(F.count(F.lit(1)).alias("books")).orderBy(F.desc("books"), "publisher").limit(10)


@query("SELECT DISTINCT s.s_name AS author, p.p_brand AS series, count(DISTINCT p_partkey) AS books FROM lineitem JOIN part p ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey WHERE l_suppkey = 4 GROUP BY 1, 2")
def series_of_author(s: SparkSession, d: str) -> DataFrame:
    a = C.book_authors(s, d).filter("author = 4").join(C.authors(s, d).select(F.col("id").alias("author"), "name"), "author")
    return a.join(C.books(s, d), a["book"] == F.col("id")).groupBy(F.col("name").alias("author"), "series").agg(F.count(F.lit(1)).alias("books"))


# --- grouping sets and approximate aggregates, which Spark adds ---------------------------


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT p_type AS tag, p_brand AS brand, count(*) AS n FROM part GROUP BY CUBE (p_type, p_brand)")
def cube_parts(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "part").cube(F.col("p_type").alias("tag"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_orders(s: SparkSession, d: str) -> DataFrame:
    o = C.table(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.groupingSets([["status"], ["priority"], []], "status", "priority").agg(F.count(F.lit(1)).alias("n"))


@query()
def approximate_counts(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", [0.25, 0.5, 0.75]).alias("quartiles"))


@query("SELECT l_linestatus AS status, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def pivot_flags(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("status")).pivot("l_returnflag", ["A", "N", "R"]).count()


@query("""WITH h AS (SELECT l_quantity AS m, p_type AS tag, s_name AS author FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY),
e AS (SELECT 'total' AS kind, NULL AS value, m FROM h UNION ALL SELECT 'tag', tag, m FROM h UNION ALL SELECT 'author', author, m FROM h),
c AS (SELECT kind, value, count(*) AS n, CAST(sum(m) AS DOUBLE) AS minutes FROM e GROUP BY 1, 2) SELECT kind, value, n, minutes FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM c) WHERE r <= 10""")
def reading_habits(s: SparkSession, d: str) -> DataFrame:
    """Totals, tags and authors of the last year of lines, as sessions of their quantity in minutes."""
    lines = C.table(s, d, "lineitem").join(C.table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(C.table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    history = lines.select(F.col("l_shipdate").alias("start"), F.col("l_quantity").alias("minutes"), F.array("p_type").alias("tags"), F.array("s_name").alias("authors"))
    last = C.table(s, d, "lineitem").agg(F.max("l_shipdate").alias("now")).first()["now"]
    return T.reading_habits(history, "year", F.lit(last).cast("timestamp_ntz"))


_PARTS = "e AS (SELECT user_id AS \"user\", event_id AS id, ts AS start, value AS minutes, CAST(json_extract_string(props, '$.k') AS INT) AS pages, event_type AS book, CAST(json_extract_string(props, '$.k') AS INT) / 100.0 AS progress_end FROM events)"


@query(f"""WITH {_PARTS}, b AS (SELECT *, CASE WHEN progress_end >= 0.9 AND row_number() OVER (PARTITION BY "user", book, progress_end >= 0.9 ORDER BY start, id) = 1 THEN 1 ELSE 0 END AS done FROM e),
p AS (SELECT "user", start, id, 'sessions' AS metric, 1.0::DOUBLE AS amount FROM b UNION ALL SELECT "user", start, id, 'minutes', minutes FROM b UNION ALL SELECT "user", start, id, 'pages', pages FROM b UNION ALL SELECT "user", start, id, 'books', done FROM b),
r AS (SELECT *, sum(amount) OVER (PARTITION BY "user", metric ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS s FROM p), g AS (SELECT * FROM (VALUES ('sessions', 40.0::DOUBLE), ('pages', 2000.0), ('books', 4.0)) v(metric, target))
SELECT "user", metric, target, CAST(sum(amount) AS DOUBLE) AS total, round(least(100, sum(amount) * 100 / target), 2) AS progress, min(start) FILTER (s >= target) AS reached_at FROM r JOIN g USING (metric) GROUP BY 1, 2, 3""")
def goals_by_metric(s: SparkSession, d: str) -> DataFrame:
    """Goals of sessions, pages and finished books for every user; the type of an event stands for its book."""
    from foliomill.operators import sequence

    e = C.sessions(s, d).withColumn("book", F.col("kind")).withColumn("progress_end", F.col("pages") / 100)
    wanted = s.createDataFrame([("sessions", 40.0), ("pages", 2000.0), ("books", 4.0)], "metric string, target double")
    goals = e.select("user").distinct().join(F.broadcast(wanted))  # three rows
    return sequence.goals_by_metric(e, goals)
