"""Scalar cleaners over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.plans.search import sql
from foliomill.registry import query
from foliomill.sources import catalog as C
from foliomill.sources import files


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages""")
def html_strip(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "pages").select("page_id", F.md5(S.strip_html(F.col("html")).cast("binary")).alias("text"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS text FROM pages""")
def html_escape(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "pages").select("page_id", F.md5(S.escape_html(F.col("html")).cast("binary")).alias("text"))


@query(r"SELECT page_id, rtrim(substr(trim(regexp_replace(regexp_replace(url, '[<>:\"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), 1, 30)) AS name, regexp_replace(trim(regexp_replace(url, '[^A-Za-z0-9_. -]', '_', 'g'), '. '), '[ _]+', '_', 'g') AS safe FROM pages")
def file_names(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "pages").select("page_id", S.file_name(F.col("url"), 30).alias("name"), S.safe_file_name(F.col("url")).alias("safe"))


@query(sql("""SELECT id, upper(substr(w1, 1, 1)) || lower(substr(w1, 2)) || ' of ' || upper(substr(w2, 1, 1)) || lower(substr(w2, 2)) || ' the ' || upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS title
FROM (SELECT id, string_split(title, ' ')[1] AS w1, string_split(title, ' ')[2] AS w2, tag AS t FROM books)"""))
def title_case(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws(" ", F.split_part("title", F.lit(" "), F.lit(1)), F.lit("OF"), F.split_part("title", F.lit(" "), F.lit(2)), F.lit("The"), F.col("tag"))
    return C.books(s, d).select("id", S.title_case(raw).alias("title"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[^A-Za-z0-9\-'' \t\n\f\r\x0B]', '', 'g'), ' ')) AS text FROM documents")
def remove_special_chars(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").select("doc_id", F.md5(S.plain(F.col("text")).cast("binary")).alias("text"))


@query(sql("SELECT id, upper(substr(tag, 1, 1)) || lower(substr(tag, 2)) || '-Of''S' AS name, upper(substr(tag, 1, 1)) || lower(substr(tag, 2)) || '-of''s' AS words FROM books"))
def tag_normalise(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("tag"), F.lit("-oF'S "))
    return C.books(s, d).select("id", S.tag_name(raw).alias("name"), S.tag_words(raw).alias("words"))


@query(sql("SELECT id, string_split(title, ' ')[2] || ' ' || string_split(title, ' ')[1] AS author FROM books"))
def author_invert(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).select("id", S.invert_author(F.regexp_replace("title", " ", ", ")).alias("author"))


_ISBN10 = "lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"
_W10 = "list_sum(list_transform(generate_series(1, 9), lambda i: (11 - i) * CAST(substr(b, CAST(i AS INT), 1) AS INT)))"
_W13 = "list_sum(list_transform(generate_series(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END * CAST(substr('978' || b, CAST(i AS INT), 1) AS INT)))"


@query(f"WITH x AS (SELECT p_partkey AS id, {_ISBN10} AS b FROM part), c AS (SELECT id, b, (11 - {_W10} % 11) % 11 AS k, (10 - {_W13} % 10) % 10 AS k13 FROM x) SELECT id, b || CASE WHEN k = 10 THEN 'X' ELSE CAST(CAST(k AS INT) AS VARCHAR) END AS isbn10, '978' || b || CAST(CAST(k13 AS INT) AS VARCHAR) AS isbn13, true AS ok10, true AS ok13, false AS ok_bad FROM c")
def isbn_convert_and_check(s: SparkSession, d: str) -> DataFrame:
    body = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    check = (11 - S._weighted(F.col("b"), lambda i: 10 - i) % 11) % 11
    ten = C.table(s, d, "part").select(F.col("p_partkey").alias("id"), body.alias("b")).withColumn("isbn10", F.concat("b", F.when(check == 10, "X").otherwise(check.cast("string"))))
    both = ten.withColumn("isbn13", S.isbn10_to_13(F.col("isbn10")))
    return both.select("id", "isbn10", "isbn13", S.valid_isbn(F.col("isbn10")).alias("ok10"), S.valid_isbn(F.col("isbn13")).alias("ok13"), S.valid_isbn(F.concat("isbn13", F.lit("1"))).alias("ok_bad"))


@query(sql("SELECT id, title || '::' || lower(tag) || '|' || lower(publisher) AS key FROM (SELECT *, CASE WHEN lower(publisher) < lower(tag) THEN tag ELSE publisher END AS x FROM books) WHERE lower(tag) <= lower(publisher) UNION ALL SELECT id, title || '::' || lower(publisher) || '|' || lower(tag) FROM books WHERE lower(publisher) < lower(tag)"))
def duplicate_key(s: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.upper("title"), F.lit(" (2nd ed.)  [x]"))
    return C.books(s, d).select("id", S.duplicate_key(title, F.array("publisher", "tag")).alias("key"))


@query(sql("SELECT id, CASE WHEN v < 1024 THEN printf('%.2f B', v) WHEN v < 1048576 THEN printf('%.2f KB', v / 1024) WHEN v < 1073741824 THEN printf('%.2f MB', v / 1048576) ELSE printf('%.2f GB', v / 1073741824) END AS size FROM (SELECT id, size * (id % 7) * (id % 11) * (id % 13) * 1000 AS v FROM books)"))
def human_size(s: SparkSession, d: str) -> DataFrame:
    v = F.col("size") * (F.col("id") % 7) * (F.col("id") % 11) * (F.col("id") % 13) * 1000
    return C.books(s, d).select("id", S.human_size(v).alias("size"))


@query("SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) END AS DATE) AS day FROM orders")
def parse_partial_dates(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy")).otherwise("44 BC")
    return C.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), S.parse_date(text).alias("day"))


_TIME = {"last month": ("date_trunc('month', d) - INTERVAL 1 MONTH", "date_trunc('month', d) - INTERVAL 1 DAY"), "last week": ("d - INTERVAL 7 DAY", "d"), "last year": ("date_trunc('year', d) - INTERVAL 1 YEAR", "date_trunc('year', d) - INTERVAL 1 DAY"), "this month": ("date_trunc('month', d)", "d"), "this week": ("date_trunc('week', d)", "d"), "this year": ("date_trunc('year', d)", "d")}


@query("WITH x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders) " + " UNION ALL ".join(f"SELECT id, '{k}' AS period, CAST({a} AS DATE) AS first, CAST({b} AS DATE) AS last FROM x" for k, (a, b) in _TIME.items()))
def relative_periods(s: SparkSession, d: str) -> DataFrame:
    x = C.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.explode(F.array(*[F.lit(k) for k in _TIME])).alias("period"))
    first, last = S.time_range(F.col("period"), F.col("d"))
    return x.select("id", "period", first.alias("first"), last.alias("last"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, nullif(trim(substr(text, 1, 1)), '') AS first FROM documents")
def previews(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"), S.blank_to_null(F.substring("text", 1, 1)).alias("first"))


@query(sql("SELECT id, rpad(title, 12, ' ') || ' | ' || rpad(CASE WHEN length(tag) > 6 THEN substr(tag, 1, 3) || '...' ELSE tag END, 6, ' ') AS line FROM books"))
def text_table(s: SparkSession, d: str) -> DataFrame:
    from foliomill.operators.exports import text_table as table_lines

    return table_lines(C.books(s, d), {"title": 12, "tag": 6})


@query(sql("SELECT id, 'p/' || tag || '/' || title || CASE WHEN id % 2 = 0 THEN '' ELSE '.epub' END || CASE WHEN id % 2 = 0 THEN '.epub' ELSE '' END AS path FROM books"))
def format_paths(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit(".epub")))
    return C.books(s, d).select("id", S.format_path(F.concat(F.lit("p/"), "tag"), name, F.lit("EPUB")).alias("path"))


@query(sql("SELECT id, CASE id % 4 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'PDF' WHEN 2 THEN 'CBZ' ELSE 'UNKNOWN' END AS format FROM books"))
def file_types(s: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit(".Epub"), F.lit(".pdf"), F.lit(".tar.cbz"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    return C.books(s, d).select("id", files.format_of(F.concat(F.lit("a/b"), ext)).alias("format"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, substr(sha256(source || '|' || lang), 1, 16) AS stable FROM documents")
def content_hashes(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text").cast("binary")
    return C.table(s, d, "documents").select("doc_id", files.content_hash(t).alias("sha256"), files.content_hash(t, "md5").alias("md5"), S.stable_id(F.col("source"), F.col("lang")).alias("stable"))


@query(sql("SELECT id, CAST(rating AS DOUBLE) / 2 AS stars, repeat('★', rating) AS shown FROM ratings JOIN books ON book = id"))
def rating_scale(s: SparkSession, d: str) -> DataFrame:
    r = C.ratings(s, d)
    return r.select(F.col("book").alias("id"), files.five_point(F.col("rating")).alias("stars"), S.stars(F.col("rating")).alias("shown"))


@query("SELECT event_id AS id, epoch_us(ts) / 60e6 - epoch_us(TIMESTAMP '2024-01-01') / 60e6 AS minutes, CASE WHEN value > 1 THEN CAST(json_extract(props, '$.k') AS INT) / value END AS speed FROM events")
def session_fields(s: SparkSession, d: str) -> DataFrame:
    e = C.sessions(s, d)
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return e.select("id", S.minutes_between(start, F.col("start")).alias("minutes"), S.pages_per_minute(F.col("pages"), F.when(F.col("minutes") > 1, F.col("minutes"))).alias("speed"))


@query(sql("SELECT id, CASE WHEN id % 5 = 0 THEN 'title' END AS changed FROM books"))
def standardised_fields(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("id") % 5 == 0, F.concat("title", F.lit("  "))).otherwise(F.col("title"))
    change = S.standardize({"title": (raw, F.trim(raw)), "tag": (F.col("tag"), F.trim("tag"))})
    return C.books(s, d).select("id", F.nullif(F.array_join(F.map_keys(change), ","), F.lit("")).alias("changed"))


@query(sql("SELECT id, tag || ',' || lower(tag) AS tags FROM books"))
def list_dedupe(s: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" "), "tag"), F.lit(" "), F.col("tag"), F.lower("tag"), F.lit(""))
    return C.books(s, d).select("id", F.array_join(S.clean_list(raw), ",").alias("tags"))


@query()
def unicode_normalised(s: SparkSession, d: str) -> DataFrame:
    """NFKC and full entity replacement need Python; one Arrow pass each."""
    p = C.table(s, d, "pages")
    return p.select("page_id", S.normalize_unicode(F.col("url")).alias("url"), F.length(S.unescape_html(F.col("html"))).alias("n"))
