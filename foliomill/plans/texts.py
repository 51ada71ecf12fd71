"""Full-text search, snippets, chunking, text statistics, request parsing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import chunking, nlquery
from foliomill.functions import text as X
from foliomill.plans.search import sql
from foliomill.registry import query
from foliomill.sources import catalog as C
from foliomill.sources import files

_TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _bm25_sql(terms: list[str], need: str, limit: int) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"WITH w AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), c AS (SELECT id, len(w) AS n, w, {tf} FROM w), t AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM c) SELECT id, {score} AS score FROM c, t WHERE {need} ORDER BY score DESC, id LIMIT {limit}"


@query(_bm25_sql(["license"], "tf0 > 0", 20))
def bm25_top_k(s: SparkSession, d: str) -> DataFrame:
    return X.bm25(C.table(s, d, "documents"), "doc_id", "text", "license", 20)


@query(_bm25_sql(["mit", "license"], "contains(' ' || array_to_string(w, ' ') || ' ', ' mit license ')", 15))
def bm25_phrase(s: SparkSession, d: str) -> DataFrame:
    return X.bm25(C.table(s, d, "documents"), "doc_id", "text", "MIT License", 15)


@query(_bm25_sql(["apache", "und"], "tf0 > 0 OR tf1 > 0", 25))
def bm25_any_term(s: SparkSession, d: str) -> DataFrame:
    return X.bm25(C.table(s, d, "documents"), "doc_id", "text", "apache OR und", 25)


@query(_bm25_sql(["license", "public"], "tf0 > 0 AND tf1 > 0", 25))
def bm25_all_terms(s: SparkSession, d: str) -> DataFrame:
    return X.bm25(C.table(s, d, "documents"), "doc_id", "text", "license AND public", 25)


@query()
def bm25_stemmed(s: SparkSession, d: str) -> DataFrame:
    return X.bm25(C.table(s, d, "documents"), "doc_id", "text", "licensed", 20, stemmed=True)


@query("SELECT doc_id AS id, substr(text, greatest(1, p - 50), 150) AS snippet, p - 1 AS char_offset, p + 10 AS char_end FROM (SELECT *, instr(lower(text), 'mit license') AS p FROM documents) WHERE p > 0")
def like_snippet(s: SparkSession, d: str) -> DataFrame:
    return X.like_search(C.table(s, d, "documents"), "doc_id", "text", '"MIT License"').withColumn("char_offset", F.col("char_offset").cast("long")).withColumn("char_end", F.col("char_end").cast("long"))


@query("SELECT doc_id AS id, CASE WHEN p > 21 THEN '...' ELSE '' END || substr(text, greatest(1, p - 20), p - greatest(1, p - 20)) || '<mark>' || substr(text, p, 6) || '</mark>' || substr(text, p + 6, 20) || CASE WHEN p + 26 <= length(text) THEN '...' ELSE '' END AS snippet FROM (SELECT *, instr(lower(text), 'apache') AS p FROM documents) WHERE p > 0")
def marked_snippet(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").select(F.col("doc_id").alias("id"), X.snippet(F.col("text"), "Apache", 20).alias("snippet")).filter("snippet is not null")


@query("SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'und', ''))) / 3 AS INT) AS n, instr(lower(text), 'und') - 1 AS \"offset\" FROM documents WHERE contains(lower(text), 'und')")
def phrase_occurrences(s: SparkSession, d: str) -> DataFrame:
    return X.occurrences(C.table(s, d, "documents"), "text", "und").select("doc_id", "n", F.col("offset").cast("long").alias("offset"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r, turn) AS n FROM (SELECT *, CASE WHEN contains(lower(text), 'there') THEN 0 WHEN contains(lower(text), 'th') THEN 1 END AS r FROM conversations) WHERE r IS NOT NULL) WHERE n = 1")
def locate_section(s: SparkSession, d: str) -> DataFrame:
    return X.first_section(C.table(s, d, "conversations"), "conv_id", "turn", "text", "there").select("conv_id", "turn")


@query(sql("""SELECT id, CAST(s AS DOUBLE) AS score FROM (SELECT id, 2.0 * (contains(title, 'red')::INT + contains(title, 'promo')::INT) + 1.5 * (contains(lower(publisher), 'red')::INT + contains(lower(publisher), 'promo')::INT)
 + (contains(lower(tag), 'red')::INT + contains(lower(tag), 'promo')::INT) AS s FROM books) WHERE s > 0 ORDER BY s DESC, id LIMIT 60"""))
def weighted_score(s: SparkSession, d: str) -> DataFrame:
    score = X.term_score("Red PROMO", F.col("title"), F.array("publisher"), F.array("tag"), F.lit(None).cast("string"))
    return C.books(s, d).select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(60)


@query(sql("SELECT id, regexp_replace(title, '(?i)(bolt)', '<mark>\\1</mark>', 'g') AS title FROM books WHERE contains(title, 'bolt')"))
def highlights(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).filter(F.col("title").contains("bolt")).select("id", X.highlight(F.col("title"), "BOLT").alias("title"))


@query(sql("SELECT id, CAST(3 AS DOUBLE) * contains(title, 'red')::INT + 3 * contains(title, 'bolt')::INT + contains(lower(tag), 'red')::INT + contains(lower(tag), 'bolt')::INT AS score FROM books WHERE contains(title, 'red') OR contains(title, 'bolt')"))
def boosted_query(s: SparkSession, d: str) -> DataFrame:
    score = X.boosted({"title": (F.col("title"), 3.0), "tag": (F.col("tag"), 1.0)}, "red OR bolt")
    return C.books(s, d).select("id", score.alias("score")).filter("score > 0")


@query(sql("SELECT id FROM books WHERE len(list_filter(string_split(title, ' '), lambda w: levenshtein(w, 'rod') <= 1)) > 0"))
def fuzzy_query(s: SparkSession, d: str) -> DataFrame:
    score = X.boosted({"title": (F.col("title"), 1.0)}, "rod", mode="FUZZY")
    return C.books(s, d).filter(score > 0).select("id")


@query("SELECT doc_id AS id, CAST(i AS INT) AS chunk_index, md5(substr(text, CAST(i * 800 + 1 AS INT), 1000)) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 800)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_rows(C.table(s, d, "documents"), "doc_id", "text", chunking.fixed_chunks(F.col("text")))
    return rows.select("id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def boundary_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = chunking.corpus(C.table(s, d, "documents"), "text")
    return chunking.chunk_rows(docs, "doc_id", "text", chunking.boundary_chunks()(F.col("text")))


@query()
def chapter_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = chunking.corpus(C.table(s, d, "documents"), "text")
    return chunking.chunk_rows(docs, "doc_id", "text", chunking.chapter_chunks()(F.col("text")))


@query(r"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''))) AS n FROM documents)
SELECT doc_id, length(text) AS chars, len(w) AS words, n AS sentences, round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / len(w), 0), 6) AS avg_word_length, round(len(w) / n, 6) AS avg_sentence_length, len(list_distinct(w)) AS unique_words, round(coalesce(len(list_distinct(w)) / len(w), 0), 6) AS lexical_diversity FROM t""")
def text_statistics(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").select("doc_id", *[c.alias(k) for k, c in X.statistics(F.col("text")).items()])


@query(r"WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text || ' good bad good'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM conversations), v AS (SELECT *, (len(list_filter(w, lambda x: x = 'good')) - len(list_filter(w, lambda x: x = 'bad'))) / len(w) AS s FROM t) SELECT conv_id, turn, round(s, 6) AS score, CASE WHEN s > 0.01 THEN 'positive' WHEN s < -0.01 THEN 'negative' ELSE 'neutral' END AS label FROM v")
def sentiment(s: SparkSession, d: str) -> DataFrame:
    c = C.table(s, d, "conversations").withColumn("text", F.concat("text", F.lit(" good bad good")))
    score, label = X.sentiment(F.col("text"))
    return c.select("conv_id", "turn", F.round(score, 6).alias("score"), label.alias("label"))


@query()
def named_spans(s: SparkSession, d: str) -> DataFrame:
    runs = C.table(s, d, "documents").select("doc_id", F.explode(X.capitalised_runs(F.col("text"))).alias("span"))
    return runs.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("n"), "span").limit(20)


@query("SELECT w AS term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(" + _TOK + ") AS w FROM documents) GROUP BY 1, 2) GROUP BY 1")
def inverted_index(s: SparkSession, d: str) -> DataFrame:
    p = X.postings(C.table(s, d, "documents"), "doc_id", "text").groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


NOW = date(2024, 5, 15)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query()
def parsed_requests(s: SparkSession, d: str) -> DataFrame:
    """Every turn read as a request."""
    read = nlquery.read_requests(C.table(s, d, "conversations").select("conv_id", "turn", "text"), "text", NOW)
    languages = F.array_join("parsed.language_hints", ",").alias("languages")
    return read.select("conv_id", "turn", *[f"parsed.{c}" for c in ("text", *nlquery.SLOT_NAMES, "content_type", "added_after", "added_before", "prefer_semantic_search")], languages)


@query(f"SELECT conv_id, turn, array_to_string(list_filter({_LIST(nlquery.LANGUAGES)}, lambda x: regexp_matches(lower(text), '\\b' || x || '\\b')), ',') AS languages FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' from Japan, in japanese' WHEN 1 THEN ' (Polish edition)' ELSE ' germany' END AS text FROM conversations)")
def language_hints(s: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("turn") % 3 == 0, " from Japan, in japanese").when(F.col("turn") % 3 == 1, " (Polish edition)").otherwise(" germany")
    c = C.table(s, d, "conversations").select("conv_id", "turn", F.concat("text", place).alias("text"))
    return c.select("conv_id", "turn", F.array_join(nlquery.hints(F.col("text")), ",").alias("languages"))


_MEANING = f"""
WITH t AS (SELECT conv_id, turn, lower(CASE turn % 4 WHEN 0 THEN 'a locked room' WHEN 1 THEN 'which books are left' WHEN 2 THEN 'horror and crime by candle light' ELSE 'polish notes on logic' END || ' ' || role) AS low FROM conversations),
w AS (SELECT *, len(string_split(low, ' ')) AS n, len(list_filter({_LIST(nlquery.GENRES)}, lambda g: contains(low, g))) AS genres,
  nullif(regexp_extract(low, ' by\\s+(.+)', 1), '') AS author FROM t)
SELECT conv_id, turn, len(list_filter({_LIST(nlquery.INVENTORY)}, lambda p: regexp_matches(low, p))) > 0
  OR len(list_filter({_LIST(nlquery.CONCEPTS)}, lambda c: contains(low, c))) > 0
  OR (len(list_filter({_LIST(nlquery.LANGUAGES)}, lambda x: regexp_matches(low, '\\b' || x || '\\b'))) > 0 AND n >= 4)
  OR (genres > 1 AND n >= 5) OR (genres > 0 AND author IS NOT NULL AND n >= 6) OR (author IS NULL AND n >= 10) AS by_meaning FROM w
"""


@query(_MEANING)
def search_by_meaning(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("turn") % 4
    asked = F.when(kind == 0, "a locked room").when(kind == 1, "which books are left").when(kind == 2, "horror and crime by candle light").otherwise("polish notes on logic")
    c = C.table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", asked, "role").alias("text"))
    found = nlquery.slots(F.col("text"))
    return c.select("conv_id", "turn", nlquery.prefers_meaning(F.col("text"), found["author"], found["series"]).alias("by_meaning"))


@query("SELECT conv_id, turn, nullif(trim(regexp_extract(lower(text), ' by\\s+(.+)', 1)), '') AS author, nullif(regexp_extract(lower(text), '([1-5])\\s+stars?', 1), '') AS rating FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') || ' by ' || role || ' ' || CAST(turn AS VARCHAR) || ' stars' AS text FROM conversations)")
def request_slots(s: SparkSession, d: str) -> DataFrame:
    c = C.table(s, d, "conversations").select("conv_id", "turn", F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" by "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit(" stars")).alias("text"))
    low = F.lower("text")
    return c.select("conv_id", "turn", F.nullif(F.trim(F.regexp_extract(low, nlquery.SLOTS["author"][2], 1)), F.lit("")).alias("author"), F.nullif(F.regexp_extract(low, nlquery.SLOTS["rating"][2], 1), F.lit("")).alias("rating"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>')) AS n FROM pages")
def page_links(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "pages").select("page_id", F.size(files.anchors(F.col("html"))).cast("long").alias("n"))


@query("SELECT item_id, count(doc_id) AS docs FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1")
def benchmark_in_documents(s: SparkSession, d: str) -> DataFrame:
    """Whole passages."""
    b = C.table(s, d, "benchmark").select("item_id", F.lower("text").alias("needle"))
    return X.documents_with(b, C.table(s, d, "documents"))
