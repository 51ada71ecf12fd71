"""Searches that read a persisted index in place of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.textindex import TextIndex
from foliomill.operators.vectorindex import VectorIndex
from foliomill.plans.texts import _bm25_sql
from foliomill.registry import query
from foliomill.session import shared_folder
from foliomill.sources import catalog as C

_made: dict[tuple[str, str, str], str] = {}


def folder(s: SparkSession, d: str, kind: str) -> tuple[str, bool]:
    """Where the application keeps an index over the tables of ``d``, and whether it is new."""
    key = (s.sparkContext.applicationId, d, kind)
    if key in _made:
        return _made[key], False
    _made[key] = f"{shared_folder(s)}/{kind}-{s.sparkContext.applicationId}-{len(_made)}"
    return _made[key], True


def text_index(s: SparkSession, d: str) -> TextIndex:
    """The index over ``documents``, made by the first query that reads it."""
    path, new = folder(s, d, "text")
    index = TextIndex(s, path)
    return index.create(C.table(s, d, "documents"), "doc_id") if new else index


@query(_bm25_sql(["license"], "tf0 > 0", 20))
def fts_ranked(s: SparkSession, d: str) -> DataFrame:
    return text_index(s, d).search("license", 20)


@query(_bm25_sql(["apache", "und"], "tf0 > 0 OR tf1 > 0", 25))
def fts_any_term(s: SparkSession, d: str) -> DataFrame:
    return text_index(s, d).search("apache OR und", 25)


@query(_bm25_sql(["license", "public"], "tf0 > 0 AND tf1 > 0", 25))
def fts_all_terms(s: SparkSession, d: str) -> DataFrame:
    return text_index(s, d).search("license AND public", 25)


_MIT = "contains(' ' || array_to_string(w, ' ') || ' ', ' mit license ')"


@query(_bm25_sql(["mit", "license"], _MIT, 1_000_000))
def fts_phrase(s: SparkSession, d: str) -> DataFrame:
    """Every match of a phrase, with its score."""
    index = text_index(s, d)
    q, state, df, blocks = index.plan("MIT License", None)
    return index.matches(q, state, df, blocks).select("id", "score")


_EDGE = r"[^\p{L}\p{N}]"
_HIT = rf"(?i)(^|{_EDGE})(mit{_EDGE}+license)($|{_EDGE})"


@query(rf"""WITH top AS ({_bm25_sql(["mit", "license"], _MIT, 30)}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM top),
h AS (SELECT r.*, text, regexp_extract(text, '{_HIT}', 2) AS hit, length(string_split_regex(text, '{_HIT}')[1]) + length(regexp_extract(text, '{_HIT}', 1)) + 1 AS p FROM r JOIN documents ON doc_id = id),
e AS (SELECT *, p + length(hit) AS q, greatest(1, p - 32) AS b FROM h), w AS (SELECT {_MIT} AS m FROM (SELECT list_filter(string_split_regex(lower(text), '{_EDGE}+'), lambda w: w <> '') AS w FROM documents))
SELECT id, rank, score, CASE WHEN b > 1 THEN '...' ELSE '' END || substr(text, b, p - b) || '<mark>' || hit || '</mark>' || substr(text, q, 32) || CASE WHEN q + 32 <= length(text) THEN '...' ELSE '' END AS snippet,
p - 1 AS char_offset, q - 1 AS char_end, (SELECT count(*) FROM w WHERE m) AS total FROM e""")
def fts_snippets(s: SparkSession, d: str) -> DataFrame:
    """Rank, marked snippet, place and total together."""
    return text_index(s, d).find("MIT License", 30)


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank, 0.0::DOUBLE AS score, CASE WHEN p > 33 THEN '...' ELSE '' END || substr(text, greatest(1, p - 32), p - greatest(1, p - 32)) || '<mark>' || substr(text, p, 6) || '</mark>' || substr(text, p + 6, 32) || CASE WHEN p + 38 <= length(text) THEN '...' ELSE '' END AS snippet, p - 1 AS char_offset, p + 5 AS char_end, count(*) OVER () AS total FROM (SELECT doc_id, text, instr(lower(text), 'icense') AS p FROM documents) WHERE p > 0 ORDER BY doc_id LIMIT 40")
def fts_substring(s: SparkSession, d: str) -> DataFrame:
    """A request that is no word: texts that hold its characters."""
    return text_index(s, d).find("icense", 40)


#: every second document is cut to its half, every seventh goes
_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, CAST(length(text) // 2 AS INT)) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@query(_bm25_sql(["apache", "license"], "tf0 > 0 OR tf1 > 0", 50).replace("FROM documents", f"FROM {_CHANGED} documents"))
def fts_after_update(s: SparkSession, d: str) -> DataFrame:
    """The index after half of the documents changed and a seventh went."""
    docs = C.table(s, d, "documents")
    path, new = folder(s, d, "changed")
    index = TextIndex(s, path)
    if new:
        index.create(docs, "doc_id")
        even = docs.filter("doc_id % 2 = 0")
        index.upsert(even.withColumn("text", F.expr("left(text, length(text) div 2)")), "doc_id")
        index.delete(docs.filter("doc_id % 7 = 0"), "doc_id")
    return index.search("apache OR license", 50)


# --- vectors ------------------------------------------------------------------------------


def vector_index(s: SparkSession, d: str) -> VectorIndex:
    path, new = folder(s, d, "vectors")
    index = VectorIndex(s, path)
    return index.build(C.table(s, d, "embeddings"), "vec_id", "embedding", list_rows=100) if new else index


def _asked(s: SparkSession, d: str, every: int) -> DataFrame:
    return C.table(s, d, "embeddings").filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _join_sql(every: int, k: int, rows: str = "embeddings") -> str:
    d2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
    return f"SELECT query_id, rank, id, round(distance, 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, sqrt({d2}) AS distance FROM {rows} e, embeddings q WHERE q.vec_id % {every} = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= {k}"


_rounded = lambda df: df.withColumn("distance", F.round("distance", 6))


@query(_join_sql(10, 5))
def knn_join(s: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of every tenth row, exactly."""
    return _rounded(vector_index(s, d).nearest(_asked(s, d, 10), 5, leave_out_own=True))


@query(_join_sql(10, 5, "(SELECT * FROM embeddings WHERE label IN (1, 2))"))
def knn_join_filtered(s: SparkSession, d: str) -> DataFrame:
    may = C.table(s, d, "embeddings").filter("label in (1, 2)").select("vec_id")
    return _rounded(vector_index(s, d).nearest(_asked(s, d, 10), 5, where=may, leave_out_own=True))


@query("SELECT count(*) AS vectors, 64 AS width, CAST(1 AS BIGINT) AS duplicates FROM embeddings")
def vector_index_rebuilt(s: SparkSession, d: str) -> DataFrame:
    """A second build without force adds nothing: all vectors once, each id with at most ``duplicates`` rows."""
    path, new = folder(s, d, "rebuilt")
    index = VectorIndex(s, path)
    if new:
        rows = C.table(s, d, "embeddings")
        index.build(rows, "vec_id", "embedding").build(rows, "vec_id", "embedding")
    twice = index.rows().groupBy("id").count().agg(F.max("count").alias("duplicates"))
    return index.info().select("vectors", "width").join(twice)


@query()
def knn_join_recall(s: SparkSession, d: str) -> DataFrame:
    """Of the five nearest, the share that a search of half the lists finds, over every tenth row."""
    index, asked = vector_index(s, d), _asked(s, d, 10)
    exact = index.nearest(asked, 5, leave_out_own=True).select("query_id", "id")
    lists = index.info().select("lists").first()[0]
    some = index.nearest(asked, 5, lists=max(1, -(-lists // 2)), leave_out_own=True).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(some, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))
