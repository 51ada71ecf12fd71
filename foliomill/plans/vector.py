"""Vector search and recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import chunking
from foliomill.operators import vectors as V
from foliomill.registry import query
from foliomill.sources import catalog as C

_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}.embedding, {b}.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COS = f"{_DOT.format(a='e', b='q')} / (sqrt({_DOT.format(a='e', b='e')}) * sqrt({_DOT.format(a='q', b='q')}))"


@query(f"SELECT e.vec_id AS id, round({_L2}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY {_L2}, id LIMIT 10")
def knn_l2(s: SparkSession, d: str) -> DataFrame:
    return V.nearest_to_row(C.table(s, d, "embeddings"), 0, 10, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(f"SELECT e.vec_id AS id, round({_L2}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.vec_id <> 3 AND e.label IN (1, 2) ORDER BY {_L2}, id LIMIT 10")
def knn_filtered(s: SparkSession, d: str) -> DataFrame:
    return V.nearest_to_row(C.table(s, d, "embeddings"), 3, 10, "vec_id", "embedding", where=F.col("label").isin(1, 2)).withColumn("distance", F.round("distance", 6))


@query(f"SELECT e.vec_id AS id, round(1 - {_COS}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 5 AND e.vec_id <> 5 ORDER BY {_COS} DESC, id LIMIT 10")
def cosine_top_k(s: SparkSession, d: str) -> DataFrame:
    return V.nearest_to_row(C.table(s, d, "embeddings"), 5, 10, "vec_id", "embedding", metric="cosine").withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.05) * (x::DOUBLE - 0.05))), 6) AS distance FROM embeddings ORDER BY list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.05) * (x::DOUBLE - 0.05))), id LIMIT 7")
def knn_given_vector(s: SparkSession, d: str) -> DataFrame:
    return V.nearest(C.table(s, d, "embeddings"), [0.05] * 64, 7, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


_WORDS = "(SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w FROM documents)"


@query(f"SELECT a.id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score FROM {_WORDS} a, {_WORDS} b WHERE b.id = 1 AND a.id <> 1 AND len(list_intersect(a.w, b.w)) > 0 ORDER BY score DESC, a.id LIMIT 10")
def jaccard_similar(s: SparkSession, d: str) -> DataFrame:
    return V.similar_rows(C.table(s, d, "documents"), 1, ["text"], 10, "doc_id")


_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
_TFIDF = rf"""WITH tf AS (SELECT doc_id AS id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t FROM documents) WHERE t NOT IN ({_STOP}) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
l AS (SELECT id, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1), u AS (SELECT id, term, w / l AS w FROM raw JOIN l USING (id))"""


@query(f"{_TFIDF} SELECT a.id, round(sum(a.w * q.w), 6) AS score FROM u a JOIN u q ON q.term = a.term AND q.id = 2 WHERE a.id <> 2 GROUP BY 1 ORDER BY sum(a.w * q.w) DESC, a.id LIMIT 10")
def tfidf_similar(s: SparkSession, d: str) -> DataFrame:
    w = V.tfidf(C.table(s, d, "documents"), "doc_id", "text")
    return V.recommend(w, 2, 10).withColumn("score", F.round("score", 6))


@query()
def recommend_for_preferences(s: SparkSession, d: str) -> DataFrame:
    return V.recommend_for(C.table(s, d, "documents"), "doc_id", "text", "mit license password und nicht", 10).withColumn("score", F.round("score", 6))


@query("SELECT d.doc_id AS id, 'doc ' || d.lang || ' ' || d.source || coalesce(' q' || CAST(l.quality AS VARCHAR), '') AS text FROM documents d LEFT JOIN labels l USING (doc_id)")
def searchable_text(s: SparkSession, d: str) -> DataFrame:
    j = C.table(s, d, "documents").join(C.table(s, d, "labels"), "doc_id", "left")
    q = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string")))
    return j.select(F.col("doc_id").alias("id"), V.searchable_text(F.lit("doc"), F.array("lang"), F.col("source"), F.array_compact(F.array(q)), F.lit(None).cast("string")).alias("text")).withColumn("text", F.trim("text"))


@query()
def embedded_chunks(s: SparkSession, d: str) -> DataFrame:
    """Fixed chunks under keys of record and number, embedded by an injected model: a stand-in of hashed words, since no model is available offline."""
    rows = chunking.chunk_rows(C.table(s, d, "documents"), "doc_id", "text", chunking.fixed_chunks(F.col("text")))
    return V.embed(rows.withColumn("key", F.concat(F.lit("b"), F.col("id").cast("string"), F.lit("_i"), F.col("chunk_index").cast("string"))), "key", "text", V.hashed_embedding)


@query()
def chunk_summaries(s: SparkSession, d: str) -> DataFrame:
    """Map each distinct chunk to a summary, then combine: here the first words, joined."""
    rows = chunking.chunk_rows(C.table(s, d, "documents"), "doc_id", "text", chunking.fixed_chunks(F.col("text")))
    return V.map_reduce_summary(rows, lambda t: " ".join(t.split()[:5]), " / ".join)


@query("SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS mean FROM embeddings GROUP BY 1")
def vector_table_info(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("mean"))
