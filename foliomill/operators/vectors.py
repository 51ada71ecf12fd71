"""Vectors: nearest neighbours, similarity, TF-IDF recommendation.

Arithmetic on fixed-width vectors stays in the JVM.  A query is one row, so its
join is a broadcast of known size and the result a top-k per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: words that say nothing about a text
STOP_WORDS = "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its may more most my no not of on one or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your".split()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "vector", where: Column | None = None, metric: str = "l2") -> DataFrame:
    """(id, distance) of the ``k`` nearest rows that pass ``where``; ties by id."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    d = squared_l2(F.col(vector), q) if metric == "l2" else 1 - cosine(F.col(vector), q)
    return rows.select(F.col(id_col).alias("id"), d.alias("distance")).orderBy("distance", "id").limit(k)


def nearest_to_row(vectors: DataFrame, row_id: int, k: int, id_col: str = "id", vector: str = "vector", where: Column | None = None, metric: str = "l2") -> DataFrame:
    """The ``k`` rows nearest to a stored row, itself left out by id."""
    q = vectors.filter(F.col(id_col) == row_id).select(F.col(vector).alias("_q")).limit(1)
    rows = (vectors if where is None else vectors.filter(where)).filter(F.col(id_col) != row_id)
    both = rows.crossJoin(F.broadcast(q))  # one row
    d = squared_l2(F.col(vector), F.col("_q")) if metric == "l2" else 1 - cosine(F.col(vector), F.col("_q"))
    return both.select(F.col(id_col).alias("id"), d.alias("distance")).orderBy("distance", "id").limit(k)


def top_groups(scored: DataFrame, group: str, score: str, groups: int, per_group: int, id_col: str = "id") -> DataFrame:
    """The best ``per_group`` rows of each of the best ``groups`` groups."""
    best = scored.groupBy(group).agg(F.min(score).alias("_b")).orderBy("_b", group).limit(groups).select(group)
    w = Window.partitionBy(group).orderBy(score, id_col)
    return scored.join(best, group, "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_group)


def embed(docs: DataFrame, id_col: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 128) -> DataFrame:
    """(id, vector) by an injected model, in batches; the id is of whatever type it was."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "vector": model(part["text"].fillna("").tolist())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def hashed_embedding(texts: list[str], width: int = 64) -> list[list[float]]:
    """A model for tests and offline use: signed hashed word counts, normalised."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * width
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % width] += 1.0 if h & 0x10000 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def searchable_text(title: Column, authors: Column, series: Column, tags: Column, comment: Column, longest: int = 20_480) -> Column:
    """One text of a record's parts; missing ones are left out."""
    return F.substring(F.concat_ws(" ", title, F.array_join(authors, " "), series, F.array_join(tags, " "), comment), 1, longest)


def terms(c: Column) -> Column:
    """Words of two and more characters without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


#: bytes of the texts whose words one task counts
TASK_BYTES = 16 << 20


def _one_each(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text), the rows of one id (or without one) as one text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def _weighted(rows: DataFrame, some: DataFrame, n: DataFrame) -> DataFrame:
    """(id, term, w) of ``some`` of the (id, text) ``rows``: counts times idf over all of them.

    Texts are exchanged for their counts, and a row of each text's distinct words
    counts for the idf before anything is exchanged.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    tf = some.repartition(tasks, "id").select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = rows.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))


def tfidf(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, weight): raw counts times smoothed idf ln((1+n)/(1+df))+1, each document of unit length."""
    rows = _one_each(docs, id_col, text)
    raw = _weighted(rows, rows, docs.agg(F.count(F.lit(1)).alias("n")))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.filter("id is not null").select("id", "term", (F.col("w") / length).alias("weight"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (id, score); equal texts tie, whatever the order in which their weights were added."""
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def recommend(weights: DataFrame, row_id: int, k: int) -> DataFrame:
    """(id, score): the documents of greatest cosine to one of them, itself left out by id."""
    query = weights.filter(F.col("id") == row_id).select("term", F.col("weight").alias("q"))
    hits = weights.filter(F.col("id") != row_id).join(query, "term")
    return _best(hits.groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score")), k)


def recommend_for(docs: DataFrame, id_col: str, text: str, wanted: str, k: int) -> DataFrame:
    """(id, score): the documents nearest to a text of preferences."""
    rows = _one_each(docs, id_col, text)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    query = docs.sparkSession.createDataFrame([(wanted,)], "t string").select(F.explode(terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    words = [r["term"] for r in query.select("term").collect()]
    # only texts that hold a word of the query have a score
    asked = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    some = rows.filter(F.col("id").isNotNull() & F.arrays_overlap(terms(F.col("text")), asked))
    df = some.select(F.explode(F.array_intersect(terms(F.col("text")), asked)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = query.join(df, "term").crossJoin(F.broadcast(n)).select("term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("q"))
    length = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("l"))
    unit = q.crossJoin(F.broadcast(length)).select("term", (F.col("q") / F.col("l")).alias("q"))
    w = F.col("w")
    # a row for each word of the query is broadcast
    both = _weighted(rows, some, n).join(F.broadcast(unit), "term", "left").groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("l"), F.sum(w * F.col("q")).alias("dot"))
    return _best(both.select("id", (F.col("dot") / F.col("l")).alias("score")), k)


def similar_rows(df: DataFrame, row_id: int, fields: list[str], k: int, id_col: str = "id") -> DataFrame:
    """(id, score): overlap of word sets with one row, over all other rows."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *fields)), r"\s+"), lambda w: w != ""))
    rows = df.select(F.col(id_col).alias("id"), words.alias("w"))
    q = rows.filter(F.col("id") == row_id).select(F.col("w").alias("q")).limit(1)
    score = F.coalesce(F.try_divide(F.size(F.array_intersect("w", "q")), F.size(F.array_union("w", "q"))), F.lit(0.0))
    return rows.filter(F.col("id") != row_id).crossJoin(F.broadcast(q)).select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def map_reduce_summary(chunks: DataFrame, summarise: Callable[[str], str], combine: Callable[[list[str]], str], key: str = "id") -> DataFrame:
    """(id, summary): each distinct chunk summarised once, then the chunks of a document combined in order.

    A document's summaries are short; ``combine`` gets them as one list.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["summary"] = [summarise(t) for t in f["text"]]
            yield f[["digest", "summary"]]

    keyed = chunks.withColumn("digest", F.md5(F.col("text").cast("binary")))
    done = keyed.select("digest", "text").dropDuplicates(["digest"]).mapInPandas(each, "digest string, summary string")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_index")
        return pd.DataFrame({"id": [rows["id"].iloc[0]], "summary": [combine(rows["summary"].tolist())]})

    return keyed.select(F.col(key).alias("id"), "chunk_index", "digest").join(done, "digest").groupBy("id").applyInPandas(join, "id long, summary string")
