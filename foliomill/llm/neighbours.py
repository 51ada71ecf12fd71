"""Nearest neighbours by largest inner product over balanced posting lists.

Vectors get one more coordinate, so that the largest inner product is the smallest
distance.  A sample of at most ``SAMPLE`` vectors is halved again and again into
clusters of equal size, whose means are the lists' centroids.  Every vector goes to
its nearest list, and to further ones that are nearly as near (it lies on a boundary
then).  A query walks a graph of the centroids, which each task holds in memory, and
reads the lists whose distance is at most ``RATIO`` times the smallest.  The sampled
vectors of these lists, which the tasks hold too, say what the k-th best scores at
least, so a list sends only what is no worse.

Equal vectors are indexed once with the ``k + 1`` smallest of their ids: no later id
can be among k nearest, since ties go to smaller ids.  A list's rows and its
queries are dealt in blocks, so a list of any length is searched by many tasks.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, and rows without an id neither; of several vectors under one id the smallest
array counts; shorter vectors count as followed by zeros; with fewer candidates than
k a query gets all of them; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, partitions

#: vectors that the centroids are fitted to, lists at most, and vectors of a list while there are fewer lists
SAMPLE, MOST_LISTS, LIST_ROWS = 32_768, 8_192, 512
#: lists that hold a vector, and how much farther than the nearest they may be
REPLICAS, BOUNDARY = 4, 1.03
#: how much farther than the nearest a list may be that a query reads
RATIO = 1.2
#: neighbours of a centroid in the graph, nodes where a walk begins, and how much wider than the lists read it goes
DEGREE, ENTRIES, WIDER = 24, 64, 1.15
#: rows and queries of a block
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 512
#: distances that are held at once, and rows with a vector that a task sends at once
HELD, SENT = 1 << 19, 8_192


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, h): one usable vector for each id, and a digest that equal vectors share."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    one = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("h", F.md5(F.col("v").cast("string").cast("binary")))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(h, v, members): each distinct vector with the ``k + 1`` smallest of its ids; tasks drop later ids before the shuffle."""
    by = Window.partitionBy("h").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k + 1)
    return first.groupBy("h").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("members"))


def matrix(vectors: pd.Series, size: int) -> np.ndarray:
    """Rows of ``size`` components, zeros behind shorter vectors."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def halves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points in clusters of equal size, at most ``most`` each."""
    stack, out = [np.arange(len(points))], []
    while stack:
        own = stack.pop()
        if len(own) <= most:
            out.append(own)
            continue
        p = points[own]
        a = p[np.square(p - p.mean(0)).sum(1).argmax()]
        b = p[np.square(p - a).sum(1).argmax()]
        for _ in range(8):
            order = np.argsort(p @ (b - a), kind="stable")
            near, far = order[: len(own) // 2], order[len(own) // 2 :]
            a, b = p[near].mean(0), p[far].mean(0)
        stack += [own[near], own[far]]
    return out


@dataclass
class Lists:
    """Centroids of the posting lists, their graph, the vectors' greatest norm, and the sampled vectors."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    size: int
    sample: np.ndarray
    home: np.ndarray

    def least(self, vectors: np.ndarray, read: np.ndarray, k: int) -> np.ndarray:
        """For each query a product that ``k`` vectors of the lists it reads reach: that of the ``k``-th best sampled one there."""
        out, step = np.full(len(vectors), -np.inf), max(1, HELD // len(self.sample))
        if len(self.sample) < k:
            return out
        for i in range(0, len(vectors), step):
            dots = np.where(read[i : i + step][:, self.home], vectors[i : i + step] @ self.sample.T, -np.inf)
            out[i : i + step] = np.partition(dots, -k, axis=1)[:, -k]
        return out - 1e-9 * np.where(np.isfinite(out), 1 + np.abs(out), 0)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that brings them to the greatest norm."""
        return np.hstack([vectors, np.sqrt(np.maximum(0, self.norm**2 - np.square(vectors).sum(1)))[:, None]])

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """Queries at the greatest norm: a query's length changes no order."""
        scale = self.norm / np.sqrt(np.square(vectors).sum(1))
        return np.hstack([vectors * scale[:, None], np.zeros((len(vectors), 1))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From each point to each centroid."""
        c = self.centroids
        return np.sqrt(np.maximum(0, np.square(points).sum(1)[:, None] + np.square(c).sum(1) - 2 * points @ c.T))

    def homes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) places: the nearest list of each point first, then those on whose boundary it lies."""
        d = self.distances(points)
        order = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(d, order, 1)
        take = near <= BOUNDARY * near[:, :1]
        take[:, 0] = True
        at, which = np.nonzero(take)
        return at, order[at, which]

    def near(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """For each point the lists within ``ratio`` of the nearest, found by a walk over the graph.

        All nodes seen so far that are within the ratio of the best one, or ``WIDER``, are
        followed at once, for all points, until none is left that was not followed.
        """
        m, n = len(points), len(self.centroids)
        d, followed = np.full((m, n), np.inf), np.zeros((m, n), bool)
        squares = np.square(points).sum(1), np.square(self.centroids).sum(1)

        def look(at: np.ndarray, node: np.ndarray) -> None:
            for i in range(0, len(at), HELD // points.shape[1]):
                a, c = at[i : i + HELD // points.shape[1]], node[i : i + HELD // points.shape[1]]
                dots = np.einsum("ij,ij->i", points[a], self.centroids[c])
                d[a, c] = np.sqrt(np.maximum(0, squares[0][a] + squares[1][c] - 2 * dots))

        entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(int))
        look(np.repeat(np.arange(m), len(entries)), np.tile(entries, m))
        while True:
            at, node = np.nonzero(~followed & (d <= WIDER * ratio * d.min(1)[:, None]))
            if not len(at):
                return d <= ratio * d.min(1)[:, None]
            followed[at, node] = True
            seen = np.zeros((m, n), bool)
            for c in self.graph.T:
                seen[at, c[node]] = True
            look(*np.nonzero(seen & np.isinf(d)))


def fit(kinds: DataFrame, n: int, size: int, norm: float, sample: int = SAMPLE, most_lists: int = MOST_LISTS, list_rows: int = LIST_ROWS) -> Lists:
    """Centroids and their graph from at most ``sample`` vectors, picked by a hash of their digest."""
    picked = kinds.orderBy(F.xxhash64("h"), "h").limit(sample).select("v").toPandas()["v"]
    lists = Lists(np.zeros((1, size + 1)), np.zeros((1, 1), int), norm, size, matrix(picked, size), np.zeros(len(picked), int))
    points = lists.lifted(lists.sample)
    wanted = max(1, min(most_lists, -(-n // list_rows), len(points)))
    lists.centroids = np.array([points[own].mean(0) for own in halves(points, -(-len(points) // wanted))])
    for i in range(0, len(points), 256):
        lists.home[i : i + 256] = lists.distances(points[i : i + 256]).argmin(1)
    degree = min(DEGREE, len(lists.centroids) - 1)
    graph = [np.argsort(lists.distances(lists.centroids[i : i + 256]), axis=1, kind="stable")[:, : degree + 1] for i in range(0, len(lists.centroids), 256)]
    own = np.arange(len(lists.centroids))
    # neighbours in the order of halving keep the graph in one piece
    lists.graph = np.hstack([np.vstack(graph), np.roll(own, 1)[:, None], np.roll(own, -1)[:, None]])
    return lists


def postings(kinds: DataFrame, lists: Lists) -> DataFrame:
    """(list, main, h, v, members): every vector in each of its lists; ``main`` marks the nearest."""
    shared = kinds.sparkSession.sparkContext.broadcast(lists)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = shared.value
        step = max(1, HELD // len(to.centroids))
        for f in frames:
            for i in range(0, len(f), step):
                part = f.iloc[i : i + step]
                at, which = to.homes(to.lifted(matrix(part["v"], to.size)))
                main = np.r_[True, at[1:] != at[:-1]][: len(at)]
                for j in range(0, len(at), SENT):
                    out = part.iloc[at[j : j + SENT]].copy()
                    out.insert(0, "list", which[j : j + SENT])
                    out.insert(1, "main", main[j : j + SENT])
                    yield out

    return kinds.select("h", "v", "members").mapInPandas(run, "list int, main boolean, h string, v array<double>, members array<long>")


def probes(asked: DataFrame, lists: Lists, held: dict[int, int], need: int, ratio: float = RATIO) -> DataFrame:
    """(list, h, v, least): the lists that each query reads, and what its ``need``-th best scores at least.

    ``held`` has the ids whose nearest list is that one.  Where the lists that the
    ratio selects hold fewer than ``need``, the next nearest follow.
    """
    sizes = np.zeros(len(lists.centroids), np.int64)
    for which, n in held.items():
        sizes[which] = n
    shared = asked.sparkSession.sparkContext.broadcast((lists, sizes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, sizes = shared.value
        step = max(1, HELD // len(to.centroids))
        for f in frames:
            for i in range(0, len(f), step):
                part = f.iloc[i : i + step]
                vectors = matrix(part["v"], to.size)
                points = to.asked(vectors)
                take = to.near(points, ratio)
                short = np.flatnonzero(take @ sizes < need)
                if len(short):
                    order = np.argsort(to.distances(points[short]), axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    take[np.repeat(short, len(sizes)), order.ravel()] |= (before < need).ravel()
                at, which = np.nonzero(take)
                least = to.least(vectors, take, need)
                for j in range(0, len(at), SENT):
                    out = part.iloc[at[j : j + SENT]].copy()
                    out.insert(0, "list", which[j : j + SENT])
                    out["least"] = least[at[j : j + SENT]]
                    yield out

    return asked.select("h", "v").mapInPandas(run, "list int, h string, v array<double>, least double")


def best(queries: np.ndarray, rows: np.ndarray, members: list[np.ndarray], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best ids of each query that score ``least``; the product of two vectors is the same wherever it is made."""
    dots = queries @ rows.T
    room = 1e-9 * np.sqrt(np.square(queries).sum(1).max() * np.square(rows).sum(1).max())
    here = np.partition(dots, -min(k, dots.shape[1]), axis=1)[:, -min(k, dots.shape[1])]
    q, r = np.nonzero(dots >= np.maximum(here, least)[:, None] - room)
    score = np.empty(len(q))
    step = max(1, HELD // rows.shape[1])
    for i in range(0, len(q), step):
        score[i : i + step] = (queries[q[i : i + step]] * rows[r[i : i + step]]).sum(1)
    many = np.array([len(m) for m in members])
    ids = np.concatenate(members)
    first = np.cumsum(many) - many
    n = many[r]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    q, score, vec = np.repeat(q, n), np.repeat(score, n), ids[np.repeat(first[r], n) + inside]
    order = np.lexsort((vec, -score, q))
    q, score, vec = q[order], score[order], vec[order]
    start = np.r_[True, q[1:] != q[:-1]][: len(q)]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return q[place < k], vec[place < k], score[place < k]


def candidates(posted: DataFrame, asked: DataFrame, size: int, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(h, vec_id, score): of each block of a list that a query reads, the ``k`` best ids that score enough."""
    spark = posted.sparkSession
    lengths = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    waiting = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = [(i, -(-n // block_rows), -(-waiting[i] // block_queries)) for i, n in lengths.items() if i in waiting]
    by = F.broadcast(spark.createDataFrame(blocks, "list int, row_blocks int, query_blocks int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    here = posted.join(by, "list").select("list", F.pmod(F.xxhash64("h"), "row_blocks").cast("int").alias("rb"), every("query_blocks").alias("qb"), "v", "members")
    there = asked.join(by, "list").select("list", every("row_blocks").alias("rb"), F.pmod(F.xxhash64("h"), "query_blocks").cast("int").alias("qb"), "h", "v", "least")

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"h": [], "vec_id": [], "score": []})
        q, vec, score = best(matrix(queries["v"], size), matrix(rows["v"], size), [np.asarray(m) for m in rows["members"]], queries["least"].to_numpy(), k)
        return pd.DataFrame({"h": queries["h"].to_numpy()[q], "vec_id": vec, "score": score})

    key = ["list", "rb", "qb"]
    return here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(run, "h string, vec_id long, score double")


def nearest(df: DataFrame, is_query, k: int = 20, ratio: float = RATIO, sample: int = SAMPLE, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:  # noqa: ANN001
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every vector whose id fulfils ``is_query``."""
    spark = df.sparkSession
    rows = materialize(usable(df), "vectors")
    kinds = materialize(classes(rows, k), "vector_classes")
    found = kinds.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    queries = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v", "h")
    if not found[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, size, norm = found[0], found[1], found[2]
    lists = fit(kinds, n, size, norm, sample, list_rows=list_rows)
    posted = materialize(postings(kinds, lists), "postings")
    held = {r["list"]: r["n"] for r in posted.filter("main").groupBy("list").agg(F.sum(F.size("members")).alias("n")).collect()}
    asked = materialize(probes(queries.groupBy("h").agg(F.first("v").alias("v")), lists, held, k + 1, ratio), "probes")
    some = materialize(candidates(posted, asked, size, k + 1, block_rows, block_queries), "candidates")
    order = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    # a vector found in two of its lists has one place
    top = some.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k + 1).dropDuplicates(["h", "vec_id"]).drop("place")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    joined = queries.select("query_id", "h").join(top, "h").filter(F.col("query_id") != F.col("vec_id"))
    return joined.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
