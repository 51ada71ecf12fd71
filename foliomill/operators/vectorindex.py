"""A vector index as tables: rows by the nearest of trained centres, with their distance to it.

``vectors`` is sorted by list (the number of the nearest centre) and distance.  With
d(q, c) from a query to a centre and r from a row to it, no row is nearer than
|d(q, c) - r|: a search reads a query's nearest lists first, and then of the others
only those, and of them only the rows, that can still be among the ``k`` nearest.
That is exact; with ``lists`` it stops after so many lists and is approximate.

Many queries are searched at once.  Lists are read in runs that follow one another,
and a run's rows and queries meet in blocks of bounded size, so that a query is sent
once to a run and not once to each list.  A change adds a segment (see ``sources.versions``).

Rows without an id, and vectors that are null, empty or hold null or non-finite
components, are left out; all vectors of an index have one length, or an error is
raised.  Of several rows with one id in one change, the one with the smallest vector
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.sources.versions import Versions

VECTORS = "list int, distance double, id long, vector array<double>"
LISTS = "list int, n long, least double, most double"
CENTRES = "list int, vector array<double>"
GONE = "id long"

#: vectors that the centres are trained on, and lists at most
SAMPLE, MOST_LISTS = 20_000, 4_096
#: rows and queries of a block
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 4_096
#: distances that a task holds at once
HELD = 1 << 19
MOST_BROADCAST = 200_000


def nearest_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each point's nearest centre."""
    out, step = np.empty(len(points), int), max(1, HELD // len(centres))
    for i in range(0, len(points), step):
        out[i : i + step] = distances(points[i : i + step], centres).argmin(1)
    return out


def train(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres of the points by Lloyd's rounds from evenly picked ones; a centre without points stays."""
    centres = points[np.linspace(0, len(points) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_of(points, centres)
        order = np.argsort(own, kind="stable")
        used, start = np.unique(own[order], return_index=True)
        for i, part in zip(used, np.split(order, start[1:])):
            centres[i] = points[part].mean(0)
    return np.unique(centres, axis=0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 1024):
        p = a[i : i + 1024]
        out[i : i + 1024] = np.sqrt(np.maximum(0, np.square(p).sum(1)[:, None] + np.square(b).sum(1) - 2 * p @ b.T))
    return out


def runs_of(n: np.ndarray) -> np.ndarray:
    """Of lists with ``n`` rows the run of each: neighbours that hold a block's rows together."""
    return (np.cumsum(n) - n) // BLOCK_ROWS


def blocks_of(rows: DataFrame, asked: DataFrame, lengths: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and queries of a run dealt in blocks (rb, qb), each row to all blocks of queries and each query to all of rows."""
    waiting = asked.groupBy("run").agg(F.count("*").alias("asked"))
    number = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int")
    sizes = lengths.join(waiting, "run").select("run", number("n", BLOCK_ROWS).alias("rbs"), number("asked", BLOCK_QUERIES).alias("qbs"))
    sizes = F.broadcast(sizes)  # a row for each run
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    here = rows.join(sizes, "run").select("run", of("id", "rbs").alias("rb"), every("qbs").alias("qb"), *kept)
    there = asked.join(sizes, "run").select("run", every("rbs").alias("rb"), of("query_id", "qbs").alias("qb"), "query_id", "query", "lists", "within")
    return here, there


FOUND = "query_id long, id long, distance double"
ASKED = "run int, query_id long, query array<double>, lists array<int>, within double"


def sent(f: pd.DataFrame, take: np.ndarray, run: np.ndarray, within: np.ndarray) -> pd.DataFrame:
    """Queries with the lists that they read (``take``: query by list), a row for each run."""
    at, which = np.nonzero(take)
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(run[which], prepend=-1) != 0))
    lists = pd.Series(np.split(which.astype(np.int32), first[1:]) if len(first) else [], dtype=object)
    at, which = at[first], which[first]
    return pd.DataFrame({"run": run[which].astype(np.int32), "query_id": f["query_id"].to_numpy()[at], "query": f["query"].to_numpy()[at], "lists": lists, "within": within[at]})


def meet(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one block, the ``k`` nearest rows of each query that are in its lists and within its bound."""
    none = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "distance": []})
    if not len(rows) or not len(queries):
        return none
    x, ids = np.stack(rows["vector"].to_numpy()), rows["id"].to_numpy()
    names, code = np.unique(rows["list"].to_numpy(), return_inverse=True)
    squares, m = np.square(x).sum(1), min(k, len(x))
    out, step = [none], max(1, HELD // len(x))
    for i in range(0, len(queries), step):
        part = queries.iloc[i : i + step]
        q, within = np.stack(part["query"].to_numpy()), part["within"].to_numpy()
        wanted = np.concatenate(part["lists"].to_numpy())
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        has, by = names[place] == wanted, np.repeat(np.arange(len(q)), part["lists"].map(len))
        read = np.zeros((len(q), len(names)), bool)
        read[by[has], place[has]] = True
        # roughly first, with room for what the products lose
        d = np.where(read[:, code], np.square(q).sum(1)[:, None] + squares - 2 * q @ x.T, np.inf)
        room = 1e-9 * (1 + np.square(q).sum(1) + squares.max())
        bound = within + 1e-9 * (1 + within)
        a, b = np.nonzero(np.isfinite(d) & (d <= (np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1], bound**2) + room)[:, None]))
        exact = np.empty(len(a))
        for j in range(0, len(a), 1 << 16):
            exact[j : j + (1 << 16)] = np.sqrt(np.square(x[b[j : j + (1 << 16)]] - q[a[j : j + (1 << 16)]]).sum(1))
        order = np.lexsort((ids[b], exact, a))
        order = order[exact[order] <= bound[a[order]]]
        a, b, exact = a[order], b[order], exact[order]
        near = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[a[near]], "id": ids[b[near]], "distance": exact[near]}))
    return pd.concat(out) if len(out) > 2 else out[-1]


class VectorIndex:
    """An index in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.versions = Versions(spark, path)

    # --- writing ---------------------------------------------------------------------

    def build(self, rows: DataFrame, id_col: str = "id", vector: str = "vector", force: bool = False, list_rows: int = 1_000) -> VectorIndex:
        """A new index; where there is one with vectors, ids that it lacks are added, or with ``force`` it is made anew."""
        usable = self._usable(rows, id_col, vector)
        state = self.versions.read()
        if state and state["width"] and not force:
            return self._change(state, usable.join(self.rows(state).select("id"), "id", "left_anti"), None)
        n = usable.count()
        picked = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
        width = len(picked.iloc[0]) if len(picked) else 0
        points = np.array([v for v in picked if len(v) == width])
        lists = max(1, min(MOST_LISTS, -(-n // list_rows), len(points)))
        centres = train(points, lists) if len(points) else np.zeros((1, 0))
        name = self.versions.name("centres")
        self.versions.write(self.spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(centres)], CENTRES).coalesce(1), name)
        return self._change({k: v for k, v in state.items() if k == "number"} | {"centres": name, "width": width, "segments": []}, usable, None)

    def upsert(self, rows: DataFrame, id_col: str = "id", vector: str = "vector") -> VectorIndex:
        """Vectors that are new, or take the place of those with their ids."""
        usable = self._usable(rows, id_col, vector)
        return self._change(self._state(), usable, usable.select("id"))

    def delete(self, ids: DataFrame, id_col: str = "id") -> VectorIndex:
        return self._change(self._state(), None, ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct())

    def compact(self) -> VectorIndex:
        state = self._state()
        return self._change(state | {"segments": []}, self.rows(state).select("id", "vector"), None)

    def _state(self) -> dict[str, Any]:
        state = self.versions.read()
        if not state:
            raise ValueError(f"no index in {self.versions.path}")
        return state

    @staticmethod
    def _usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
        v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null and size(vector) > 0")
        v = v.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        return v.groupBy("id").agg(F.min("vector").alias("vector"))

    def centres(self, state: dict[str, Any]) -> np.ndarray:
        """At most ``MOST_LISTS`` rows."""
        return np.array([r["vector"] for r in self.versions.table(state["centres"], CENTRES).orderBy("list").collect()])

    def _change(self, state: dict[str, Any], rows: DataFrame | None, gone: DataFrame | None) -> VectorIndex:
        v, names = self.versions, {}
        if gone is not None:
            names["gone"] = v.name("gone")
            v.write(gone, names["gone"])
            names["n_gone"] = v.table(names["gone"], GONE).count()
        if rows is not None:
            centres, width = self.centres(state), state["width"]

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    if not len(f):
                        continue
                    if any(len(x) != width for x in f["vector"]):
                        raise ValueError(f"all vectors of the index have {width} components")
                    x = np.stack(f["vector"].to_numpy())
                    own = nearest_of(x, centres)
                    yield pd.DataFrame({"list": own, "distance": np.sqrt(np.square(x - centres[own]).sum(1)), "id": f["id"], "vector": f["vector"]})

            placed = rows.select("id", "vector").mapInPandas(run, VECTORS)
            names["vectors"], names["lists"] = v.name("vectors"), v.name("lists")
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            v.write(placed.repartitionByRange(parts, "list", "distance", "id").sortWithinPartitions("list", "distance", "id"), names["vectors"])
            held = v.table(names["vectors"], VECTORS).groupBy("list").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
            v.write(held.coalesce(1), names["lists"])
        v.commit(state | {"segments": [*state["segments"], names]})
        return self

    # --- reading ---------------------------------------------------------------------

    def rows(self, state: dict[str, Any] | None = None) -> DataFrame:
        """(list, distance, id, vector) of what is there."""
        state = state or self._state()
        parts = []
        for i, names in enumerate(state["segments"]):
            if "vectors" not in names:
                continue
            part = self.versions.table(names["vectors"], VECTORS)
            for later in state["segments"][i + 1 :]:
                if later.get("n_gone"):
                    ids = self.versions.table(later["gone"], GONE)
                    part = part.join(F.broadcast(ids) if later["n_gone"] <= MOST_BROADCAST else ids, "id", "left_anti").select("list", "distance", "id", "vector")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], VECTORS)

    def info(self) -> DataFrame:
        """(vectors, width, lists, segments): what a caller sees of the index."""
        state = self._state()
        return self.rows(state).agg(F.count("*").alias("vectors")).select("vectors", F.lit(state["width"]).alias("width"), F.lit(len(self.centres(state))).alias("lists"), F.lit(len(state["segments"])).alias("segments"))

    def nearest(self, queries: DataFrame, k: int, where: DataFrame | None = None, lists: int | None = None, leave_out_own: bool = False) -> DataFrame:
        """(query_id, rank, id, distance): the ``k`` nearest rows of each query (query_id, query), ties by id.

        ``where`` holds the ids that may be found; ``lists`` reads only so many of
        the nearest lists; ``leave_out_own`` finds no row under the query's own id.
        """
        state = self._state()
        found = lambda df: df.filter("query_id <> id") if leave_out_own else df
        want = k + 1 if leave_out_own else k
        rows = self.rows(state)
        if where is not None:
            rows = rows.join(where.select(F.col(where.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi").select("list", "distance", "id", "vector")
        sizes = [self.versions.table(s["lists"], LISTS) for s in state["segments"] if "lists" in s]
        if not sizes:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, distance double")
        if where is None:
            lengths = reduce(DataFrame.unionByName, sizes).groupBy("list").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        else:
            lengths = rows.groupBy("list").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
        table = {r["list"]: r for r in lengths.collect()}  # a row for each list
        if not table:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, distance double")
        centres = self.centres(state)
        n = np.array([table[i]["n"] if i in table else 0 for i in range(len(centres))])
        least = np.array([table[i]["least"] if i in table else np.inf for i in range(len(centres))])
        most = np.array([table[i]["most"] if i in table else -np.inf for i in range(len(centres))])
        run = runs_of(n)
        held = self.spark.createDataFrame([(i, int(r), int(m)) for i, (r, m) in enumerate(zip(run, n))], "list int, run int, n long")
        rows, lengths = rows.join(F.broadcast(held.select("list", "run")), "list"), held.groupBy("run").agg(F.sum("n").alias("n"))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
        step = max(1, HELD // len(centres))

        def some(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
            """Few queries at once, with their distances to the centres and their nearest lists: ``lists`` of them, or as many as hold ``want`` rows."""
            for f in frames:
                for i in range(0, len(f), step):
                    part = f.iloc[i : i + step]
                    d = distances(np.stack(part["query"].to_numpy()), centres)
                    order = np.argsort(np.where(n > 0, d, np.inf), axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    take = np.zeros(d.shape, bool)
                    np.put_along_axis(take, order, np.broadcast_to(np.arange(len(centres)) < lists, d.shape) if lists else before < want, 1)
                    yield part, d, take & (n > 0)

        def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, _, take in some(frames):
                yield sent(part, take, run, np.full(len(part), np.inf))

        def search(asked: DataFrame) -> DataFrame:
            here, there = blocks_of(rows, asked, lengths, ["list", "id", "vector"])
            key = ["run", "rb", "qb"]
            return here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(lambda a, b: meet(a, b, want), FOUND)

        by = Window.partitionBy("query_id").orderBy("distance", "id")
        best = lambda df: df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        near = best(found(search(asked.mapInPandas(first, ASKED))))
        if lists is None:
            name = self.versions.name("found")
            self.versions.write(near, name)  # read twice below
            near = self.versions.table(name, f"{FOUND}, rank int")
            bound = near.groupBy("query_id").agg(F.count("*").alias("held"), F.max("distance").alias("far"))
            open_ = asked.join(bound, "query_id", "left").withColumn("within", F.when(F.col("held") >= k, F.col("far")).otherwise(F.lit(float("inf"))))

            def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                """Of the lists that were not read, those that can hold a nearer row."""
                for part, d, read in some(frames):
                    within = part["within"].to_numpy()
                    bound = within[:, None] + 1e-9 * (1 + d)
                    yield sent(part, ~read & (n > 0) & (d - most <= bound) & (least - d <= bound), run, within)

            more = found(search(open_.select("query_id", "query", "within").mapInPandas(rest, ASKED)))
            near = best(near.select("query_id", "id", "distance").unionByName(more.select("query_id", "id", "distance")))
        return near.select("query_id", "rank", "id", "distance")
