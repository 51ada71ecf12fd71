"""A full-text index as tables: postings with places, lengths, and bounds by block.

``postings`` has a row for each word of each text, in folders by a hash of the word,
so that a query reads its words' folders and, by the files' statistics, little else:
a task makes the postings of some texts and sorts its files by word and block, so
texts are exchanged and their words are not.  A block holds texts of about one length;
``blocks`` has, for each word and block, how many texts hold the word, the most often
and the shortest.  No text of a block scores above what follows from these, so a
search for the best texts leaves out blocks that cannot reach them.

A change adds a segment: new texts, and the ids that it takes the place of in the
segments before it.  ``compact`` makes one segment of all.  Every state is whole
(``sources.versions``).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.sources.versions import Versions

TEXTS = "id long, text string, n int, block int"
POSTINGS = "bucket int, term string, block int, id long, n int, tf int, positions array<int>"
BLOCKS = "bucket int, term string, block int, docs long, most int, shortest int"
GONE = "id long"

#: bands of text length, half a power of two wide each
BANDS = 32
#: rows of a table of ids that is broadcast
MOST_BROADCAST = 200_000
#: words of the texts of one task, whose places it sorts in memory, and bytes of the texts
TASK_WORDS, TASK_BYTES = 4_000_000, 32 << 20
#: words that are grouped at once
SLICE_WORDS = 500_000


def places(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, n, block, words) to postings, those of a slice of texts in the order of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
            row = 0
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_WORDS, side="right")))
                yield _sorted_places(batch.slice(row, end - row), buckets)
                row = end

    return run


def _sorted_places(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    ids, n, block = (batch.column(i).to_numpy() for i in range(3))
    lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
    words = batch.column(3).flatten().dictionary_encode()
    bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words.dictionary.to_pylist()], np.int32)
    by_term, by_text = np.empty(len(bucket), np.int64), np.lexsort((ids, block))
    by_term[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(bucket))
    terms = np.lexsort((by_term, bucket))
    rank, place = np.empty(len(terms), np.int64), np.empty(len(ids), np.int64)
    rank[terms], place[by_text] = np.arange(len(terms)), np.arange(len(ids))
    key = rank[words.indices.to_numpy()] * len(ids) + np.repeat(place, lengths)
    order = np.argsort(key, kind="stable")  # places of a word in a text stay in order
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    term, text = terms[key[first] // len(ids)], by_text[key[first] % len(ids)]
    at = (np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)[order]
    tf = np.diff(np.append(first, len(key))).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(at))
    columns = [pa.array(bucket[term]), words.dictionary.take(pa.array(term)), pa.array(block[text]), pa.array(ids[text]), pa.array(n[text]), pa.array(tf), positions]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "block", "id", "n", "tf", "positions"])


@dataclass
class Query:
    """A request: its mode, its words, and what one text must fulfil."""

    mode: str
    terms: list[str]

    @property
    def distinct(self) -> list[str]:
        return list(dict.fromkeys(self.terms))


class TextIndex:
    """An index in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.versions = Versions(spark, path)

    # --- writing ---------------------------------------------------------------------

    def create(self, docs: DataFrame, id_col: str = "id", text: str = "text", stemmed: bool = False, buckets: int = 64, block_docs: int = 100_000) -> TextIndex:
        """A new index over ``docs``; one that is there is replaced.

        Ids are distinct and not null, or an error is raised; a null text is empty.
        """
        rows = self._texts(docs, id_col, text)
        state = {k: v for k, v in self.versions.read().items() if k == "number"}
        size = rows.count()
        state |= {"stemmed": stemmed, "buckets": buckets, "parts": max(1, min(128, size // block_docs)), "segments": [], "docs": 0, "words": 0}
        self.versions.commit(self._segment(state, rows, None))
        return self

    def upsert(self, docs: DataFrame, id_col: str = "id", text: str = "text") -> TextIndex:
        """Texts that are new, or take the place of those with their ids."""
        state = self._state()
        rows = self._texts(docs, id_col, text)
        self.versions.commit(self._segment(state, rows, rows.select("id")))
        return self

    def delete(self, ids: DataFrame, id_col: str = "id") -> TextIndex:
        state = self._state()
        gone = ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
        self.versions.commit(self._segment(state, None, gone))
        return self

    def compact(self) -> TextIndex:
        """One segment of what is there; earlier tables stay until ``versions.sweep()``."""
        state = self._state()
        rows = self.texts().select("id", "text")
        self.versions.commit(self._segment(state | {"segments": [], "docs": 0, "words": 0}, rows, None))
        return self

    def _state(self) -> dict[str, Any]:
        state = self.versions.read()
        if not state:
            raise ValueError(f"no index in {self.versions.path}")
        return state

    @staticmethod
    def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        if not rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
            raise ValueError("ids of texts are distinct and not null")
        return rows

    def _words(self, state: dict[str, Any], c: Column) -> Column:
        words = X.tokens(c)
        return F.transform(words, lambda w: X.stem(w)) if state["stemmed"] else words

    def _segment(self, state: dict[str, Any], rows: DataFrame | None, gone: DataFrame | None) -> dict[str, Any]:
        """The state with one more segment."""
        v = self.versions
        names = {}
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bucket = (F.crc32(F.col("term").cast("binary")) % state["buckets"]).cast("int").alias("bucket")
        lost = None
        if gone is not None:
            names["gone"] = v.name("gone")
            v.write(gone, names["gone"])
            gone = v.table(names["gone"], GONE)
            names["n_gone"] = gone.count()
            old = self.texts(state).join(self._small(gone, names["n_gone"]), "id")
            # words of texts that go no longer count in their blocks
            lost = old.select("block", F.explode(F.array_distinct(self._words(state, F.col("text")))).alias("term"))
            lost = lost.select("term", "block", F.lit(-1).cast("long").alias("docs"), F.lit(0).alias("most"), F.lit(None).cast("int").alias("shortest"))
            went = old.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            state = state | {"docs": state["docs"] - went[0], "words": state["words"] - went[1]}
        blocks = lost
        if rows is not None:
            names["texts"], names["postings"] = v.name("texts"), v.name("postings")
            n = F.size(self._words(state, F.col("text")))
            band = F.least(F.lit(BANDS - 1), F.floor(2 * F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int"))
            part = F.pmod(F.hash("id"), F.lit(state["parts"]))
            size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
            ranges = max(parts, -(-size // TASK_BYTES))
            # words are counted after the exchange, not for its sample too
            laid = rows.repartitionByRange(ranges, "id").withColumn("n", n).withColumn("block", band * state["parts"] + part)
            v.write(laid.sortWithinPartitions("id"), names["texts"])
            texts = v.table(names["texts"], TEXTS)
            total = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            state = state | {"docs": state["docs"] + total[0], "words": state["words"] + total[1]}
            # few tasks hold texts of one block
            dealt = texts.repartition(self._tasks(total[1], parts, state["parts"]), "id")
            made = dealt.select("id", "n", "block", self._words(state, F.col("text")).alias("words")).mapInArrow(places(state["buckets"]), POSTINGS)
            v.write(made.sortWithinPartitions("bucket", "term", "block", "id"), names["postings"], "bucket")
            held = v.table(names["postings"], POSTINGS).select("term", "block", F.lit(1).cast("long").alias("docs"), F.col("tf").alias("most"), F.col("n").alias("shortest"))
            blocks = held if blocks is None else held.unionByName(blocks)
        if blocks is not None:
            names["blocks"] = v.name("blocks")
            summed = blocks.groupBy("term", "block").agg(F.sum("docs").alias("docs"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
            v.write(summed.withColumn("bucket", bucket).repartitionByRange(parts, "bucket", "term").sortWithinPartitions("bucket", "term", "block"), names["blocks"], "bucket")
        return state | {"segments": [*state["segments"], names]}

    @staticmethod
    def _tasks(words: int, parts: int, block_parts: int) -> int:
        """Tasks that make the postings of texts with so many words: of bounded size, and of small texts not too many files."""
        n = max(-(-words // TASK_WORDS), min(parts, -(-words // (TASK_WORDS // 4))), 1)
        return n if n < block_parts else -(-n // block_parts) * block_parts

    # --- reading ---------------------------------------------------------------------

    @staticmethod
    def _small(ids: DataFrame, n: int) -> DataFrame:
        return F.broadcast(ids) if n <= MOST_BROADCAST else ids

    def _live(self, state: dict[str, Any], kind: str, schema: str, where: Column | None = None) -> DataFrame:
        """Rows of all segments without those whose ids a later segment replaced."""
        parts = []
        for i, names in enumerate(state["segments"]):
            if kind not in names:
                continue
            rows = self.versions.table(names[kind], schema)
            rows = rows if where is None else rows.filter(where)
            for later in state["segments"][i + 1 :]:
                if later.get("n_gone"):
                    rows = rows.join(self._small(self.versions.table(later["gone"], GONE), later["n_gone"]), "id", "left_anti")
            parts.append(rows)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def texts(self, state: dict[str, Any] | None = None) -> DataFrame:
        """(id, text, n, block) of the texts that are there."""
        return self._live(state or self._state(), "texts", TEXTS)

    def _in_words(self, state: dict[str, Any], terms: list[str]) -> Column:
        buckets = sorted({zlib.crc32(t.encode()) % state["buckets"] for t in terms})
        return F.col("bucket").isin(buckets) & F.col("term").isin(terms)

    def postings(self, terms: list[str], blocks: list[int] | None = None) -> DataFrame:
        """The postings of some words, in some blocks."""
        state = self._state()
        where = self._in_words(state, terms)
        return self._live(state, "postings", POSTINGS, where if blocks is None else where & F.col("block").isin(blocks))

    def _bounds(self, state: dict[str, Any], terms: list[str]) -> dict[tuple[str, int], tuple[int, int, int]]:
        """(texts, most, shortest) by word and block; at most a row for each of a query's words and blocks."""
        parts = [self.versions.table(s["blocks"], BLOCKS).filter(self._in_words(state, terms)) for s in state["segments"] if "blocks" in s]
        rows = reduce(DataFrame.unionByName, parts).groupBy("term", "block").agg(F.sum("docs").alias("docs"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        return {(r["term"], r["block"]): (r["docs"], r["most"], r["shortest"]) for r in rows.collect()}

    def query(self, raw: str) -> Query:
        mode, terms = X.query_mode(raw)
        words = [w for t in terms for w in re.split(r"[\W_]+", t) if w]
        return Query(mode, [X.stem_word(w) for w in words] if self._state()["stemmed"] else words)

    def matches(self, q: Query, state: dict[str, Any], df: dict[str, int], blocks: list[int] | None) -> DataFrame:
        """(id, n, score) of every text in the blocks that fulfils the query."""
        terms = q.distinct
        mean = state["words"] / state["docs"] if state["docs"] else 0.0
        one = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
        columns = [F.coalesce(one(t, "tf"), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
        phrase = q.mode == "phrase" and len(q.terms) > 1
        if phrase:
            columns += [one(t, "positions").alias(f"at{i}") for i, t in enumerate(terms)]
        by = self.postings(terms, blocks).groupBy("id").agg(F.first("n").alias("n"), *columns)
        held = reduce(or_ if q.mode == "or" else and_, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
        rows = by.filter(held)
        if phrase:
            first = lambda i, t: F.transform(f"at{terms.index(t)}", lambda p: p - i)  # noqa: E731  where the phrase would begin
            rows = rows.filter(F.size(reduce(F.array_intersect, [first(i, t) for i, t in enumerate(q.terms)])) > 0)
        idf = lambda t: F.log(F.lit(1 + (state["docs"] - df[t] + 0.5) / (df[t] + 0.5)))
        tf = {t: F.col(f"tf{i}") for i, t in enumerate(terms)}
        part = [idf(t) * tf[t] * (X.K1 + 1) / (tf[t] + X.K1 * (1 - X.B + X.B * F.col("n") / F.lit(mean))) for t in q.terms]
        return rows.select("id", "n", reduce(lambda a, b: a + b, part).alias("score"))

    def reach(self, q: Query, state: dict[str, Any], bounds: dict[tuple[str, int], tuple[int, int, int]], df: dict[str, int]) -> dict[int, float]:
        """For each block that can hold a match, a score that none of its texts exceeds."""
        mean = state["words"] / state["docs"]
        out: dict[int, float] = {}
        for block in {b for _, b in bounds}:
            held = [t for t in q.distinct if bounds.get((t, block), (0,))[0] > 0]
            if not held or (q.mode != "or" and len(held) < len(q.distinct)):
                continue
            out[block] = 0.0
            for t in (t for t in q.terms if t in held):
                _, most, shortest = bounds[t, block]
                idf = math.log(1 + (state["docs"] - df[t] + 0.5) / (df[t] + 0.5))
                out[block] += idf * most * (X.K1 + 1) / (most + X.K1 * (1 - X.B + X.B * shortest / mean))
        return out

    def plan(self, raw: str, k: int | None) -> tuple[Query, dict[str, Any], dict[str, int], list[int] | None]:
        """The query with its words' counts and the blocks to read: for the ``k`` best matches those that can hold one, or for all of them.

        The blocks that reach highest are searched first; what the ``k``-th match in
        them scores, any other block must reach.
        """
        state, q = self._state(), self.query(raw)
        if not q.terms or not state["docs"]:
            return q, state, {}, []
        bounds = self._bounds(state, q.distinct)
        df = {t: sum(x[0] for (w, _), x in bounds.items() if w == t) for t in q.distinct}
        able = self.reach(q, state, bounds, df)
        if k is None or not able:
            return q, state, df, sorted(able)
        order = sorted(able, key=lambda b: -able[b])
        first, seen = [], 0
        for b in order:
            first.append(b)
            seen += min(bounds[t, b][0] for t in q.distinct if bounds.get((t, b), (0,))[0] > 0)
            if seen >= 2 * k:
                break
        if len(first) == len(order):
            return q, state, df, sorted(order)
        found = self.matches(q, state, df, first).orderBy(F.desc("score")).select("score").limit(k).collect()
        least = found[-1]["score"] if len(found) == k else -math.inf
        return q, state, df, sorted({*first, *(b for b in order if able[b] * (1 + 1e-9) >= least)})

    def search(self, raw: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """(id, score) of the best matches, ties by id; only blocks that can hold one are read."""
        q, state, df, blocks = self.plan(raw, limit + offset)
        if not blocks:
            return self.spark.createDataFrame([], "id long, score double")
        return self.matches(q, state, df, blocks).select("id", "score").orderBy(F.desc("score"), "id").offset(offset).limit(limit)

    def count(self, raw: str) -> int:
        """The number of texts that match."""
        q, state, df, blocks = self.plan(raw, None)
        if len(q.distinct) == 1 and (q.mode != "phrase" or len(q.terms) == 1):
            return df.get(q.distinct[0], 0)
        return self.matches(q, state, df, blocks).count() if blocks else 0

    def find(self, raw: str, limit: int = 20, offset: int = 0, around: int = 32) -> DataFrame:
        """(id, rank, score, snippet, char_offset, char_end, total) of the best matches.

        Where no text matches by words, texts that hold the request as characters
        follow in order of id, with score 0.  At most ``limit`` texts are read.
        """
        total = self.count(raw)
        if not total:
            return self._by_characters(raw, limit, offset, around)
        top = self.search(raw, limit, offset).collect()
        ranked = self.spark.createDataFrame([(offset + i + 1, r["id"], r["score"]) for i, r in enumerate(top)], "rank long, id long, score double")
        read = self._live(self._state(), "texts", TEXTS, F.col("id").isin([r["id"] for r in top]))
        hits = read.join(F.broadcast(ranked), "id")
        return self._marked(hits, pattern(self.query(raw), self._state()["stemmed"]), around).withColumn("total", F.lit(total).cast("long"))

    def _by_characters(self, raw: str, limit: int, offset: int, around: int) -> DataFrame:
        needle = raw.strip().strip("\"'").lower()
        low = F.lower("text")
        hits = self.texts().filter(F.contains(low, F.lit(needle)) & F.lit(bool(needle)))
        total = hits.count()
        top = hits.orderBy("id").offset(offset).limit(limit).select("id").collect()
        ranked = self.spark.createDataFrame([(offset + i + 1, r["id"], 0.0) for i, r in enumerate(top)], "rank long, id long, score double")
        read = self._live(self._state(), "texts", TEXTS, F.col("id").isin([r["id"] for r in top])).join(F.broadcast(ranked), "id")
        return self._marked(read, f"()({re.escape(needle)})()", around).withColumn("total", F.lit(total).cast("long"))

    @staticmethod
    def _marked(hits: DataFrame, regex: str, around: int) -> DataFrame:
        """The first place of a match, marked, with text around it."""
        rows = hits.withColumn("edge", F.regexp_extract("text", f"(?iu){regex}", 1)).withColumn("hit", F.regexp_extract("text", f"(?iu){regex}", 2))
        at = F.length(F.get(F.split("text", f"(?iu){regex}", 2), F.lit(0))) + F.length("edge") + 1
        rows = rows.withColumn("at", at).withColumn("end", F.col("at") + F.length("hit"))
        start = F.greatest(F.lit(1), F.col("at") - around)
        body = F.concat(F.substring(F.col("text"), start, F.col("at") - start), F.lit(X.MARK[0]), F.col("hit"), F.lit(X.MARK[1]), F.substring(F.col("text"), F.col("end"), F.lit(around)))
        cut = F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(F.col("end") + around <= F.length("text"), "...").otherwise(""))
        return rows.select("id", "rank", "score", F.when(F.col("hit") != "", cut).alias("snippet"), F.when(F.col("hit") != "", F.col("at") - 1).cast("long").alias("char_offset"), F.when(F.col("hit") != "", F.col("end") - 1).cast("long").alias("char_end"))


def pattern(q: Query, stemmed: bool) -> str:
    """A pattern of three groups, of which the second is a match's characters: the phrase, or any of the words."""
    word = lambda t: re.escape(t) + (r"\p{L}*" if stemmed else "")
    body = r"[^\p{L}\p{N}]+".join(word(t) for t in q.terms) if q.mode == "phrase" else "|".join(word(t) for t in q.terms)
    return rf"(^|[^\p{{L}}\p{{N}}])({body})($|[^\p{{L}}\p{{N}}])"
