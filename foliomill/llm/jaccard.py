"""Documents whose word-shingle sets overlap: exact links, link counts and components.

Method: size-banded tiles with hashed bitmap signatures.  A document's set is
held as sorted 64-bit shingle hashes.  Equal sets are one class, and a class is
one node, so copies cost one comparison.  Sizes fall into geometric bands; a tile
joins a band with the sizes above it that can still reach the threshold.

Within a tile, the hash space is cut into segments.  Two sets that reach the
threshold differ in at most K shingles (K follows from the tile's sizes), so of
K + 1 + x segments at least x + 1 are equal.  A set's keys are the hashes of its
segments.  Of each set's keys in a tile the x that most sets have are left out
(equal counts by key, so all sets go by one order): two sets that reach the
threshold have x + 1 keys in common, and the rarest of these has x common ones
after it, so neither leaves it out.  Whatever pair links shares a key that both
keep.  Sets that meet by chance, in an empty segment or in one or two shingles of
a common passage, seldom do so more than x times, and are not compared.  Keys with
the same members count once.  Only a part of the keys (of ``PARTS``) is exchanged
at a time; what is kept of it is the keys that several sets have.

Bit counts of two bitmap signatures bound the overlap from above.  The members of
a key that the bound leaves in reach of each other form a graph; its task sends a
spanning forest of that graph, at most one edge less than it has members, never
the pairs.  Components of all forests are the candidate clusters: every link lies
inside one, and a node is in one only, so its sorted array moves once.  In a
cluster the exact intersections of all pairs are counted at once as a product of
incidence matrices, and again only a spanning forest of the links leaves the
task, with each node's number of links.  No link is lost; none is inferred.

Hot groups: a key or cluster of more than ``BLOCK`` members is dealt in blocks.
First every block with the group's first member; then, only where the group is
still in several components, the members outside its largest component against
all others.  Link counts compare all pairs of blocks instead: rows then grow with
n * n / BLOCK for a group of n different near copies, which no exact count avoids.

Components come from large-star and small-star steps, all as joins.

Defined results: a null or empty text has no shingles, links with nothing and is
its own component; a row without a doc_id likewise, with a null component (in
``keep_one`` such rows are grouped by their text); repeated rows are reported each;
rows that repeat a doc_id with other text all count and share its component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as V
from .store import drop, materialize, small

#: members of one block of a hot group, and the bytes of their arrays
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: columns of an incidence matrix that are multiplied at once
COLUMNS = 4096
BAND_RATIO = 1.4
BITS_PER_SHINGLE = 2
#: segments differ at most so many times for each one that is to spare beyond the first
PER_SPARE = 16
#: keys hold their band in so many low bits; parts in which keys are exchanged
BAND_BITS, PARTS = 7, 3
MAX_BITS = 1 << 14


def _bands() -> list[int]:
    """Largest size of each band."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
    return tops


TOPS = np.array(_bands())


def most_apart(band: int, percent: int) -> int:
    """Shingles in which two sets of a tile may differ and reach the threshold."""
    top = int(TOPS[band])
    return (top + top * 100 // percent) * (100 - percent) // (100 + percent)


def spare(band: int, percent: int) -> int:
    """Keys that each set of a tile leaves out, or 0 where only equal sets reach the threshold."""
    most = most_apart(band, percent)
    return 1 + most // PER_SPARE if most else 0


def segments(band: int, percent: int) -> int:
    """Segments of a tile, or 0 where only equal sets reach the threshold."""
    extra = spare(band, percent)
    return most_apart(band, percent) + 1 + extra if extra else 0


def tiles(n: int, percent: int) -> list[int]:
    """Tiles of a set of ``n`` shingles: its own band, and lower ones within reach."""
    own = int(np.searchsorted(TOPS, n))
    out, b = [own], own - 1
    while b >= 0 and int(TOPS[b]) * 100 >= n * percent:
        out.append(b)
        b -= 1
    return out


def segment_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set (sorted, distinct hashes): one for each segment of its tiles, with the band in its low bits."""
    keys = []
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(V.mix64(h + np.uint64(0x51ED270B)), out=sums[1:])
    for band in tiles(len(h), percent):
        if not (m := segments(band, percent)):
            continue
        edges = np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)
        at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        sizes = np.diff(at)
        total = sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64)
        place = V.mix64(np.arange(m, dtype=np.uint64) + np.uint64(band * 0x1000003D + 1))
        keys.append(V.mix64(total ^ place) >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.uint64(band))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bitmap signature; its length is a power of two set by the size."""
    bits = 64
    while bits < BITS_PER_SHINGLE * len(h) and bits < MAX_BITS:
        bits *= 2
    words = np.zeros(bits // 64, np.uint64)
    at = V.mix64(h ^ np.uint64(0x2545F491)) & np.uint64(bits - 1)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A longer bitmap cut down to ``size`` words; bit positions agree modulo its length."""
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """The intersection is at most this: each bit of one that the other lacks is a missing shingle."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def reaches(common: int, na: int, nb: int, percent: int) -> bool:
    return 100 * common >= percent * (na + nb - common)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words split at white space, A-Z lower-cased."""
    buf, off = V.text_buffers(column)
    for a, b in V.slices(off):
        part, at = V.LOWER[buf[off[a] : off[b]]], off[a : b + 1] - off[a]
        starts, ends, first = V.word_spans(part, at, V.WHITE)
        words = V.word_hashes(part, starts, ends)
        for i, j in zip(first[:-1], first[1:]):
            yield np.unique(V.shingle_hashes(words[i:j], k))


ROW = "uid long, doc_id long, tag long, n_shingles long, s1 long, s2 long"
CLASS = ["n_shingles", "s1", "s2"]


def _sums(h: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums that tell sets apart."""
    return V.mix64(h + np.uint64(1)).sum(dtype=np.uint64), V.mix64(h + np.uint64(2)).sum(dtype=np.uint64)


def signatures(docs: DataFrame, k: int, percent: int, tag: Column) -> DataFrame:
    """A row for each row of ``docs``: a number, the class of its set, keys and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, keys, bits = [], [], [], [], []
            for h in shingle_sets(batch.column(3), k):
                n.append(len(h))
                a, b = _sums(h)
                s1.append(a)
                s2.append(b)
                keys.append(segment_keys(h, percent).view(np.int64))
                bits.append(bitmap(h).tobytes() if len(h) else b"")
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), *sums, pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(bits, pa.binary())],
                names=["uid", "doc_id", "tag", *CLASS, "keys", "bits"],
            )

    chosen = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, f"{ROW}, keys array<long>, bits binary")


def shared_keys(reps: DataFrame, part: int) -> DataFrame:
    """(g, node, n): one part of the keys that ``n`` > 1 nodes have."""
    keys = reps.select("node", F.explode("keys").alias("g")).filter(F.pmod(F.shiftright("g", BAND_BITS), F.lit(PARTS)) == part)
    # keys move once, as two longs: the grouping reads nodes too, else they would be exchanged again without them
    keys = keys.repartition("g")
    shared = keys.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    return keys.join(shared.select("g", "n"), "g")


def rarest(filed: DataFrame, percent: int) -> DataFrame:
    """(g, node) of ``filed`` without the commonest keys of each node in each band."""
    extra = F.array(*[F.lit(spare(band, percent)) for band in range(len(TOPS))])
    band = F.col("g").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    order = Window.partitionBy("node", "band").orderBy(F.desc("n"), "g")
    ranked = filed.withColumn("band", band).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") > F.element_at(extra, F.col("band") + 1)).select("g", "node")


def met(filed: DataFrame, percent: int) -> DataFrame:
    """Groups (g, node, first, blocks, size) of the nodes that keep a key; keys with the same members count once."""
    kept = rarest(filed, percent).repartition("g")
    digest = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    groups = kept.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), digest.alias("members")).filter("n > 1")
    once = groups.groupBy("n", "members").agg(F.min("g").alias("g"), F.min("first").alias("first"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return kept.join(once, "g").select("g", "node", "first", blocks.alias("blocks"), F.lit(0).cast("long").alias("size"))


def _settled(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); the component is its smallest node."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = _settled(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e, old = materialize(small, "edges"), e
        drop(old)
        if (now := _settled(e)) == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# --- tiles: groups of members in blocks that fit a task ------------------------------------

TILE = ["g", "i", "j", "block", "known", "node"]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (g, i, j) in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and [held[0].column(c)[0] for c in range(3)] != [part.column(c)[0] for c in range(3)]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def words_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit words of a binary column, and where each row's begin."""
    buf, off = V.text_buffers(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(buf[off[0] : off[-1]].tobytes(), np.uint64), (off - off[0]) // 8


def spanning_forest(known: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (of positions) that join what ``near`` joins; members of one ``known`` component are joined already."""
    left, edges = np.arange(len(known)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            same = known[left] == known[x]
            hit = same.copy()
            if not same.all():
                hit[~same] = near(x, left[~same])
            edges += [(x, int(y)) for y in left[hit & ~same]]
            queue += left[hit].tolist()
            left = left[~hit]
    return edges


def bounded_near(table: pa.Table, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether bit counts leave the threshold in reach, for one member against others."""
    flat, at = words_of(table.column("bits"))
    lengths, n = np.diff(at), table.column("n_shingles").to_numpy()
    size = int(lengths.min())
    rows = np.empty((len(n), size), np.uint64)
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        cells = flat[at[which][:, None] + np.arange(length)]
        rows[which] = np.bitwise_or.reduce(cells.reshape(len(which), length // size, size), axis=1)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        a, b = rows[x], rows[others]
        bound = np.minimum(n[x] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), n[others] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
        return 100 * bound >= percent * (n[x] + n[others] - bound)

    return near


def intersections(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many elements each two of the sets have in common; the diagonal is not meant."""
    n = len(at) - 1
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[shared]]
    row = np.repeat(np.arange(n), np.diff(at))[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n))
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        cells = np.zeros((n, min(COLUMNS, total - a)), np.float32)
        cells[row[part], column[part] - a] = 1
        common += cells @ cells.T
    return common.astype(np.int64)


def linked(table: pa.Table, percent: int) -> np.ndarray:
    """The links between members of a tile, as a square of booleans."""
    flat, at = words_of(table.column("h"))
    n = np.diff(at)
    common = intersections(flat, at)
    out = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(out, False)
    return out


def _tile(members: DataFrame, payload: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Members with their payload, one (g, i, j) after the other in a task."""
    ready = members.join(payload, "node").select(*TILE, *[c for c in payload.columns if c != "node"])
    return ready.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node").mapInArrow(run, schema)


def forests(members: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests of what is near (payload ``bits``) or linked (payload ``h``) in each tile."""
    exact = "h" in payload.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches):
            if exact:
                links = linked(t, percent)
                near = lambda x, others: links[x][others]
            else:
                near = bounded_near(t, percent)
            edges = np.array(spanning_forest(t.column("known").to_numpy(), near), np.int64).reshape(-1, 2)
            nodes = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[edges[:, 0]]), pa.array(nodes[edges[:, 1]])], names=["a", "b"])

    return _tile(members, payload, run, "a long, b long").distinct()


def _block(n: Column) -> Column:
    """A member's block of ``n``."""
    return F.pmod(F.xxhash64("node"), n).cast("int")


def first_round(members: DataFrame) -> DataFrame:
    """Tiles of (g, node, blocks, first): a group's blocks, each with its first member."""
    alone = members.filter("blocks = 1").select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), F.col("node").alias("known"), "node")
    hot = members.filter("blocks > 1")
    parts = hot.withColumn("block", _block(F.col("blocks")))
    firsts = hot.select("g", "blocks", F.col("first").alias("node")).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = parts.select("g", "block", "node").unionByName(firsts.select("g", "block", "node")).distinct()
    return alone.unionByName(dealt.select("g", F.col("block").alias("i"), F.col("block").alias("j"), "block", F.col("node").alias("known"), "node"))


def second_round(members: DataFrame, found: DataFrame) -> DataFrame:
    """Tiles of hot groups that are still in several components: those outside the largest against all."""
    hot = members.filter("blocks > 1").select("g", "node", "size").join(found, "node", "left").withColumn("known", F.coalesce("component", "node"))
    kinds = hot.groupBy("g", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    of = kinds.groupBy("g").agg(F.max(F.struct("n", "known")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("size", F.struct("n", "known")).alias("top_size")).filter("top.n < n")
    count = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    of = of.select("g", F.col("top.known").alias("main"), count(F.col("top.n"), F.col("top_size")).alias("mains"), count(F.col("n") - F.col("top.n"), F.col("size") - F.col("top_size")).alias("others"))
    placed = hot.join(of, "g").withColumn("main", F.col("known") == F.col("main"))
    block = F.when(F.col("main"), F.col("others") + _block(F.col("mains"))).otherwise(_block(F.col("others")))
    placed = placed.withColumn("block", block.cast("int"))
    # blocks of others come first: (i, j) with i among them, and i <= j
    low = F.sequence(F.lit(0), F.col("others") - 1)
    met = F.when(F.col("main"), F.transform(low, lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    )
    return placed.select("g", F.explode(met).alias("p"), "block", "known", "node").select("g", "p.i", "p.j", "block", "known", "node")


def all_rounds(members: DataFrame) -> DataFrame:
    """Tiles of every two blocks of each group."""
    placed = members.withColumn("block", _block(F.col("blocks")))
    met = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    return placed.select("g", F.explode(met).alias("p"), "block", F.col("node").alias("known"), "node").select("g", "p.i", "p.j", "block", "known", "node")


def joined(members: DataFrame, payload: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) over all groups, or None if nothing joins."""
    edges = materialize(forests(first_round(members), payload, percent), "forest")
    hot = not members.filter("blocks > 1").isEmpty()
    if edges.isEmpty() and not hot:
        return None
    found = components(edges)
    if hot:
        more = materialize(forests(second_round(members, found), payload, percent), "forest")
        if not more.isEmpty():
            found = components(edges.unionByName(more))
    return found


# --- candidate clusters and links -----------------------------------------------------------


class Sets:
    """Rows, classes and candidate clusters of ``docs``, as written tables."""

    def __init__(self, docs: DataFrame, k: int, percent: int, tag: Column, linking: str):
        self.docs, self.k, self.percent, self.tag = docs, k, percent, tag
        signed = materialize(signatures(docs, k, percent, tag), "signatures")
        self.rows = materialize(signed.drop("keys", "bits"), "rows")
        self.linking = f"n_shingles > 0 and {linking}"
        some = self.rows.filter(self.linking)
        self.classes = materialize(some.groupBy(*CLASS).agg(F.min("uid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
        # copies are left out of the keys
        copies = materialize(some.join(self.classes.filter("n > 1").select(*CLASS, "node"), CLASS).filter("uid <> node").select("uid"), "copies")
        reps = signed.filter(self.linking).join(small(copies), "uid", "left_anti").withColumnRenamed("uid", "node")
        filed = [materialize(shared_keys(reps, part), "filed") for part in range(PARTS)]
        held = materialize(met(reduce(DataFrame.unionByName, filed), percent), "tiles")
        for part in filed:
            drop(part)
        found = joined(held, reps.select("node", "n_shingles", "bits"), percent)
        drop(held)
        if found is None:
            found = docs.sparkSession.createDataFrame([], "node long, component long")
        # (g, node, n_shingles, doc_id, tag): the cluster, and the row that has the text
        chosen = found.join(self.rows.select(F.col("uid").alias("node"), "doc_id", "tag", "n_shingles"), "node")
        self.clusters = materialize(chosen.withColumnRenamed("component", "g"), "clusters")
        drop(copies)
        drop(signed)

    def arrays(self) -> DataFrame:
        """(node, h): the sets of all cluster members, from whole texts."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in shingle_sets(batch.column(1), k)], pa.binary())], names=["node", "h"])

        wanted = small(self.clusters.select(F.col("doc_id").alias("w_id"), F.col("tag").alias("w_tag"), "node"))
        texts = self.docs.select(F.col("doc_id").cast("long").alias("t_id"), self.tag.alias("t_tag"), F.col("text").cast("binary").alias("t"))
        same = F.col("t_id").eqNullSafe(F.col("w_id")) & (F.col("t_tag") == F.col("w_tag"))
        return materialize(texts.join(wanted, same).select("node", "t").mapInArrow(run, "node long, h binary").dropDuplicates(["node"]), "arrays")

    def members(self) -> DataFrame:
        """Cluster members with the number of their cluster's blocks."""
        per = self.clusters.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"), F.min("node").alias("first"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
        return materialize(self.clusters.select("g", "node", (F.col("n_shingles") * 8).alias("size")).join(per.select("g", "first", blocks.alias("blocks")), "g"), "members")

    def one_id(self) -> DataFrame:
        """Edges between classes that hold texts of one doc_id."""
        held = self.rows.filter(self.linking).filter("doc_id is not null").join(self.classes.select(*CLASS, "node"), CLASS).select("doc_id", "node")
        many = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
        return held.join(many, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct()

    def by_class(self, found: DataFrame | None) -> DataFrame:
        """The classes with their ``component`` (a node)."""
        if found is None:
            return self.classes.withColumn("component", F.col("node"))
        return self.classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _counted(members: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): forest edges of each tile, and as (node, node, n) the rows its links lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            block, nodes = t.column("block").to_numpy(), t.column("node").to_numpy()
            links = linked(t, percent)
            if i != j:
                links &= block[:, None] != block[None, :]
            edges = np.array(spanning_forest(nodes, lambda x, others: links[x][others]), np.int64).reshape(-1, 2)
            n = links @ t.column("weight").to_numpy()
            some = np.flatnonzero(n)
            a, b = np.concatenate([nodes[edges[:, 0]], nodes[some]]), np.concatenate([nodes[edges[:, 1]], nodes[some]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([np.zeros(len(edges), np.int64), n[some]]))], names=["a", "b", "n"])

    return _tile(members, payload, run, "a long, b long, n long")


def _by_id(sets: Sets, found: DataFrame | None) -> DataFrame | None:
    """Components after the classes of one doc_id are joined too."""
    ids = materialize(sets.one_id(), "one_id")
    if ids.isEmpty():
        return found
    return components(ids if found is None else ids.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows linked with) for every row of ``docs``."""
    sets = Sets(docs, k, percent, F.xxhash64("text"), "doc_id is not null")
    weights = sets.classes.select("node", F.col("n").alias("weight"))
    payload = sets.arrays().join(weights, "node")
    told = materialize(_counted(all_rounds(sets.members()), payload, percent), "links")
    links = told.filter("n = 0").select("a", "b")
    found = _by_id(sets, None if links.isEmpty() else components(links))
    counts = told.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = sets.by_class(found).join(counts, "node", "left")
    low = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = placed.join(low, "component").select(*CLASS, "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = sets.rows.join(of_class, CLASS, "left")
    linking = F.expr(sets.linking)
    return out.select("doc_id", "n_shingles", F.when(linking, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linking, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"))


def class_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(a, b), every two linked classes of different sets, and (cls, doc_id), their members."""
    sets = Sets(docs, k, percent, F.xxhash64("text"), "doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches):
            block, nodes = t.column("block").to_numpy(), t.column("node").to_numpy()
            links = np.triu(linked(t, percent))
            if t.column("i")[0] != t.column("j")[0]:
                links &= block[:, None] != block[None, :]
            a, b = np.nonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    links = _tile(all_rounds(sets.members()), sets.arrays(), run, "a long, b long")
    members = sets.rows.filter(sets.linking).join(sets.classes.select(*CLASS, "node"), CLASS)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), members.select(F.col("node").alias("cls"), "doc_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id's (rows without one come last).

    Rows without words are kept.  Equal rows are told apart by nothing: one stays.
    Here rows of one doc_id with different texts are different documents.
    """
    tag = F.xxhash64(*[docs[c] for c in docs.columns])
    sets = Sets(docs, k, percent, tag, "true")
    found = joined(sets.members(), sets.arrays(), percent)
    placed = sets.rows.filter(sets.linking).join(sets.by_class(found).select(*CLASS, "component"), CLASS)
    texts = placed.groupBy("component", "doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = texts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", "n")).alias("x")).select("component", "x.doc_id", "x.tag", "x.n")
    first = best.select("component", F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tag").alias("first"))
    same = F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tag") == F.col("first")
    gone = materialize(texts.join(first, "component").filter(~same).select("doc_id", "tag"), "gone")
    again = materialize(best.filter("n > 1").select("doc_id", "tag"), "again")
    is_row = lambda other: docs["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (tag == other["tag"])
    kept = docs.join(small(gone), is_row(gone), "left_anti")
    if again.isEmpty():
        return kept
    twice = docs.join(small(again), is_row(again), "left_semi").dropDuplicates()
    return kept.join(small(again), is_row(again), "left_anti").unionByName(twice)
