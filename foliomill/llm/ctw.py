"""Context-tree weighting over bytes, trained on the corpus and used to score it.

Bytes are decomposed into binary decisions.  A decision's contexts are the 0 to
``DEPTH`` preceding bytes of the running text, lower-cased as the words of the
base model are, white space and word boundaries included; before its first byte a
text has ``EDGE`` bytes, and it ends with one.  Every node mixes its
Krichevsky-Trofimov estimate with its children's product, half and half, so all
depths weigh in by how well they have predicted.  Scoring uses the mixture
posterior of the trained tree: exact, no pruning, no hashing.

1. a map counts the words of each task; a grouping sums them (base model);
2. chunks of texts emit their distinct byte 6-grams with training counts; a
   grouping sums those;
3. the tree below each pair of nearest bytes is worked out inside one bucket;
   the two upper depths (at most 256 x 255 nodes) are finished on the driver;
4. code lengths return to the chunks by a join on the 6-gram, and each text adds
   up those of its own 6-grams;
5. documents add up their words' base scores: the ``HOT`` most frequent words are
   broadcast, a bounded number; all other words join the word table.

Defined results: a null text is empty and has one token, its end; repeated rows
are scored each; with no training rows all counts are 0; an empty table gives no
rows; other columns are ignored; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .store import materialize

DEPTH = 5
#: words broadcast, and the longest of them in bytes
HOT, HOT_BYTES = 200_000, 64
#: distinct words of a block, distinct 6-grams of a bucket, bytes of text counted together
BLOCK_WORDS, BUCKET_GRAMS, TASK_BYTES = 400_000, 500_000, 24 << 20
SEPARATOR, END_OF_TEXT = 0x20, 0x0A
#: no byte of UTF-8: what stands before and after a text
EDGE = 0xFF
#: additive smoothing of the base model
ALPHA = 0.1


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans end to end, and their offsets."""
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return buf[np.arange(off[-1]) + np.repeat(starts - off[:-1], sizes)], off


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# --- 1. word counts -----------------------------------------------------------------


class _Counts:
    """Distinct words of some slices, with training counts."""

    def __init__(self) -> None:
        self.hashes, self.counts, self.data, self.sizes, self.seen = [], [], [], [], 0

    def add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> None:
        h = V.word_hashes(buf, starts, ends)
        u, first, where = np.unique(h, return_index=True, return_inverse=True)
        data, _ = gather(buf, starts[first], ends[first] - starts[first])
        self.hashes.append(u)
        self.counts.append(np.bincount(where, weights=weight, minlength=len(u)))
        self.data.append(data)
        self.sizes.append(ends[first] - starts[first])
        self.seen += len(buf)

    def flush(self) -> pa.RecordBatch:
        h = np.concatenate(self.hashes)
        u, first, where = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(self.counts), minlength=len(u)).astype(np.int64)
        sizes = np.concatenate(self.sizes)
        starts = np.cumsum(sizes) - sizes
        data, off = gather(np.concatenate(self.data), starts[first], sizes[first])
        self.__init__()
        return pa.RecordBatch.from_arrays([binary_array(data, off), pa.array(n)], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct lower-cased word with its count in training rows.

    The empty word stands for the end of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = _Counts(), 0
        for batch in batches:
            train = ~np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            texts += int(train.sum())
            buf, off = V.text_buffers(batch.column(1))
            for a, b in V.slices(off):
                part, at = V.LOWER[buf[off[a] : off[b]]], off[a : b + 1] - off[a]
                starts, ends, first = V.word_spans(part, at, V.WHITE)
                if len(starts):
                    counts.add(part, starts, ends, np.repeat(train[a:b], np.diff(first)).astype(float))
                if counts.seen >= TASK_BYTES:
                    yield counts.flush()
        if counts.hashes:
            yield counts.flush()
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])

    rows = docs.select(held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


# --- 2. byte 6-grams ----------------------------------------------------------------


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All contexts with their next byte, word by word, and each word's first position.

    A 6-gram holds its nearest context byte highest and the coded byte lowest.
    """
    buf, off = V.text_buffers(words)
    sizes = np.diff(off)
    at = np.zeros(len(off), np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    coded = np.full(at[-1], SEPARATOR, np.uint64)
    inner = np.ones(len(coded), bool)
    inner[at[1:] - 1] = False
    coded[inner] = buf[off[0] : off[-1]]
    coded[at[1:][sizes == 0] - 1] = END_OF_TEXT
    into = np.arange(len(coded)) - np.repeat(at[:-1], sizes + 1)
    g = coded.copy()
    for d in range(1, DEPTH + 1):
        back = np.zeros(len(coded), np.uint64)
        back[d:] = coded[:-d]
        back = np.where(into >= d, back, np.where(into == d - 1, np.uint64(SEPARATOR), np.uint64(0)))
        g |= back << np.uint64(8 * (DEPTH + 1 - d))
    return g, at


def block_grams(words: DataFrame) -> DataFrame:
    """(block, g, n): each block's distinct 6-grams with training counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        g, at = word_grams(table["word"].chunk(0))
        u, where = np.unique(g, return_inverse=True)
        n = np.bincount(where, weights=np.repeat(table["c"].to_numpy().astype(float), np.diff(at)), minlength=len(u))
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array(np.full(len(u), block, np.int64)), "g": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return words.groupBy("block").applyInArrow(run, "block long, g long, n long")


def text_grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All contexts with their next byte over whole texts, and each text's first position.

    ``at`` holds row offsets into ``buf`` starting at 0; 6-grams are laid out as in ``word_grams``.
    """
    rows = len(at) - 1
    first = at + np.arange(rows + 1)
    coded = np.full(first[-1], EDGE, np.uint64)
    inner = np.ones(len(coded), bool)
    inner[first[1:] - 1] = False
    coded[inner] = buf
    into = np.arange(len(coded)) - np.repeat(first[:-1], np.diff(first))
    g = coded.copy()
    for d in range(1, DEPTH + 1):
        back = np.full(len(coded), EDGE, np.uint64)
        back[d:] = coded[:-d]
        back[into < d] = EDGE
        g |= back << np.uint64(8 * (DEPTH + 1 - d))
    return g, first


def _tallied(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 6-grams in order, and the sums of their counts."""
    order = np.argsort(g)
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(n[order], first)


def chunk_grams(dealt: DataFrame) -> DataFrame:
    """(chunk, g, n): each chunk's distinct 6-grams of whole texts with training counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        train = ~np.asarray(table["held_out"].to_numpy(), bool)
        buf, off = V.text_buffers(table["text"].chunk(0))
        seen, counts = [], []
        for a, b in V.slices(off):
            g, first = text_grams(V.LOWER[buf[off[a] : off[b]]], off[a : b + 1] - off[a])
            counted = np.repeat(train[a:b], np.diff(first))
            for part, weight in ((g[counted], 1), (g[~counted], 0)):
                if len(part):
                    part = np.sort(part)
                    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                    seen.append(part[at[:-1]])
                    counts.append(np.diff(at) * weight)
        u, n = _tallied(np.concatenate(seen), np.concatenate(counts))
        return pa.table({"chunk": pa.array(np.full(len(u), table["chunk"][0].as_py(), np.int64)), "g": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return dealt.select("chunk", "held_out", "text").groupBy("chunk").applyInArrow(run, "chunk long, g long, n long")


# --- 3. the tree --------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting the argument up by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    return log_gamma(a0 + 0.5) + log_gamma(a1 + 0.5) - math.log(math.pi) - log_gamma(a0 + a1 + 1)


def weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, and the weight of the node's own estimate."""
    total = np.logaddexp(own, children) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


class Subtree:
    """Depths 2 to ``DEPTH`` of the tree for a set of whole (c1, c2) contexts."""

    def __init__(self, g: np.ndarray, n: np.ndarray):
        order = np.argsort(g)
        self.g, self.n = g[order], n[order].astype(float)
        self.nodes: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        for d in range(DEPTH, 1, -1):
            key = ((self.g >> np.uint64(8 * (DEPTH + 1 - d))) << np.uint64(8)) | (self.g & np.uint64(255))
            key, where = np.unique(key, return_inverse=True)
            count = np.bincount(where, weights=self.n)
            for j in range(8):
                ids, first = np.unique(key >> np.uint64(8 - j), return_index=True)
                bit = ((key >> np.uint64(7 - j)) & np.uint64(1)).astype(float)
                a1 = np.add.reduceat(count * bit, first)
                a0 = np.add.reduceat(count, first) - a1
                own = log_kt(a0, a1)
                if d == DEPTH:
                    total, weight = own, np.ones_like(own)
                else:
                    child = self.nodes[d + 1, j]
                    low = np.uint64((1 << j) - 1)
                    up = ((child["ids"] >> np.uint64(j + 8)) << np.uint64(j)) | (child["ids"] & low)
                    total, weight = weigh(own, np.bincount(np.searchsorted(ids, up), weights=child["total"], minlength=len(ids)))
                self.nodes[d, j] = {"ids": ids, "a0": a0, "a1": a1, "total": total, "weight": weight, "p1": (a1 + 0.5) / (a0 + a1 + 1)}

    def summary(self) -> dict[str, np.ndarray]:
        """Sums over c2 for each (c1, decision): what depth 1 needs."""
        out: dict[str, list] = {k: [] for k in ("c1", "node", "a0", "a1", "total")}
        for j in range(8):
            x = self.nodes[2, j]
            c1 = x["ids"] >> np.uint64(j + 8)
            node = np.uint64(1 << j) | (x["ids"] & np.uint64((1 << j) - 1))
            both, where = np.unique((c1 << np.uint64(8)) | node, return_inverse=True)
            out["c1"].append((both >> np.uint64(8)).astype(np.int64))
            out["node"].append((both & np.uint64(255)).astype(np.int64))
            for k in ("a0", "a1", "total"):
                out[k].append(np.bincount(where, weights=x[k]))
        return {k: np.concatenate(v) for k, v in out.items()}

    def bits(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Code length of each 6-gram's byte; ``lead`` and ``rest`` come from ``upper``."""
        total = np.zeros(len(self.g))
        byte = self.g & np.uint64(255)
        c1 = (self.g >> np.uint64(8 * DEPTH)).astype(np.int64)
        for j in range(8):
            top = byte >> np.uint64(8 - j)
            p = None
            for d in range(DEPTH, 1, -1):
                x = self.nodes[d, j]
                i = np.searchsorted(x["ids"], ((self.g >> np.uint64(8 * (DEPTH + 1 - d))) << np.uint64(j)) | top)
                p = x["p1"][i] if p is None else x["weight"][i] * x["p1"][i] + (1 - x["weight"][i]) * p
            node = ((1 << j) | top.astype(np.int64))
            one = lead[c1, node] + rest[c1, node] * p
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            total -= np.log2(np.where(bit, one, 1 - one))
        return total


def upper(c1: np.ndarray, node: np.ndarray, a0: np.ndarray, a1: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths 0 and 1: P(1) = lead + rest * P(1 at depth 2 and below), by (c1, decision)."""
    shape = (256, 256)
    n0, n1, below, seen = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
    n0[c1, node], n1[c1, node], below[c1, node], seen[c1, node] = a0, a1, total, True
    total1, w1 = weigh(log_kt(n0, n1), below)
    r0, r1 = n0.sum(axis=0), n1.sum(axis=0)
    _, w0 = weigh(log_kt(r0, r1), np.where(seen, total1, 0).sum(axis=0))
    p0, p1 = (r1 + 0.5) / (r0 + r1 + 1), (n1 + 0.5) / (n0 + n1 + 1)
    return w0 * p0 + (1 - w0) * w1 * p1, (1 - w0) * (1 - w1)


def gram_bits(grams: DataFrame) -> DataFrame:
    """(g, bits) for every distinct 6-gram of ``grams`` (g, n)."""
    summed = materialize(grams.groupBy("g").agg(F.sum("n").alias("n")), "grams")
    buckets = max(1, math.ceil(summed.count() / BUCKET_GRAMS))
    dealt = summed.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("g", 8 * (DEPTH - 1))), F.lit(buckets)))

    def tree(table: pa.Table) -> Subtree:
        return Subtree(table["g"].to_numpy().view(np.uint64), table["n"].to_numpy())

    def top(table: pa.Table) -> pa.Table:
        return pa.table({k: pa.array(v) for k, v in tree(table).summary().items()})

    part = dealt.groupBy("bucket").applyInArrow(top, "c1 long, node long, a0 double, a1 double, total double")
    rows = part.groupBy("c1", "node").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "total")]).toPandas()  # at most 256 x 255 rows
    if rows.empty:
        return summed.select("g", F.lit(0.0).alias("bits"))
    lead, rest = upper(*(rows[c].to_numpy() for c in ("c1", "node", "a0", "a1", "total")))

    def lengths(table: pa.Table) -> pa.Table:
        t = tree(table)
        return pa.table({"g": pa.array(t.g.view(np.int64)), "bits": pa.array(t.bits(lead, rest))})

    return dealt.groupBy("bucket").applyInArrow(lengths, "g long, bits double")


# --- 4. words -----------------------------------------------------------------------


def word_model(docs: DataFrame) -> DataFrame:
    """(word, c, ctw): every distinct word with its count and log10 probability, each word a text by itself.

    Its contexts end at the word's separator; texts are scored by ``score`` on running contexts.
    """
    counted = materialize(word_counts(docs), "words")
    blocks = max(1, math.ceil(counted.count() / BLOCK_WORDS))
    words = counted.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)))
    grams = materialize(block_grams(words), "block_grams")
    coded = grams.select("block", "g").join(gram_bits(grams.select("g", "n")), "g")

    def value(words: pa.Table, coded: pa.Table) -> pa.Table:
        words = words.combine_chunks()
        if not words.num_rows:
            return words.select(["word", "c"]).append_column("ctw", pa.array([], pa.float64()))
        key, bits = coded["g"].to_numpy().view(np.uint64), coded["bits"].to_numpy()
        order = np.argsort(key)
        g, at = word_grams(words["word"].chunk(0))
        each = bits[order][np.searchsorted(key[order], g)]
        total = np.add.reduceat(each, at[:-1])
        return words.select(["word", "c"]).append_column("ctw", pa.array(-total * math.log10(2)))

    made = words.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(value, "word binary, c long, ctw double")
    return materialize(made, "model")


# --- 5. documents -------------------------------------------------------------------

PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, ctw double, word binary, tf long"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
PARTIAL_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in PARTIAL.split(", "))])


def hot_threshold(model: DataFrame, most: int = HOT) -> int:
    """The least count such that at most ``most`` words reach it.

    Counts are binned on a log scale: a few hundred rows reach the driver, and no
    task has to sort or gather the words.
    """
    bin_of = F.floor(F.log2(F.col("c").cast("double")) * 16)
    bins = model.filter((F.col("c") > 0) & (F.octet_length("word") <= HOT_BYTES)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    total, least = 0, 1 << 62
    for b in sorted(bins, key=lambda r: -r["bin"]):
        total += b["n"]
        if total > most:
            break
        least = b["c"]
    return least


def score(docs: DataFrame) -> DataFrame:
    """Base and model log10 probabilities of every text of ``docs``."""
    spark = docs.sparkSession
    model = materialize(word_counts(docs), "words")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / TASK_BYTES))
    # rows are dealt by what they hold, so both passes agree
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    grams = materialize(chunk_grams(dealt), "chunk_grams")
    coded = grams.select("chunk", "g").join(gram_bits(grams.select("g", "n")), "g")
    n, v = model.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    below = n + ALPHA * (v + 1)
    hot = model.filter((F.octet_length("word") <= HOT_BYTES) & (F.col("c") >= hot_threshold(model))).toArrow().combine_chunks()
    words = hot["word"].chunk(0) if hot.num_rows else pa.array([], pa.binary())
    buf, off = V.text_buffers(words)
    hashes = V.word_hashes(buf, off[:-1], off[1:]) if len(words) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    c = hot["c"].to_numpy()[order] if hot.num_rows else np.zeros(0)
    known = spark.sparkContext.broadcast((hashes[order], np.log10((c + ALPHA) / below), c > 0))

    def partial(batches: list[pa.RecordBatch], key: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        table, base, is_known = known.value
        names = [x.split()[0] for x in PARTIAL.split(", ")]
        for batch in batches:
            row, doc, out = batch.column(0), batch.column(1), batch.column(2)
            texts, off = V.text_buffers(batch.column(3))
            for a, b in V.slices(off):
                part, at = V.LOWER[texts[off[a] : off[b]]], off[a : b + 1] - off[a]
                starts, ends, first = V.word_spans(part, at, V.WHITE)
                h = V.word_hashes(part, starts, ends)
                of = np.repeat(np.arange(b - a), np.diff(first))
                i = np.searchsorted(table, h)
                i[i == len(table)] = 0
                hit = table[i] == h if len(table) else np.zeros(len(h), bool)
                add = lambda values: np.bincount(of[hit], weights=values[i[hit]], minlength=b - a)
                g, at_gram = text_grams(part, at)
                by = np.argsort(g)
                each = np.empty(len(g))
                each[by] = bits[np.searchsorted(key, g[by])]
                ctw = -np.add.reduceat(each, at_gram[:-1]) * math.log10(2)
                whole = [row[a:b], doc[a:b], out[a:b], pa.array(np.diff(first) + 1), pa.array(np.diff(at)), pa.array(add(is_known.astype(float)).astype(np.int64)), pa.array(add(base)), pa.array(ctw)]
                # the row itself, under a key that is no word
                keys = pa.array([b" %d" % x for x in row[a:b].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*whole, keys, pa.nulls(b - a, pa.int64())], names=names)
                cold = np.flatnonzero(~hit)
                if len(cold):
                    _, at_first, where = np.unique(h[cold] ^ V.mix64(of[cold].astype(np.uint64)), return_index=True, return_inverse=True)
                    pick = cold[at_first]
                    data, to = gather(part, starts[pick], ends[pick] - starts[pick])
                    m = len(pick)
                    none = lambda t: pa.nulls(m, t)
                    yield pa.RecordBatch.from_arrays([row[a:b].take(pa.array(of[pick])), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), binary_array(data, to), pa.array(np.bincount(where, minlength=m).astype(np.int64))], names=names)

    def run(texts: pa.Table, coded: pa.Table) -> pa.Table:
        key, bits = coded["g"].to_numpy().view(np.uint64), coded["bits"].to_numpy()
        order = np.argsort(key)
        made = partial(texts.select(["row", "doc_id", "held_out", "text"]).combine_chunks().to_batches(), key[order], bits[order])
        return pa.Table.from_batches(made, schema=PARTIAL_ARROW)

    end = model.filter(F.octet_length("word") == 0).select("c").first()
    end_c = end["c"] if end else 0
    parts = dealt.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(run, PARTIAL)
    joined = parts.join(model.filter(F.octet_length("word") > 0).select("word", "c"), "word", "left")
    tf = F.col("tf").cast("double")
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"),
        (F.sum(F.coalesce("n_known", F.lit(0))) + F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)) + F.lit(int(end_c > 0))).alias("n_known"),
        (F.sum(F.coalesce("base", F.lit(0.0))) + F.sum(F.coalesce(tf * F.log10((F.col("c") + ALPHA) / F.lit(below)), F.lit(0.0))) + F.lit(math.log10((end_c + ALPHA) / below))).alias("base_score"),
        F.sum("ctw").alias("score"),
    )
    bits = -F.col("score") / F.lit(math.log10(2))
    return out.select("doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.try_divide(bits, F.col("n_bytes").cast("double")).alias("bits_per_byte"))
