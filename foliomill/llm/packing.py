"""Best-fit packing of documents into fixed-length token sequences.

Method: linear grouping.  Pieces longer than a threshold are sorted and cut into
groups of equal cardinality; each length is rounded up to its group's largest.
That leaves few sizes, for which the configuration program (cover all groups
with patterns of at most one sequence) is solved by column generation.  Whole
patterns are opened and actual pieces take the slots of their group; a pattern's
last slot goes to the longest piece that still fits.  What is left, the short
pieces last, goes by best fit into the gaps.

Scale: tokenising is a map that writes the ids of every piece to the shared folder.
Only (doc_id, piece, length) rows move, dealt at random into shards of a bounded
number of rows, each packed by one task; a shard wastes a few sequences at most
whatever the corpus size.  ``pack_sequences`` joins ids to their places and gives
the sequences themselves.

Defined results: a null text packs as an empty one (one token, the separator);
repeated rows are packed each; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.  Strings of special tokens in a text are read
as the library reads them, as those tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

CAPACITY = 2048
SEPARATOR = 0
#: rows packed by one task
SHARD_ROWS = 50_000
#: pieces of at most this share of the capacity count as short
SHORT = 1 / 8
GROUPS = 64
MEMO = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
SEQUENCES = "sequence_id long, ids array<int>, pieces array<struct<offset:long,doc_id:long,piece:int,length:long>>"


class WordEndEncoder(dict):
    """White-space chunk -> its ids as packed little-endian uint32, memoised.

    The vocabulary drops white space and never merges across it, so a text's ids
    are its chunks' ids in order.  Chunks of ASCII and precomposed Latin-1 letters
    are encoded piece by piece with the vocabulary as byte-pair ranks, the word
    end being one more byte; every other chunk, and one that may hold the string of
    a special token, goes to the tokenizer itself.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        super().__init__()
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow in order
        alphabet = sorted(ByteLevel.alphabet(), key=ord)
        kept = [c for c in alphabet if ord(c) < 256]
        moved = [c for c in alphabet if ord(c) >= 256]
        rest = [b for b in range(256) if chr(b) not in set(kept)]
        to_byte = {c: ord(c) for c in kept} | dict(zip(moved, rest))
        special = {t["content"] for t in model["added_tokens"]}
        self.openings = {t[:2] for t in special}
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if token in special:
                continue
            end = token.endswith("</w>")
            raw = bytes(to_byte[c] for c in (token[:-4] if end else token))
            ranks[raw + b"\xff" if end else raw] = i
        self.core = tiktoken.Encoding("word_end", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "surrogatepass")
        if self.PLAIN.fullmatch(text) and not any(x in text for x in self.openings):
            one = self.core.encode_single_piece
            ids: list[int] = []
            for word in self.WORDS.findall(text.lower()):
                ids += one(word.encode() + b"\xff")
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        packed = np.asarray(ids, "<u4").tobytes()
        if len(self) < MEMO and len(chunk) <= 64:
            self[chunk] = packed
        return packed


_encoders: dict[str, WordEndEncoder] = {}


def encoder(path: str) -> WordEndEncoder:
    """This process's encoder for a vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEndEncoder(path)
    return _encoders[path]


def encode(text: bytes, path: str) -> bytes:
    """The ids of one text as packed uint32, without the separator."""
    return b"".join(map(encoder(path).__getitem__, text.split()))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut each into pieces of ``capacity``; ids are little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path).__getitem__
        sep = np.asarray([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(of, (text.as_py() or b"").split())) + sep
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, part))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


class BestFit:
    """Open sequences by free room; the fullest that still fits is found in one bit scan."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def open(self, items: list[int], used: int) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - used)
        self._file(len(self.bins) - 1)

    def _file(self, b: int) -> None:
        if r := self.room[b]:
            self.by_room[r].append(b)
            self.mask |= 1 << r

    def add(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.open([item], size)
            return
        r = size + (fits & -fits).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.mask &= ~(1 << r)
        self.bins[b].append(item)
        self.room[b] = r - size
        self._file(b)


class Shelf:
    """Pieces by length; the longest up to a size is found in one bit scan."""

    def __init__(self, lengths: np.ndarray, items: np.ndarray):
        self.by_length: dict[int, list[int]] = {}
        for i, n in zip(items[::-1].tolist(), lengths[items[::-1]].tolist()):
            self.by_length.setdefault(n, []).append(i)
        self.mask = 0
        for n in self.by_length:
            self.mask |= 1 << n

    def take(self, size: int) -> int | None:
        fits = self.mask & ((1 << (size + 1)) - 1)
        if not fits:
            return None
        n = fits.bit_length() - 1
        items = self.by_length[n]
        item = items.pop()
        if not items:
            self.mask &= ~(1 << n)
        return item

    def rest(self) -> list[int]:
        return [i for items in self.by_length.values() for i in items]


def best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of greatest value; sizes ascend."""
    use = np.flatnonzero(value > 1e-12)
    pattern = np.zeros(len(size), np.int64)
    if not len(use):
        return 0.0, pattern
    v, s = value[use], size[use]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(int(s[0]), capacity + 1):
        k = fit[c]
        gains = best[c - s[:k]] + v[:k]
        top = int(gains.argmax())
        if gains[top] > best[c - 1] + 1e-15:
            best[c], took[c] = gains[top], top
        else:
            best[c] = best[c - 1]
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        pattern[use[took[c]]] += 1
        c -= int(s[took[c]])
    return float(best[capacity]), pattern


def configurations(size: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for: fewest patterns that use each size ``need`` times.

    Returns patterns (columns) and how often each is used, as reals.
    """
    k = len(size)
    basis = np.diag((capacity // size).astype(float))
    used = need / np.diag(basis)
    for _ in range(12 * k):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = best_pattern(dual, size, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, used / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = pattern
    return basis.astype(np.int64), used


def pack(lengths: np.ndarray, capacity: int = CAPACITY, short: float = SHORT, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length; every length is 1..capacity."""
    n = len(lengths)
    fit = BestFit(capacity)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > short * capacity]
    left: list[int] = []
    if len(large):
        sizes = lengths[large]
        if len(distinct := np.unique(sizes)) <= groups:
            group = len(distinct) - 1 - np.searchsorted(distinct, sizes)
        else:
            group = np.arange(len(large)) * groups // len(large)
        _, first = np.unique(group, return_index=True)
        tops, counts = sizes[first], np.diff(np.append(first, len(large)))
        up, where = np.unique(tops, return_inverse=True)  # groups that round up to one size are one group
        patterns, used = configurations(up, np.bincount(where, weights=counts), capacity)
        held = Shelf(lengths, large)
        for p in np.argsort(-used):
            slots = np.repeat(up, patterns[:, p])[::-1].tolist()
            for _ in range(int(used[p] + 1e-6)):
                got: list[int] = []
                room = capacity
                for k, size in enumerate(slots):
                    # a slot takes an actual piece of its group; the last one, the longest that still fits
                    item = held.take(size if k + 1 < len(slots) else room)
                    if item is not None:
                        got.append(item)
                        room -= int(lengths[item])
                if got:
                    fit.open(got, capacity - room)
        left = held.rest()
    rest = np.concatenate([np.array(left, np.int64), order[lengths[order] <= short * capacity]])
    for i in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        fit.add(i, int(lengths[i]))
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, items in enumerate(fit.bins):
        at = 0
        for i in items:
            sequence[i], offset[i] = b, at
            at += int(lengths[i])
    return sequence, offset


def written_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` in the shared folder, each with a number of its own."""
    return materialize(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Places of written pieces: ``PLACED`` and the piece's uid."""
    shards = max(1, math.ceil(cut.count() / shard_rows))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "uid"]]

    sums = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "uid")
    return sums.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).groupBy("shard").applyInPandas(one, f"{PLACED}, uid long")


def best_fit_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return place(written_pieces(docs, path, capacity), capacity, shard_rows).drop("uid")


def pack_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The packed sequences: sequence_id, ids, and the pieces in order."""
    cut = written_pieces(docs, path, capacity)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "ids": [ids], "pieces": [rows[["offset", "doc_id", "piece", "length"]].to_dict("records")]})

    placed = place(cut, capacity, shard_rows).select("uid", "sequence_id", "offset", "doc_id", "piece", "length")
    return placed.join(cut.select("uid", "ids"), "uid").groupBy("sequence_id").applyInPandas(join, SEQUENCES)
