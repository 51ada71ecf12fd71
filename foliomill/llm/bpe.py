"""Byte-level BPE by a lazily determinised finite-state transducer.

Compilation: the vocabulary's ranks give the merges.  Two adjacent tokens are
*compatible* if BPE leaves them so; a sequence is the BPE of its bytes exactly if
its neighbours are compatible, and the BPE of any prefix ends in one token.  So
reading left to right, the last token of each prefix follows from those of
shorter prefixes: a deterministic machine whose state is the last committed
token with the pending bytes and their last tokens.

States and transitions are made when first met and kept (up to ``MAX_STATES``).
A token is emitted once every way in which the input can go on agrees on it,
which needs no more lookahead than the longest token.

Decoding is the inverse stream: tokens enter an incremental UTF-8 machine whose
state is the started character.

Scale: a map.  Texts are cut where the pre-tokenisation pattern always cuts
(before a lone space), and the ids of each cut are kept in a bounded memo.

Defined results: a null text encodes as an empty one; repeated rows are encoded
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STATES, MEMO, MEMO_CHARS = 400_000, 400_000, 48


#: a run of white space stays in one piece with what comes before it
_CUT = re.compile(r"(?<=\S)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merges behind a ranked vocabulary, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        #: token -> the two that were merged into it, and back
        self.parts: dict[int, tuple[int, int]] = {}
        for b, i in ranks.items():
            if len(b) > 1 and len(made := self.merge(b, below=i)) == 2:
                self.parts[i] = (made[0], made[1])
        self.merged = {p: i for i, p in self.parts.items()}
        self.fits = Fits(self)

    def forget(self) -> None:
        """Drop the memo of compatible pairs."""
        self.fits.clear()

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """BPE by ranks, with merges under ``below`` only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` as they are when they meet.

        Merging ran in rank order, so undo it in reverse: at each moment the two
        tokens that touched must not have had a merge of a rank below the next
        one that was in fact done on either side.
        """
        left, right, least = a, b, 1 << 31
        while True:
            if self.merged.get((left, right), 1 << 31) < least:
                return False
            p, q = self.parts.get(left), self.parts.get(right)
            if p is None and q is None:
                return True
            # the later of the two merges is undone first; of equal ones the right is the later
            if q is None or (p is not None and left > right):
                least, left = left, p[1]
            else:
                least, right = right + 1, q[0]


class Fits(dict):
    """Memo of ``Merges.fit`` by both tokens in one number."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, key: int) -> bool:
        known = self[key] = self.merges.fit(key >> 32, key & 0xFFFFFFFF)
        return known


class Branch:
    """A node of the trie of tokens: the token that ends here (-1: none), and what follows by byte."""

    __slots__ = ("token", "below")

    def __init__(self) -> None:
        self.token = -1
        self.below: dict[int, Branch] = {}


class Node(dict):
    """A state, which maps the next byte to (state, tokens that are then certain).

    It stands for the last committed token (-1 at the start), the open starts, each
    a place in the pending bytes and what may follow there, and the last token of
    each prefix of the pending bytes.  Transitions are made when first asked for.
    """

    __slots__ = ("committed", "machine", "open", "last", "tail")

    def __init__(self, machine: Transducer, committed: int, open_: tuple[tuple[int, dict], ...], last: tuple[int, ...]):
        self.machine, self.committed, self.open, self.last = machine, committed, open_, last
        #: the tokens of the pending bytes, if the piece ends here
        self.tail: tuple[int, ...] | None = None

    def __missing__(self, byte: int) -> tuple[Node, tuple[int, ...]]:
        """Make the transition."""
        machine, committed, last = self.machine, self.committed, self.last
        n, found, open_, fits = len(last), -1, [], machine.m.fits
        for j, below in self.open:
            at = below.get(byte)
            if at is None:
                continue
            if found < 0 <= at.token:
                # the last token is the longest that fits what precedes it
                before = last[j - 1] if j else committed
                if before < 0 or fits[before << 32 | at.token]:
                    found = at.token
            if at.below:
                open_.append((j, at.below))
        if (at := machine.root.get(byte)) is None:
            raise ValueError("bytes that the vocabulary does not cover")
        if found < 0:
            found = at.token
        if at.below:
            open_.append((n, at.below))
        last += (found,)
        # each end's predecessor is where its token starts; what all ways share ends where they meet
        size, cut = machine.size, open_[0][0] if open_ else n + 1
        if cut:
            for j in (*[j for j, _ in open_], n + 1):
                while cut and j != cut:
                    if j > cut:
                        j -= size[last[j - 1]]
                    else:
                        cut -= size[last[cut - 1]]
                if not cut:
                    break
        out: tuple[int, ...] = ()
        if cut:
            out = machine.chain(last, cut)
            committed, last, open_ = out[-1], last[cut:], [(j - cut, below) for j, below in open_]
        # the last tokens of all prefixes spell the pending bytes, from which the open starts follow
        key = (committed, last)
        made = machine.nodes.get(key)
        if made is None:
            if len(machine.nodes) >= MAX_STATES:
                machine.clear()
            made = machine.nodes[key] = Node(machine, committed, tuple(open_), last)
        got = self[byte] = (made, out)
        return got


class Transducer:
    """Bytes in, tokens out; determinised as it runs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.m = Merges(ranks)
        self.size = {i: len(b) for b, i in ranks.items()}
        #: what follows at a start: the trie of the tokens that merging can reach
        self.root: dict[int, Branch] = {}
        for b, i in ranks.items():
            if len(b) == 1 or i in self.m.parts:
                below = self.root
                for byte in b:
                    if byte not in below:
                        below[byte] = Branch()
                    at = below[byte]
                    below = at.below
                at.token = i
        self.start = Node(self, -1, (), ())
        self.nodes: dict[tuple, Node] = {}

    def clear(self) -> None:
        """Forget all states but the start; states refer to one another, so their transitions are taken from them."""
        for node in self.nodes.values():
            node.clear()
        self.nodes.clear()
        self.start.clear()
        self.m.forget()

    def chain(self, last: tuple[int, ...], end: int) -> tuple[int, ...]:
        """The tokens that make up the first ``end`` pending bytes."""
        out = []
        while end:
            out.append(last[end - 1])
            end -= self.size[last[end - 1]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.m.ranks.get(piece)
        if whole is not None:
            return (whole,)
        node, out = self.start, []
        for byte in piece:
            node, emitted = node[byte]
            if emitted:
                out += emitted
        if node.tail is None:
            node.tail = self.chain(node.last, len(node.last))
        return (*out, *node.tail)


class Encoder(dict):
    """Cut of a text -> packed ids, memoised in bounded memory.

    A full memo becomes the old one, which is asked before a cut is encoded anew, so
    what is still in use stays.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex

        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(read_ranks(path))
        #: the same for single matches of the pattern, which cuts share
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, bytes] = {}
        self.old_pieces: dict[str, tuple[int, ...]] = {}

    def __missing__(self, cut: str) -> bytes:
        packed = self.old.get(cut)
        if packed is None:
            found, pieces, encode = self.pattern.findall(cut), self.pieces, self.transducer.encode
            if len(found) == 1:  # kept as a cut, not as a piece too
                ids = pieces.get(cut) or self.old_pieces.get(cut) or encode(cut.encode())
            else:
                ids = []
                for piece in found:
                    got = pieces.get(piece)
                    if got is None:
                        got = self.old_pieces.get(piece) or encode(piece.encode())
                        if len(piece) <= MEMO_CHARS:
                            if len(pieces) >= MEMO:
                                self.old_pieces, pieces = pieces, {}
                                self.pieces = pieces
                            pieces[piece] = got
                    ids += got
            packed = array("I", ids).tobytes()
        if len(cut) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[cut] = packed
        return packed

    @staticmethod
    def cuts(text: str) -> list[str]:
        """Cuts before each space that stands between two non-spaces."""
        return _CUT.split(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed little-endian uint32."""
        return b"".join(map(self.__getitem__, self.cuts(text)))


class Utf8Decoder:
    """Incremental UTF-8: bytes of tokens in, characters out, bounded state."""

    def __init__(self) -> None:
        self.need, self.started = 0, bytearray()

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if b & 0xC0 == 0x80:
                    self.started.append(b)
                    self.need -= 1
                    if not self.need:
                        out.append(self.started.decode("utf-8", "replace"))
                        self.started.clear()
                    continue
                out.append("�")
                self.need = 0
                self.started.clear()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.started.append(b)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.need = bool(self.started), 0
        self.started.clear()
        return "�" if left else ""


class Decoder:
    """Token stream -> text.  Tokens that are whole characters skip the byte machine."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.bytes = token_bytes
        self.whole: dict[int, str] = {}
        for i, b in token_bytes.items():
            try:
                self.whole[i] = b.decode("utf-8")
            except UnicodeDecodeError:
                pass

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            pass
        machine, out, at, n = Utf8Decoder(), [], 0, len(ids)
        whole, broken = self.whole, [k for k, i in enumerate(ids) if i not in self.whole]
        for k in broken:
            if k < at:  # taken while a character was open
                continue
            out += map(whole.__getitem__, ids[at:k])
            out.append(machine.feed(self.bytes[ids[k]]))
            at = k + 1
            while machine.need and at < n:
                out.append(machine.feed(self.bytes[ids[at]]))
                at += 1
        out += map(whole.__getitem__, ids[at:])
        return "".join(out) + machine.close()


_made: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a vocabulary, one of each in a process."""
    if (path, pattern) not in _made:
        e = Encoder(path, pattern)
        _made[path, pattern] = e, Decoder(e.transducer.m.token_bytes)
    return _made[path, pattern]


@contextmanager
def no_collection() -> Iterator[None]:
    """States and memos hold no cycles, so looking for some among millions of them is left out."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens and digests of ids and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = codec(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            with no_collection():
                for text in batch.column(1):
                    packed = enc.encode(text.as_py() or "")
                    n.append(len(packed) // 4)
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    decoded = dec.decode(np.frombuffer(packed, "<u4").tolist())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = codec(path, pattern)
        for batch in batches:
            with no_collection():
                ids = [np.frombuffer(enc.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
