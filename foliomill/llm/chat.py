"""Chat formatting with typed content parts, a loss mask, and reading back.

A turn's content is a list of parts (text, image, audio, document).  A visitor
flattens them in order: text is escaped, other parts become placeholders, and
each attachment's reference and expanded token count is recorded.

Template: ``<|turn|>role<|text|>body<|end|>``.  In roles and texts every ``<``,
``[`` and ``\\`` is followed by an inserted ``\\``, so no control string (these
marks, placeholders, or ``<s>``, ``[INST]`` and the like of other templates) can
occur in them; dropping the inserted sign restores the text exactly.  The loss
mask covers the texts of the trained role and nothing else.

A conversation's formatted text is its turns, one after the other.  It is given
as rows of at most about ``LONGEST`` characters, each of whole turns; an ordinary
conversation is one row.  Reading back parses these texts by the template's marks
alone and follows the mask's spans.

Scale: turns are formatted one by one in a map, moved once by conversation, and
joined and read as a stream that holds one row and two hash states, however long
a conversation is: its digest is sequential by definition.

Defined results: null text or role counts as empty, null parts as none, a null
conv_id is a conversation of its own, turns that tie are taken by role and text,
repeated turns count each, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"

PART = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType()),
])
ATTACHMENT = "struct<ordinal:int,kind:string,ref:string,at:int,tokens:int>"
SPAN = "struct<from:int,to:int>"
SEGMENT = f"segment string, attachments array<{ATTACHMENT}>, loss array<{SPAN}>"
#: a row of a conversation's formatted text is closed when it has this many characters
LONGEST = 1 << 20
CONVERSATION = f"conv_id long, part int, formatted string, attachments array<{ATTACHMENT}>, loss array<{SPAN}>"

_SIGNS = re.compile(r"([<\[\\])")
_ESCAPED = re.compile(r"([<\[\\])\\")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document):[0-9]+\|>")


def escape(text: str) -> str:
    return _SIGNS.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens typed parts; ``visit_<kind>`` handles a kind."""

    #: tokens for each 336-pixel tile, each second of sound, each page
    TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 336, 576, 25, 800

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[tuple] = []
        self.texts: list[tuple[int, int]] = []

    def visit(self, part: Any) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_other)(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _attach(self, part: Any, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append((n, part["kind"], part["ref"], self.size, tokens))
        self._put(f"<|{part['kind']}:{n}|>")

    def visit_text(self, part: Any) -> None:
        at = self.size
        self._put(escape(part["text"] or ""))
        if self.size > at:
            self.texts.append((at, self.size))

    def visit_image(self, part: Any) -> None:
        tiles = math.ceil((part["width"] or self.TILE) / self.TILE) * math.ceil((part["height"] or self.TILE) / self.TILE)
        self._attach(part, tiles * self.TILE_TOKENS)

    def visit_audio(self, part: Any) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * self.SECOND_TOKENS))

    def visit_document(self, part: Any) -> None:
        self._attach(part, (part["pages"] or 1) * self.PAGE_TOKENS)

    def visit_other(self, part: Any) -> None:
        raise ValueError(f"unknown content part {part['kind']!r}")


def format_turn(role: str | None, parts: list | None) -> tuple[str, list, list]:
    """Segment, attachments and spans under the loss mask of one turn."""
    visitor = PartVisitor()
    for part in parts if parts is not None else ():
        visitor.visit(part)
    head = TURN + escape(role or "") + TEXT
    placed = [(n, kind, ref, at + len(head), tokens) for n, kind, ref, at, tokens in visitor.attachments]
    loss = [(a + len(head), b + len(head)) for a, b in visitor.texts] if role == TRAINED_ROLE else []
    return head + "".join(visitor.out) + END, placed, loss


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text (without placeholders) of each turn of a formatted text."""
    at = 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            raise ValueError(f"no turn begins at {at}")
        at = turn.end()
        role, body = turn.groups()
        yield unescape(role), "".join(map(unescape, _PLACE.split(body)))
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")


def part(kind: F.Column | None = None, **fields: F.Column) -> F.Column:
    """A content part, a text unless ``kind`` says otherwise."""
    given = {"kind": F.lit("text") if kind is None else kind} | fields
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields])


def format_turns(turns: DataFrame) -> DataFrame:
    """Format rows of (conv_id, turn, role, parts); one segment for each turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [format_turn(role, parts) for role, parts in zip(f["role"], f["parts"])]
            for i, name in enumerate(("segment", "attachments", "loss")):
                f[name] = [m[i] for m in made]
            yield f.drop(columns="parts")

    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "parts").mapInPandas(run, f"conv_id long, turn long, role string, {SEGMENT}")


def conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations (``CONVERSATION``), a conversation's rows one after the other in one partition."""

    class Open:
        """A row that is being filled; places count from the row's first character."""

        def __init__(self, key, conv, part):
            self.key, self.conv, self.part = key, conv, part
            self.out, self.size, self.attachments, self.loss = [], 0, [], []

        def take(self, row) -> None:
            n = len(self.attachments)
            self.attachments += [(n + i, a["kind"], a["ref"], a["at"] + self.size, a["tokens"]) for i, a in enumerate(row.attachments)]
            self.loss += [(x["from"] + self.size, x["to"] + self.size) for x in row.loss]
            self.out.append(row.segment)
            self.size += len(row.segment)

        def row(self) -> tuple:
            return self.conv, self.part, "".join(self.out), self.attachments, self.loss

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, kinds = ["conv_id", "part", "formatted", "attachments", "loss"], {"conv_id": "Int64", "part": "int32"}
        now = None
        for f in frames:
            done = []
            for row in f.itertuples(index=False):
                if now is None or row.conv_key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = Open(row.conv_key, None if row.is_null else row.conv_id, 0)
                elif now.size >= LONGEST:
                    done.append(now.row())
                    now = Open(now.key, now.conv, now.part + 1)
                now.take(row)
            yield pd.DataFrame(done, columns=names).astype(kinds)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names).astype(kinds)

    keyed = format_turns(turns).select(
        F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("is_null"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"), "turn", "role", "segment", "attachments", "loss",
    )
    return keyed.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "segment").mapInPandas(run, CONVERSATION)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long, n_attachments long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with what its formatted text says.

    ``formatted`` is as ``conversations`` gives it: a conversation's rows in order in one partition.
    """

    class Fold:
        def __init__(self, key):
            self.key, self.n, self.loss_chars, self.chars, self.tokens, self.attached = key, 0, 0, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def take(self, row) -> None:
            for role, text in read_turns(row.formatted):
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n += 1
            for span in row.loss:
                under = unescape(row.formatted[span["from"] : span["to"]])
                self.loss.update(under.encode())
                self.loss_chars += len(under)
            self.chars += len(row.formatted)
            self.tokens += sum(a["tokens"] for a in row.attachments)
            self.attached += len(row.attachments)

        def row(self) -> tuple:
            return self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.attached

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        fold = None
        for f in frames:
            done = []
            for row in f.itertuples(index=False):
                if row.part == 0:
                    if fold is not None:
                        done.append(fold.row())
                    fold = Fold(None if pd.isna(row.conv_id) else row.conv_id)
                fold.take(row)
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if fold is not None:
            yield pd.DataFrame([fold.row()], columns=names).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "part", "formatted", "attachments", "loss").mapInPandas(run, DIGEST)
