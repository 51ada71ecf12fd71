"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256.  The ledger says
which blob has been scanned under which rule version and what was found.  A
scan takes only the (blob, rule version) pairs that the ledger lacks, one copy
of each blob, and findings are joined back to all paths that hold the blob.

Scale: a first pass reads the texts to hash them; only (path, blob) moves.  The
second pass scans where the texts lie.  It needs to know which rows to leave out
(other copies of a blob, blobs already scanned) or, if fewer, which to take; that
list is broadcast where it has at most ``store.MOST`` rows, and joined by shuffle
beyond.  Only findings are joined back to paths, a blob without any moves no further.

Defined results: a null text scans as an empty one; a path with several texts
has each scanned; repeated rows are reported each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import MOST, drop, materialize, small

#: fixed values: the base rules.  A kind's pattern, and the length its token must reach
BASE = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: further rules of this scanner: an anchor that must occur, and the pattern
EXTRA = {
    "forge": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "chat": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "pem": ("PRIVATE KEY", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
}
KINDS = (*BASE, *EXTRA)
FINDINGS = "array<struct<kind:string,from:int,to:int>>"
LEDGER = f"blob_id string, rules array<string>, findings {FINDINGS}"

_HEXED = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


def rule_versions() -> dict[str, str]:
    """Kind -> its version, which changes with the rule's text."""
    rules = {"assign": ASSIGN.pattern + "{12}", "access": ACCESS.pattern, "hex": HEX.pattern} | {k: p.pattern for k, (_, p) in EXTRA.items()}
    return {k: f"{k}@{hashlib.sha256(v.encode()).hexdigest()[:10]}" for k, v in rules.items()}


def scan(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str, int]] = []
    for order, kind in enumerate(KINDS):
        if kind not in kinds:
            continue
        if kind == "assign":
            low = raw.lower()
            if not any(w in low for w in KEYWORDS):
                continue
            spans = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        elif kind == "access":
            spans = [m.span() for m in ACCESS.finditer(text)] if b"AKIA" in raw else []
        elif kind == "hex":
            spans = [m.span() for m in HEX.finditer(text)] if b"h" * 16 in raw.translate(_HEXED) else []
        else:
            anchor, pattern = EXTRA[kind]
            spans = [m.span() for m in pattern.finditer(text)] if anchor in text else []
        found += [(a, order, kind, b) for a, b in spans]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob_id) for every row; null text is the empty blob."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob_id"))


def unseen(held: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """One path of each blob that lacks a scan by some current rule, with those rules."""
    current = F.array(*[F.lit(v) for v in rule_versions().values()])
    blobs = held.groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("missing", current)
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    missing = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob_id", "left").select("blob_id", "path", missing.alias("missing")).filter(F.size("missing") > 0)


def scan_unseen(docs: DataFrame, held: DataFrame, todo: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan the chosen copy of each blob of ``todo``; rows to add to the ledger."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(path).alias("path"), F.sha2(whole.cast("binary"), 256).alias("blob_id"), whole.alias("text"))
    current = list(rule_versions().values())
    everything = F.array(*[F.lit(v) for v in current])
    row = lambda other: texts["path"].eqNullSafe(other["path"]) & (texts["blob_id"] == other["blob_id"])
    same = held["path"].eqNullSafe(todo["path"]) & (held["blob_id"] == todo["blob_id"])
    fresh = todo.count() > MOST and todo.filter(F.size("missing") < len(current)).isEmpty()
    left_out = materialize(held.join(todo, same, "left_anti").distinct(), "left_out") if fresh else None
    if left_out is not None and left_out.count() <= MOST:
        picked = texts.join(F.broadcast(left_out), row(left_out), "left_anti").select("blob_id", "text", everything.alias("missing"))
    else:
        picked = texts.join(small(todo), row(todo)).select(texts["blob_id"], "text", "missing")
    kind_of = {v: k for k, v in rule_versions().items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[dict(zip(("kind", "from", "to"), s)) for s in scan(t, tuple(kind_of[m] for m in ms))] for t, ms in zip(f["text"], f["missing"])]
            yield pd.DataFrame({"blob_id": f["blob_id"], "rules": f["missing"], "findings": found})

    return picked.mapInPandas(run, LEDGER)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; returns (versions, the grown ledger), both written."""
    held = materialize(versions(docs, path, text), "versions")
    todo = materialize(unseen(held, ledger), "todo")
    # a row that occurs twice is scanned twice
    new = scan_unseen(docs, held, todo, path, text).dropDuplicates(["blob_id"])
    grown = materialize(new if ledger is None else ledger.unionByName(new), "ledger")
    drop(todo)
    return held, grown


def findings_by_path(held: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, blob_id, findings) for every row of ``held``."""
    some = ledger.filter(F.size("findings") > 0)
    hits = materialize(some.groupBy("blob_id").agg(F.flatten(F.collect_list("findings")).alias("findings")), "hits")
    none = F.array().cast(FINDINGS)
    return held.join(small(hits, MOST // 4), "blob_id", "left").select("path", "blob_id", F.coalesce("findings", none).alias("findings"))


def span_columns(findings) -> dict[str, F.Column]:
    """Counts and span strings of a findings column."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(findings, lambda x: F.struct(x["from"].alias("a"), rank[x["kind"]].alias("k"), x["to"].alias("b"), x["kind"].alias("kind"))))
    show = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")
    base = F.filter(ordered, lambda x: x["k"] < len(BASE))
    count = lambda kind: F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")
    return {f"n_{k}": count(k) for k in BASE} | {"base_sha256": F.sha2(show(base), 256), "spans": show(ordered)}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones merged, replaced by its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
