"""Quality rules as a learned decision list.

Text statistics are taken over all documents.  From the labelled ones, by
sequential covering, an ordered list of conjunctions of thresholds is learned:
each rule is grown on two thirds of the rows by information gain, pruned on the
rest, kept while it stays precise, and the rows it covers are set aside.  The
list is emitted as one Spark conditional expression, ready to read.

Scale: statistics are a map over Arrow buffers and are written once (about 100
bytes a document).  Fitting uses at most ``MAX_LABELLED`` labelled rows, chosen
by hash; everything else covers all rows.

Defined results: a null text has no words and fails the base rule; several
labels of one document count by their mean (0.5 and more is good); null labels
are skipped; with no labels the list is empty and only the base rule rejects;
repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .store import materialize

#: labelled rows used for fitting
MAX_LABELLED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: a rule must be right on at least this share of the rows that it rejects, in both halves
MIN_PRECISION = 0.9
MIN_COVER, MAX_RULES, MAX_CONDITIONS, CUTS = 4, 12, 4, 48

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_pipes", "n_lines", "n_distinct_words", "longest_word")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
#: what the rules see: ratios of the counts
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _MARK, _PIPE, _DIGIT, _UPPER = _members(SYMBOLS), _members(MARKS), _members(b"|"), _members(b"0123456789"), _members(bytes(range(65, 91)))


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true flags in each row's bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(h) < 4:
        return 0
    windows = V.shingle_hashes(h, 3)
    order = np.argsort(windows, kind="stable")
    w = windows[order]
    same = w[1:] == w[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    """All of ``COUNTS`` for the texts of one Arrow column."""
    buf, off = V.text_buffers(column)
    parts: dict[str, list] = {c: [] for c in COUNTS}
    for a, b in V.slices(off):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = V.word_spans(part, at, V.WHITE)
        h = V.word_hashes(part, starts, ends)
        inside = ~V.WHITE[part] & ((part & 0xC0) != 0x80)
        put = lambda name, values: parts[name].append(np.asarray(values, np.int64))
        put("n_words", np.diff(first))
        put("word_chars", _per_row(inside, at))
        # upper case: ASCII letters, and the two-byte letters U+00C0 to U+00DE
        latin = np.zeros(len(part), bool)
        if len(part) > 1:
            latin[1:] = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
        put("n_upper", _per_row(_UPPER[part] | latin, at))
        for name, table in (("n_symbols", _SYMBOL), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_pipes", _PIPE)):
            put(name, _per_row(table[part], at))
        put("n_lines", _per_row(part == 0x0A, at) + (np.diff(at) > 0))
        raw, size = part.tobytes(), ends - starts
        words = [h[i:j] for i, j in zip(first[:-1], first[1:])]
        put("n_repeat_words", [repeated_words(w) for w in words])
        put("n_distinct_words", [len(np.unique(w)) for w in words])
        put("longest_word", [size[i:j].max() if j > i else 0 for i, j in zip(first[:-1], first[1:])])
        put("n_dup_lines", [repeated_lines(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
    return {c: np.concatenate(p) if p else np.zeros(0, np.int64) for c, p in parts.items()}


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and ``COUNTS`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_batch(batch.column(len(carry)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), *(pa.array(counts[c]) for c in COUNTS)], names=[*carry, *COUNTS])

    columns = [F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in carry]
    carried = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]), *(f"{c} long" for c in COUNTS)])
    return carried.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    return {name: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for name, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        c = feature_columns()[self.feature]
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.rows(x)
    return hit


def _score(p: float, n: float) -> float:
    return (p + 1) / (p + n + 2)


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of greatest gain until the rule covers no good row."""
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and bad[live].any() and not bad[live].all():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        here, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[live], np.linspace(0, 1, CUTS)))
            order = np.argsort(values[live], kind="stable")
            v, b = values[live][order], bad[live][order]
            at = np.searchsorted(v, cuts)
            below_p = np.concatenate([[0], np.cumsum(b)])[at]
            below_n = at - below_p
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - here), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule += (best[1],)
        live &= best[1].rows(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule that does best on rows it was not grown on."""
    best, kept = -1.0, rule
    for k in range(1, len(rule) + 1):
        hit = covered(rule[:k], x, len(bad))
        if (s := _score(bad[hit].sum(), (~bad[hit]).sum())) > best + 1e-12:
            best, kept = s, rule[:k]
    return kept


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Sequential covering: an ordered list of rules that reject."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    for _ in range(MAX_RULES):
        rows = np.flatnonzero(left)
        if bad[rows].sum() < MIN_COVER:
            break
        dealt = rng.permutation(rows)
        a, b = dealt[: 2 * len(rows) // 3], dealt[2 * len(rows) // 3 :]
        rule = grow({k: v[a] for k, v in x.items()}, bad[a])
        if not rule:
            break
        rule = prune(rule, {k: v[b] for k, v in x.items()}, bad[b])
        hit = covered(rule, x, len(bad)) & left
        held = covered(rule, {k: v[b] for k, v in x.items()}, len(b))
        right = lambda flags: flags.sum() >= MIN_PRECISION * max(1, len(flags))
        if hit.sum() < MIN_COVER or not right(bad[hit]) or (held.any() and not right(bad[b][held])):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    """Learn from the labelled rows of ``stats``; at most ``limit``, chosen by hash.

    A hash threshold thins the rows where they are, so about ``limit`` of them
    reach the driver however many partitions there are.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    parts = 1_000_000
    share = min(parts, math.ceil(parts * 1.1 * limit / max(1, labels.count())))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    rows = stats.filter(~base_failed() & (chance < share)).select("doc_id", chance.alias("chance"), *[c.alias(k) for k, c in feature_columns().items()]).dropDuplicates(["doc_id"])
    table = rows.join(good, "doc_id").toPandas().sort_values(["chance", "doc_id"]).head(limit)
    if table.empty:
        return []
    return learn({k: table[k].to_numpy(float) for k in FEATURES}, table["bad"].to_numpy(bool))


def decision_list(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, the number of the rule that decided or null) as conditional expressions."""
    kept = F.when(base_failed(), F.lit(False))
    which = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        kept, which = kept.when(test, F.lit(False)), which.when(test, F.lit(i))
    return kept.otherwise(F.lit(True)), which.otherwise(F.lit(None).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that the list keeps.

    Their statistics are taken a second time, in the stage that filters, rather
    than joined back to the texts.
    """
    kept, _ = decision_list(fit(materialize(statistics(docs), "statistics"), labels))
    return statistics(docs, columns).filter(kept).select(*columns)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict for every row of ``docs``."""
    stats = materialize(statistics(docs), "statistics")
    kept, which = decision_list(fit(stats, labels))
    return stats.select("*", base_failed().alias("base_failed"), kept.alias("kept"), which.alias("rule"))
