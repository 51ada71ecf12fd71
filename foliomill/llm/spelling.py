"""Grouping of spelling variants: words one code point apart, each led to its commonest form.

Words are joined by a rare-first prefix filter.  A word's bigrams, each with its
place, are ordered by how many words hold the bigram; an edit touches two of them
at most, so of the three rarest of either word one is in both, at the same place
or one place on.  Only these three meet in the join; letter sets and a bounded edit
distance decide inside it, so what does not match is never written.

Cases: a null text has no words; a null ``doc_id`` counts as the empty string when
places are hashed; equal rows count each; an empty table gives an empty one; a word
without near words has no form and is its own root.  Columns besides ``doc_id`` and
``text`` are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import ascii_lower, flushed
from .store import drop, materialize

RUN = re.compile("[a-zÀ-ÿ]+")
#: bigrams that the join looks at: one edit touches two
RAREST = 3
#: rounds of pointer doubling: counts at least double along a chain, so it has below 64 steps
ROUNDS = 6


def noised(run: str, h: int) -> str:
    """The run, or the run without one code point where 97 divides its hash."""
    at = h % len(run)
    return run if h % 97 else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences."""

    def add(total: Counter, batch: pa.RecordBatch, row: int) -> None:
        text = batch.column(1)[row].as_py()
        if not text:
            return
        doc = batch.column(0)[row].as_py()
        before = zlib.crc32(b":" if doc is None else b"%d:" % doc)
        runs = RUN.findall(ascii_lower(text))
        crc = zlib.crc32
        # counts of the runs, then the few that lose a code point
        changed = [r for r in set(runs) if not crc(r.encode(), before) % 97]
        if changed:
            counted = Counter(runs)
            for r in changed:
                n = counted.pop(r)
                kept = noised(r, crc(r.encode(), before))
                if len(kept) >= least_chars:
                    total[kept] += n
            for r, n in counted.items():
                if len(r) >= least_chars:
                    total[r] += n
        else:
            total.update([r for r in runs if len(r) >= least_chars])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = picked.mapInArrow(lambda b: flushed(b, add, "word"), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram's place when the rarest comes first; the alphabet of runs has 90 letters, so at most 8,100."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counted = words.filter(F.length("word") >= 2).select(F.explode(pairs).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counted, key=lambda r: (r["count"], r["gram"])))}


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(bigram's place in the order, place in the word) of the rarest bigrams."""
    return sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:RAREST]


def letters(word: str) -> int:
    """A set of the word's letters as bits; an edit changes two bits at most."""
    bits = 0
    for c in set(word):
        bits |= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def prefixes(words: DataFrame) -> DataFrame:
    """(gram, at, chars, letters, word, n): a row for each of a word's rarest bigrams."""
    shared = words.sparkSession.sparkContext.broadcast(bigram_order(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(g, at, len(w), letters(w), w, c) for w, c in zip(words, n) for g, at in prefix(w, order)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 6, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["gram", "at", "chars", "letters", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "gram int, at int, chars int, letters long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words one inserted, deleted or replaced code point apart, once.

    ``a`` is the shorter, or of two as long the first.  Words need four code points
    or more, so that each has three bigrams.
    """
    rows = materialize(prefixes(words), "prefixes")
    other = rows.select("gram", "at", "chars", F.col("letters").alias("b_letters"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    here = F.array(F.struct(F.col("at"), F.col("chars")), F.struct(F.col("at"), (F.col("chars") + 1).alias("chars")), F.struct((F.col("at") + 1).alias("at"), (F.col("chars") + 1).alias("chars")))
    # of a longer word the bigram is at the same place or one on; of one as long at the same
    meets = rows.select("gram", F.explode(here).alias("to"), F.col("chars").alias("a_chars"), "letters", F.col("word").alias("a"), F.col("n").alias("a_n"))
    meets = meets.select("gram", F.col("to.at").alias("at"), F.col("to.chars").alias("chars"), "a_chars", "letters", "a", "a_n")
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("b_letters"))) <= 2
    m, o = meets.alias("m"), other.alias("o")
    keys = (F.col("m.gram") == F.col("o.gram")) & (F.col("m.at") == F.col("o.at")) & (F.col("m.chars") == F.col("o.chars"))
    once = (F.col("a_chars") < F.col("m.chars")) | (F.col("a") < F.col("b"))
    near = once & alike & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)
    return m.join(o, keys & near).select("a", "a_n", "b", "b_n").distinct()


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the commonest near word where it has twice the count or more."""
    pairs = materialize(near_pairs(words), "near_pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    leads = -F.col("best.minus") >= 2 * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.minus")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for each row of ``links`` (word, form): the last word along the forms, by pointer doubling."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = materialize(at.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = stepped.filter("moved").limit(1).count()
        drop(at)
        at = stepped.select("word", "root")
        at._foliomill_path = stepped._foliomill_path
        if not moved:
            break
    return at


def variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """Every word with its near words counted, its form and its root."""
    words = materialize(word_counts(docs, least_chars, least_n), "vocabulary")
    found = materialize(forms(words), "forms")
    last = roots(found.filter(F.col("form").isNotNull()).select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
