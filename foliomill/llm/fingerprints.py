"""Merkle fingerprints of texts, in DataFrame functions only.

A text is cut into paragraphs where its own characters say so: after a line's or
sentence's closing marks, and, as texts may have none, after a few rare letters, one
digit, and one in 82 of the ideographs.  Each cut depends on one character class,
never on a length, so cuts before and after an edit stay where they were.  Each paragraph's digest is a
leaf.  Sections are runs of leaves that end where a leaf's digest ends in 0, so an
insertion moves only the section it falls in.  The root hashes the sections' digests.

A fingerprint is written ``root:section;section`` with each section a list of
leaves.  Likeness walks two trees: equal roots are alike without a look below;
else equal sections count as they stand, and only the leaves of sections that
differ are compared.  ``differing`` numbers those sections: where the edit lies.

Defined results: a null text is an empty one; the fingerprint of an empty text
has no leaves; two empty texts are alike (1.0), an empty and another not (0.0);
repeated rows are reported each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions

#: rows of a range of ids that is sorted on its own, and the most ranges
RANGE_ROWS, MAX_RANGES = 20_000, 10_000
LEAF_DIGITS = 12
#: closing marks, rare letters and a digit, and the wide marks; ideographs; full-width marks.
#: A pattern has one range at most: with more, matching takes ten times as long
CUTS = (r"\x{7000}-\x{70FF}", r"\x{FF00}-\x{FF1F}", r"\n.!?jqvxz7\x{3000}-\x{303F}")
PARAGRAPHS = tuple(f"[^{c}]*[{c}]+|[^{c}]+" for c in CUTS)


def leaves(text: Column) -> Column:
    """Digests of the paragraphs, in order."""
    by = lambda pattern: lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = by(PARAGRAPHS[0])(F.coalesce(text, F.lit("")))
    for pattern in PARAGRAPHS[1:]:
        parts = F.flatten(F.transform(parts, by(pattern)))
    return F.transform(parts, lambda p: F.substring(F.md5(p.cast("binary")), 1, LEAF_DIGITS))


def sections(leaf: Column) -> Column:
    """Leaves as one string: a section's leaves joined by commas, sections by semicolons."""
    marked = F.transform(leaf, lambda h: F.concat(h, F.when(h.endswith("0"), ";").otherwise(",")))
    return F.regexp_replace(F.array_join(marked, ""), "[,;]$", "")


def printed(body: Column) -> Column:
    """The fingerprint over its leaves, given as ``sections`` writes them."""
    digests = F.transform(F.split(body, ";"), lambda s: F.md5(s.cast("binary")))
    return F.concat(F.md5(F.array_join(digests, "").cast("binary")), F.lit(":"), body)


def fingerprint(leaf: Column) -> Column:
    return printed(sections(leaf))


def with_fingerprint(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` with the fingerprint of ``text``, worked out once."""
    return rows.withColumn(name, sections(leaves(text))).withColumn(name, printed(F.col(name)))


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def sections_of(print_: Column) -> Column:
    """The sections that a fingerprint holds."""
    return F.filter(F.split(F.substring_index(print_, ":", -1), ";"), lambda s: s != "")


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the likeness (0 to 1) of its fingerprint columns ``a`` and ``b``."""
    leaves_in = lambda parts: F.flatten(F.transform(parts, lambda s: F.split(s, ",")))
    cut = rows.withColumns({"_a": sections_of(F.col(a)), "_b": sections_of(F.col(b))})
    walked = cut.withColumns({"_same": leaves_in(F.array_intersect("_a", "_b")), "_left": leaves_in(F.array_except("_a", "_b")), "_right": leaves_in(F.array_except("_b", "_a"))})
    same, common, either = F.size("_same"), F.size(F.array_intersect("_left", "_right")), F.size(F.array_union("_left", "_right"))
    like = F.when(root(F.col(a)) == root(F.col(b)), F.lit(1.0)).otherwise((same + common) / (same + either))
    return walked.select(*rows.columns, like.alias(name))


def differing(print_a: Column, print_b: Column) -> Column:
    """Numbers (from 0) of a's sections that b lacks: where to look for the edit."""
    other = sections_of(print_b)
    marked = F.transform(sections_of(print_a), lambda s, i: F.when(~F.array_contains(other, s), i))
    return F.when(root(print_a) == root(print_b), F.array().cast("array<int>")).otherwise(F.array_compact(marked))


def _range_of(tops: list[int]) -> Column:
    """Number of the range of an id: how many of the sorted ``tops`` are below it.

    The tops are cut into blocks; an id is compared with the blocks' tops and then
    within one block, about twice the square root of their number.
    """
    size = max(1, round(len(tops) ** 0.5))
    blocks = [tops[i : i + size] for i in range(0, len(tops), size)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda t: t < F.col("doc_id")))
    block = below(longs([x[-1] for x in blocks]))
    return block * size + F.coalesce(below(F.coalesce(F.get(F.array(*[longs(x) for x in blocks]), block), F.array().cast("array<bigint>"))), F.lit(0))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the next row in descending doc_id, cyclically.

    Ids are cut at quantiles into ranges of about ``RANGE_ROWS`` rows that are
    sorted on their own.  A quantile is an actual id and the greatest of its range,
    so that row is also the successor of the next range's last row: it is copied
    there before sorting.
    """
    n = min(MAX_RANGES, max(partitions(docs.sparkSession), docs.count() // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / n) for i in range(n)]), F.lit(max(10_000, 10 * n))).alias("q"), F.max("doc_id").alias("top")).first()
    tops = sorted({x for x in [*(cuts["q"] or []), cuts["top"]] if x is not None})
    if not tops:  # no ids at all: one range
        bucket, ghost = F.lit(0), F.lit(0)
    else:
        bucket = F.coalesce(_range_of(tops), F.lit(0))
        is_top = F.col("doc_id").isin(tops)
        ghost = F.when(is_top, F.pmod(bucket + 1, F.lit(len(tops))))
    copies = F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("ghost")), F.struct(ghost.alias("bucket"), F.lit(1).alias("ghost")))
    dealt = docs.select("*", F.explode(copies).alias("p")).filter("p.bucket is not null").select(*docs.columns, "p.bucket", "p.ghost").repartition(n, "bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("ghost = 0").drop("bucket", "ghost")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text's last third (of code points, rounded down) is replaced by as
    many first code points of the next document, or all it has.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(with_fingerprint(texts, F.col("text"), "fingerprint"), ["text", "fingerprint"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    made = both.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = with_fingerprint(made.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), F.col("edited"), "edited_fingerprint").drop("edited")
    alike = with_likeness(with_likeness(both, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    where = F.array_join(differing(F.col("fingerprint"), F.col("edited_fingerprint")).cast("array<string>"), ",")
    return alike.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", where.alias("differing_sections"))
