"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the positions of
the same k-gram in known templates: phrases, SPDX tags, license texts and notices.
A match votes for the diagonal (position in the text less position in the
template) and votes are summed by diagonal.  An insertion or deletion shifts the
diagonal by its length, so a text's neighbouring diagonals are merged while each
is within a quarter of the template's length of the next: an edited text is one
alignment, and two copies are two.  An alignment is verified on its span: its
k-grams are equal word for word, they cover half of the template, and the span is
not much longer than what is covered; a phrase needs every one of its k-grams on
one diagonal.

Scale: one pass over the texts.  The template table is a fixed, small literal
(under two thousand rows), so its join is a broadcast with a known bound; texts do
not move, only one row a document and its matches do.

Defined results: a null text has no words; repeated rows are reported each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import SPDX, TEXTS

#: fixed values: the base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: further short phrases of this scanner
MORE_PHRASES = {
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "all rights reserved": "reserved",
}
#: words of a k-gram; a shorter phrase is one k-gram of its own length
K = 3
#: diagonals of a text's template are merged up to this distance, or a share of its k-grams if that is more
MERGE, MERGE_SHARE = 3, 0.25
#: the share of a text's k-grams that must vote, and of the span's words
MIN_SHARE, MIN_DENSITY = 0.5, 1 / 3
#: no verified span is longer than this many words
NEAR = 1024
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> str:
    """Lower-cased words, as texts are cut."""
    return " ".join(w for w in re.split(DELIMITERS, text.lower()) if w)


def templates() -> list[tuple[int, str, str, bool, bool]]:
    """(number, words, label, is base, is a text that may be edited)."""
    rows = [(p, label, True, False) for p, label in PHRASES.items()]
    rows += [(p, label, False, False) for p, label in MORE_PHRASES.items()]
    rows += [(template_words(f"SPDX-License-Identifier: {tag}"), label, False, False) for tag, label in SPDX.items()]
    rows += [(template_words(t), label, False, True) for label, texts in TEXTS.items() for t in texts]
    return [(i, *r) for i, r in enumerate(rows)]


def grams() -> list[tuple[int, int, str, int]]:
    """(template, position, k-gram, how many its template has), for k-grams that are once in their template.

    Others would vote for diagonals between a text's copies.
    """
    out = []
    for number, text, *_ in templates():
        words = text.split()
        k = min(K, len(words))
        cut = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        once = [(i, gram) for i, gram in enumerate(cut) if cut.count(gram) == 1]
        out += [(number, i, gram, len(once)) for i, gram in once]
    return out


def template_table(spark: SparkSession) -> DataFrame:
    meta = {t[0]: t for t in templates()}
    rows = [(number, at, gram, n, len(meta[number][1].split()), *meta[number][2:]) for number, at, gram, n in grams()]
    return spark.createDataFrame(rows, "template int, t_pos int, t_gram string, t_grams int, t_words int, label string, is_base boolean, notice boolean").withColumn("gram_hash", F.xxhash64("t_gram"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its places, labels, score and spans (words, end exclusive)."""
    spark = docs.sparkSession
    known = template_table(spark)
    sizes = sorted({len(g.split()) for _, _, g, _ in grams()})
    by_size = {k: sorted({g for _, _, g, _ in grams() if len(g.split()) == k}) for k in sizes}

    words = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), DELIMITERS)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    # a delimiter at either end leaves an empty word there
    lead = F.when(F.col("w")[0] == "", 1).otherwise(0)
    tail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    shifted = [F.col("w"), *[F.slice("w", F.lit(i + 1), F.size("w")) for i in range(1, K)]]
    windows = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])
    # a select of its own: the words must not be carried along with each of their windows
    cut = rows.select("row", "doc_id", lead.alias("lead"), (F.size("w") - lead - tail).cast("long").alias("n_words"), windows.alias("windows"))
    each = cut.select("row", "doc_id", "lead", "n_words", F.posexplode("windows").alias("at", "x"))

    def gram(k: int) -> Column:
        return F.concat_ws(" ", *[F.col(f"x.w{i}") for i in range(k)])

    def word_hash(words: list) -> Column:
        return F.xxhash64(*words)

    # the hash of a gram's words, for a test of every window without a join
    spark_hashes = spark.createDataFrame([(k, g.split()) for k in sizes for g in by_size[k]], "k int, w array<string>")
    hashes: dict[int, list[int]] = {k: [] for k in sizes}
    for k in sizes:
        hashes[k] = [r.h for r in spark_hashes.filter(F.col("k") == k).select(word_hash([F.col("w")[i] for i in range(k)]).alias("h")).collect()]

    def may_match(k: int) -> Column:
        """Whether a window's first ``k`` words are a template's, by hash."""
        return F.col(f"x.w{k - 1}").isNotNull() & word_hash([F.col(f"x.w{i}") for i in range(k)]).isin(hashes[k])

    hit = F.col("at") == 0
    for k in sizes:
        hit = hit | may_match(k)
    candidate = F.array_compact(F.array(*[F.when(may_match(k), F.struct(F.xxhash64(gram(k)).alias("h"), gram(k).alias("gram"))) for k in sizes]))
    # the first window of a text stays in any case: it carries the document
    kept = each.filter(hit).select("row", "doc_id", "n_words", (F.col("at") - F.col("lead")).alias("pos"), (F.col("at") == 0).alias("first"), candidate.alias("c"))
    found = kept.select("row", "doc_id", "n_words", "first", "pos", F.explode_outer("c").alias("c"))
    matched = found.join(F.broadcast(known), (F.col("c.h") == F.col("gram_hash")) & (F.col("c.gram") == F.col("t_gram")), "left").filter("first or template is not null")

    votes = (
        matched.select("row", "doc_id", "n_words", "pos", "template", "t_pos", "t_grams", "t_words", "label", "is_base", "notice", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .repartition("row")
        .groupBy("row", "template", "diagonal")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "t_grams", "t_words", "label", "is_base", "notice")], F.collect_set("t_pos").alias("voted"))
    )
    # a phrase's alignment is one diagonal; a text's takes in its neighbours
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    reach = F.greatest(F.lit(MERGE), F.col("t_grams") * MERGE_SHARE)
    apart = F.when(F.col("notice") & (F.col("diagonal") - F.lag("diagonal").over(line) <= reach), 0).otherwise(1)
    merged = (
        votes.withColumn("new", apart)
        .withColumn("alignment", F.sum("new").over(line))
        .groupBy("row", "template", "alignment")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "n_words", "t_grams", "t_words", "label", "is_base", "notice")],
            F.min(F.col("diagonal") + F.array_min("voted")).alias("from"), F.max(F.col("diagonal") + F.array_max("voted")).alias("last"),
            F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("n_voted"),
        )
    )
    to = F.col("last") + F.least(F.col("t_words"), F.lit(K))
    share = F.col("n_voted") / F.col("t_grams")
    held = F.when(F.col("notice"), (share >= MIN_SHARE) & (F.col("n_voted") >= MIN_DENSITY * (to - F.col("from")))).otherwise(share >= 1)
    judged = merged.select("*", to.alias("to"), share.alias("share"), F.coalesce(held, F.lit(False)).alias("held"))
    # where texts of two labels overlap (one license quotes another's words), the better match stands
    near = Window.partitionBy("row").orderBy("from").rangeBetween(-NEAR, NEAR)
    of_text = F.when(F.col("held") & F.col("notice"), F.struct("from", "to", "label", "share"))
    judged = judged.withColumn("around", F.collect_list(of_text).over(near))
    overlap = lambda o: F.least(o["to"], F.col("to")) - F.greatest(o["from"], F.col("from"))
    beaten = F.exists("around", lambda o: (o["label"] != F.col("label")) & (o["share"] > F.col("share")) & (overlap(o) * 2 >= F.col("to") - F.col("from")))
    judged = judged.withColumn("verified", F.col("held") & ~(F.col("notice") & F.coalesce(beaten, F.lit(False))))
    verified, share = F.col("verified"), F.col("share")
    base = verified & F.col("is_base")
    labels = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("label")))), ",")
    span = F.when(verified, F.struct(F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), "label", share.alias("share")))
    out = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("from").cast("long"))).alias("first_word"), F.max(F.when(base, F.col("from").cast("long"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    return out.drop("row")
