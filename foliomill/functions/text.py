"""Full-text search: tokens, phrases, BM25, snippets, weighted term scores, highlights."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
MARK = ("<mark>", "</mark>")


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: a light stemmer: ending, what replaces it, in order
ENDINGS = [("sses$", "ss"), ("ies$", "y"), ("(?<=[a-z]{3})ing$", ""), ("(?<=[a-z]{3})ed$", ""), ("(?<=[a-z]{3})ly$", ""), ("(?<=[a-z]{2}[^s])s$", "")]


def stem(word: Column) -> Column:
    for ending, new in ENDINGS:
        word = F.regexp_replace(word, ending, new)
    return word


def stem_word(word: str) -> str:
    """``stem`` for a query's words."""
    for ending, new in ENDINGS:
        word = re.sub(ending, new, word)
    return word


def query_mode(raw: str) -> tuple[str, list[str]]:
    """('phrase' | 'and' | 'or', terms): several words are a phrase unless joined by AND or OR."""
    text = raw.strip()
    for op in ("AND", "OR"):
        if f" {op} " in text:
            return op.lower(), [t.strip().strip('"').lower() for t in text.split(f" {op} ") if t.strip()]
    return "phrase", [w for w in re.split(r"[^\w]+", text.strip('"').lower()) if w]


def postings(docs: DataFrame, id_col: str, text: str, stemmed: bool = False) -> DataFrame:
    """(id, position, term), the inverted index as rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text))).alias("position", "term"))
    return rows.withColumn("term", stem(F.col("term"))) if stemmed else rows


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(docs: DataFrame, id_col: str, text: str, query: str, limit: int = 20, offset: int = 0, stemmed: bool = False) -> DataFrame:
    """(id, score) of the best matches; ties by id.

    One pass aggregates each document's length and the counts of the query's terms
    with higher-order functions, so no token is shuffled; only documents that hold
    every term (any, for OR) go on.  A phrase also needs its words in sequence.  A
    text that lacks a term's characters is not cut into words to be scored.
    """
    mode, terms = query_mode(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    words = tokens(F.col(text))
    if stemmed:
        words, terms = F.transform(words, lambda w: stem(w)), [stem_word(t) for t in terms]
    base = docs.select(F.col(id_col).alias("id"), words.alias("w"), F.lower(text).alias("low"))
    tf = [_count("w", t).alias(f"tf{i}") for i, t in enumerate(terms)]
    either = or_ if mode == "or" else and_
    in_order = F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.lit(f" {' '.join(terms)} ")) if mode == "phrase" and len(terms) > 1 else F.lit(True)
    counted = base.select("id", F.size("w").alias("n"), *tf)
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    may_hold = F.lit(True) if stemmed else reduce(either, [F.contains("low", F.lit(t)) for t in terms])
    holds = reduce(either, [F.array_contains("w", t) for t in terms]) & in_order
    scored = base.filter(may_hold & holds).select("id", F.size("w").alias("n"), *tf).crossJoin(F.broadcast(totals))  # one row of totals
    part = [
        F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        for i in range(len(terms))
    ]
    return scored.select("id", reduce(lambda a, b: a + b, part).alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def like_search(docs: DataFrame, id_col: str, text: str, phrase: str, before: int = 50, width: int = 150) -> DataFrame:
    """(id, snippet, char_offset, char_end) of the rows that hold ``phrase``, in any case."""
    needle = phrase.strip().strip('"').lower()
    at = F.instr(F.lower(F.col(text)), needle)
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("_t"), at.alias("at")).filter("at > 0").select("id", F.substring("_t", F.greatest(F.lit(1), F.col("at") - before), F.lit(width)).alias("snippet"), (F.col("at") - 1).alias("char_offset"), (F.col("at") - 1 + len(needle)).alias("char_end"))


def snippet(c: Column, phrase: str, around: int = 32) -> Column:
    """Text around the first occurrence, marked, with ellipses where it is cut."""
    needle = phrase.lower()
    at = F.instr(F.lower(c), needle)
    start, end = F.greatest(F.lit(1), at - around), at + len(needle) + around
    hit = F.substring(c, at, F.lit(len(needle)))
    body = F.concat(F.substring(c, start, at - start), F.lit(MARK[0]), hit, F.lit(MARK[1]), F.substring(c, at + len(needle), F.lit(around)))
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end <= F.length(c), "...").otherwise("")))


def occurrences(sections: DataFrame, text: str, phrase: str) -> DataFrame:
    """All rows of ``sections`` with ``n`` occurrences of ``phrase`` and the first ``offset``."""
    low, needle = F.lower(F.col(text)), phrase.lower()
    n = (F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / len(needle)
    return sections.withColumn("n", n.cast("int")).withColumn("offset", F.instr(low, needle) - 1).filter("n > 0")


def first_section(sections: DataFrame, key: str, order: str, text: str, phrase: str) -> DataFrame:
    """The first section of each key that holds the phrase, or else its first half."""
    low = F.lower(F.col(text))
    half = phrase[: max(1, len(phrase) // 2)]
    rank = F.when(low.contains(phrase.lower()), 0).when(low.contains(half.lower()), 1)
    w = Window.partitionBy(key).orderBy("_rank", order)
    return sections.withColumn("_rank", rank).filter("_rank is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_rank")


def term_score(query: str, title: Column, authors: Column, tags: Column, comment: Column) -> Column:
    """2 for each term in the title, 1.5 for each author and term, 1 for each tag and term, .5 in the comment."""
    terms = query.lower().split()
    in_text = lambda c, w: sum((F.when(F.coalesce(F.lower(c), F.lit("")).contains(t), F.lit(w)).otherwise(0.0) for t in terms), F.lit(0.0))
    held = lambda c, t: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.lower(v).contains(t)))
    in_list = lambda c, w: sum((held(c, t) * F.lit(w) for t in terms), F.lit(0.0))
    return in_text(title, 2.0) + in_list(authors, 1.5) + in_list(tags, 1.0) + in_text(comment, 0.5)


def highlight(c: Column, term: str, tag: str = "mark") -> Column:
    return F.regexp_replace(c, f"(?i)({re.escape(term)})", f"<{tag}>$1</{tag}>")


def boosted(fields: dict[str, tuple[Column, float]], query: str, mode: str = "OR", fuzziness: int = 1) -> Column:
    """Score of a boolean query over boosted fields; FUZZY allows an edit distance per word."""
    mode_terms = [t.strip('"').lower() for t in re.findall(r'"[^"]+"|\S+', query) if t.upper() not in ("AND", "OR")]

    def found(c: Column, t: str) -> Column:
        if mode == "FUZZY":
            return F.exists(tokens(c), lambda w: F.levenshtein(w, F.lit(t)) <= fuzziness)
        return F.lower(c).contains(t)

    per_term = []
    for t in mode_terms:
        hits = [F.when(F.coalesce(found(c, t), F.lit(False)), F.lit(float(b))).otherwise(0.0) for c, b in fields.values()]
        per_term.append(reduce(lambda a, b: a + b, hits))
    total = reduce(lambda a, b: a + b, per_term, F.lit(0.0))
    if mode == "AND" and per_term:
        return F.when(reduce(lambda a, b: a & b, [p > 0 for p in per_term]), total).otherwise(0.0)
    return total


#: fixed values: sentiment words
POSITIVE = ["good", "great", "excellent", "wonderful", "amazing", "love", "happy"]
NEGATIVE = ["bad", "terrible", "awful", "hate", "sad", "poor"]


def sentiment(c: Column) -> tuple[Column, Column]:
    """(score, label): lexicon balance by word."""
    w = tokens(c)
    among = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
    score = F.coalesce(F.try_divide((among(POSITIVE) - among(NEGATIVE)).cast("double"), F.size(w).cast("double")), F.lit(0.0))
    return score, F.when(score > 0.01, "positive").when(score < -0.01, "negative").otherwise("neutral")


def statistics(c: Column) -> dict[str, Column]:
    """Characters, words, sentences, means, distinct words, lexical diversity."""
    w = tokens(c)
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: F.trim(s) != "")))
    chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return {
        "chars": F.length(c).cast("long"), "words": F.size(w).cast("long"), "sentences": sentences.cast("long"),
        "avg_word_length": F.round(F.coalesce(F.try_divide(chars.cast("double"), F.size(w).cast("double")), F.lit(0.0)), 6),
        "avg_sentence_length": F.round(F.size(w) / sentences, 6), "unique_words": F.size(F.array_distinct(w)).cast("long"),
        "lexical_diversity": F.round(F.coalesce(F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w).cast("double")), F.lit(0.0)), 6),
    }


def capitalised_runs(c: Column) -> Column:
    """Runs of capitalised words, an approximation of named spans."""
    return F.regexp_extract_all(c, F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), F.lit(1))


def documents_with(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, docs): the number of documents that contain each item's whole ``needle``.

    ``needle`` is in lower case.  The second and third word of a needle of four
    and more, and the second of one of three, stand between white space and so are
    whole words of every document with the needle: candidates join on them.
    Shorter needles may begin and end inside words and are tested in every document.
    """
    w = F.split("needle", r"\s+")
    n = items.select("item_id", "needle", w.alias("w"))
    key = F.when(F.size("w") > 3, F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)))).when(F.size("w") == 3, F.get("w", F.lit(1)))
    keyed = n.withColumn("k", key).select("item_id", "needle", "k")
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    v = F.split("text", r"\s+")
    pairs = F.zip_with(v, F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.concat(v, pairs))).alias("k"))
    hits = words.join(keyed.filter("k is not null"), "k").select("item_id", "doc_id", "needle").distinct()
    long = hits.join(texts, "doc_id").filter(F.contains(F.col("text"), F.col("needle"))).select("item_id")
    short = texts.join(keyed.filter("k is null and needle is not null").select("item_id", "needle"), F.contains(F.col("text"), F.col("needle"))).select("item_id")
    found = long.unionByName(short).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))
