"""Duplicate detection: blocking, weighted similarity, fuzzy groups of names."""

from __future__ import annotations

import uuid
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.session import shared_folder


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; Spark has none."""
    return F.pandas_udf(_ratios, "double")(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _may_reach(a: Column, b: Column, least: float) -> Column:
    """The ratio is at most 2 min / (sum of lengths): what cannot reach ``least`` is left out."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b)) - 1e-9


def _numbered(parts: Column) -> Column:
    """Each element with the number of its occurrence, so that sets overlap as the lists do."""
    return F.transform(parts, lambda x, i: F.concat(x, F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _spans(c: Column, width: int) -> Column:
    """The runs of ``width`` characters of a text that is long enough, numbered."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(width)))
    return F.when(F.length(c) >= width, _numbered(some)).otherwise(F.array().cast("array<string>"))


def _rarest(texts: DataFrame, width: int, need: Column) -> DataFrame:
    """(low, first): of each text the first spans, the rarest first: all but ``need`` - 1.

    Two texts that share ``need`` spans share one of the first.
    """
    each = texts.select("low", F.explode(_spans(F.col("low"), width)).alias("span"))
    often = each.groupBy("span").agg(F.count("*").alias("often"))
    order = each.join(often, "span").groupBy("low").agg(F.sort_array(F.collect_list(F.struct("often", "span"))).alias("order"))
    spans = F.transform("order", lambda s: s["span"])
    return order.select("low", F.slice(spans, F.lit(1), F.greatest(F.size("order") - need + 1, F.lit(0))).alias("first"))


def _met(named: DataFrame, first: DataFrame, least: float, before: Column) -> DataFrame:
    """Pairs of rows that share a first span and have letters enough in common, each at the rarest span that they share."""
    columns = named.columns
    rows = named.join(first, "low").withColumn("letters", _spans(F.col("low"), 1)).withColumn("k", F.explode("first"))
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.k") == F.col("b.k")) & before & _may_reach(F.col("a.low"), F.col("b.low"), least))
    once = F.element_at(F.array_intersect("a.first", "b.first"), 1) == F.col("a.k")
    common = F.size(F.array_intersect("a.letters", "b.letters"))
    kept = pairs.filter(once & (2 * common >= least * (F.length("a.low") + F.length("b.low")) - 1e-9))
    return kept.select(*[F.struct(*[f"{side}.{c}" for c in columns]).alias(side) for side in ("a", "b")])


def _candidates(n: DataFrame, least: float, before: Column) -> DataFrame:
    """Pairs (a, b) of rows of ``n``, which has ``low``, that can reach ``least``; none that does is left out.

    The ratio is 2 m / (sum of lengths) with m matched characters.  They lie in at
    most (1 - ratio) * (sum of lengths) + 1 runs, since between two runs some
    character is unmatched, so a pair that reaches ``least`` shares m - runs bigrams
    or more; its shorter name has least / (2 - least) of the longer one's length.
    Names meet by the rarest of their bigrams.  A pair of which one name is too
    short to be sure of a shared bigram meets by its rarest letters.
    """
    part = least / (2 - least)
    named = n.filter("low is not null")
    texts = named.select("low").distinct()
    sure = (1 + part) * (1.5 * least - 1)  # bigrams a character, less one
    short = 1 / sure if sure > 0 else float("inf")
    chars = F.length("low")
    letters = _rarest(texts.filter((chars > 0) & (chars <= short / part)), 1, F.ceil(chars * part - 1e-9).cast("int"))
    empty = texts.filter(chars == 0).select("low", F.array(F.lit("")).alias("first"))
    by_letters = _met(named, letters.unionByName(empty), least, before)
    if sure <= 0:
        return by_letters
    is_short = (F.length("a.low") <= short) | (F.length("b.low") <= short)
    bigrams = _rarest(texts.filter(chars > short), 2, F.ceil(chars * sure - 1 - 1e-9).cast("int"))
    return _met(named, bigrams, least, before).unionByName(by_letters.filter(is_short))


def similar_pairs(names: DataFrame, block: Column | None = None, least: float = 0.8, key: str = "id", name: str = "name") -> DataFrame:
    """Pairs of names whose ratio reaches ``least``: all of them, or those in one ``block``.

    Names are distinct values, not rows.
    """
    n = names.select(F.col(key).alias("id"), F.lower(name).alias("low"), (F.lit(0) if block is None else block).alias("block"))
    pairs = _candidates(n, least, (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), ratio(F.col("a.low"), F.col("b.low")).alias("similarity")).filter(F.col("similarity") >= least)


def greedy_groups(rows: pd.DataFrame, least: float) -> list[list[int]]:
    """Groups in id order: an unassigned name takes every later unassigned one that is like it."""
    rows = rows.sort_values("id")
    ids, names = rows["id"].tolist(), [str(n).lower() for n in rows["name"]]
    taken: set[int] = set()
    out = []
    for i, a in enumerate(names):
        if i in taken:
            continue
        group = [i] + [j for j in range(i + 1, len(names)) if j not in taken and SequenceMatcher(None, a, names[j]).ratio() >= least]
        if len(group) > 1:
            taken |= set(group)
            out.append([ids[j] for j in group])
    return out


def _groups_of_pairs(names: DataFrame, least: float) -> DataFrame:
    """``fuzzy_groups`` over all names: ``greedy_groups`` in rounds over the similar pairs.

    A name that no earlier open name is like leads; the names it is like are taken.
    A taken name goes to the first leader that it is like.  Each round's tables are
    written to the shared folder, so a lost executor costs no round.
    """
    spark, folder = names.sparkSession, f"{shared_folder(names.sparkSession)}/groups-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = written(similar_pairs(names, None, least).select("a", "b"), "edges")
    open_, number = edges, 0
    while not open_.isEmpty():
        lead = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = written(open_.join(lead, "a", "left_semi").select("b").distinct(), f"taken/round={number}")
        open_ = written(open_.join(new, "b", "left_anti").join(new.withColumnRenamed("b", "a"), "a", "left_anti"), f"open-{number}")
        number += 1
    if not number:
        return names.select(F.col("id").cast("long").alias("canonical"), F.array(F.col("id").cast("long")).alias("members")).limit(0)
    taken = spark.read.schema(edges.select("b").schema).parquet(f"{folder}/taken").select("b")
    owned = edges.join(taken, "b", "left_semi").join(taken.withColumnRenamed("b", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("a"))
    members = owned.select("a", F.col("b").alias("id")).unionByName(owned.select("a", F.col("a").alias("id")).distinct())
    used = members.join(names.select("id", "books"), "id").withColumn("id", F.col("id").cast("long"))
    return used.groupBy("a").agg(F.max_by("id", F.struct("books", -F.col("id"))).alias("canonical"), F.array_sort(F.collect_list("id")).alias("members")).select("canonical", "members")


def fuzzy_groups(names: DataFrame, block: Column | None = None, least: float = 0.8) -> DataFrame:
    """(canonical, members): greedy groups of all names, or in each ``block``; the most used name stands for its group.

    ``names`` has id, name and books (its number of uses).
    """
    if block is None:
        return _groups_of_pairs(names, least)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        used = dict(zip(rows["id"], rows["books"]))
        groups = greedy_groups(rows, least)
        best = [max(g, key=lambda i: (used[i], -i)) for g in groups]
        return pd.DataFrame({"canonical": pd.Series(best, dtype="int64"), "members": pd.Series(groups, dtype="object")})

    return names.select("id", "name", "books", block.alias("block")).groupBy("block").applyInPandas(run, "canonical long, members array<long>")


def weighted_duplicates(df: DataFrame, block: Column, fields: dict[str, tuple[str, float]], least: float, key: str = "id") -> DataFrame:
    """Pairs in one block by the weighted mean of field similarities.

    A field's kind is ``text`` (edit similarity), ``set`` (overlap of lists) or ``exact``.
    Values are compared once, however many rows have them, and only with those whose
    exact fields leave ``least`` in reach.
    """
    columns = [F.col(c).alias(c) for c in fields]
    n = df.select(F.col(key).alias("id"), block.alias("block"), *columns)
    kinds = {
        "text": lambda x, y: edit_similarity(F.lower(x), F.lower(y)),
        "set": lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0)),
        "exact": lambda x, y: F.when(x == y, 1.0).otherwise(0.0),
    }
    parts = [(kinds[kind](F.col(f"a.{c}"), F.col(f"b.{c}")), w) for c, (kind, w) in fields.items()]
    total = sum(w for _, w in parts)
    score = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in parts), F.lit(0.0)) / total
    needed = ["block", *[c for c, (kind, w) in fields.items() if kind == "exact" and (total - w) / total < least - 1e-9]]
    values = n.select("block", *fields).distinct()
    compared = values.alias("a").join(values.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in needed]))
    alike = compared.select(F.struct("a.*").alias("x"), F.struct("b.*").alias("y"), score.alias("similarity")).filter(F.col("similarity") >= least)
    own = lambda side, value: reduce(lambda x, y: x & y, [F.col(f"{side}.{c}").eqNullSafe(F.col(f"{value}.{c}")) for c in ("block", *fields)])
    pairs = alike.join(n.alias("a"), own("a", "x")).join(n.alias("b"), own("b", "y") & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "similarity")


#: longest part of a tag by which the tags that contain it are found
PART = 4


def _parts(names: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else sorted({x[i : i + q] for q in range(PART + 1) for i in range(len(x) - q + 1)}) for x in names])


def similar_tags(tags: DataFrame, least: float = 0.8) -> DataFrame:
    """(tag, canonical): the shorter of two tags that are alike or contain one another.

    Alike tags come from ``_candidates``; a tag is met by its first characters
    with every tag that has them anywhere.  Both are equi-joins that lose no pair.
    """
    n = tags.select("name", F.lower(F.trim("name")).alias("low"))
    shorter = (F.length("a.low") < F.length("b.low")) | ((F.length("a.low") == F.length("b.low")) & (F.col("a.low") < F.col("b.low")))
    kept = [F.col("a.name").alias("canonical"), F.col("b.name").alias("tag")]
    alike = _candidates(n, least, shorter).filter(ratio(F.col("a.low"), F.col("b.low")) >= least).select(*kept)
    whole = n.withColumn("k", F.substring("low", 1, PART)).alias("a")
    parts = n.withColumn("k", F.explode(F.pandas_udf(_parts, "array<string>")("low"))).alias("b")
    inside = whole.join(parts, (F.col("a.k") == F.col("b.k")) & shorter & F.contains(F.col("b.low"), F.col("a.low"))).select(*kept)
    return alike.unionByName(inside).groupBy("tag").agg(F.min_by("canonical", F.struct(F.length("canonical"), "canonical")).alias("canonical"))


def clean_tags(rows: DataFrame, tags: str, shortest: int = 2, longest: int = 50) -> DataFrame:
    """Tag arrays with blanks, too short and too long ones dropped, words capitalised, duplicates removed."""
    from foliomill.functions.scalars import tag_words

    kept = F.filter(F.col(tags), lambda t: (F.trim(t) != "") & F.length(F.trim(t)).between(shortest, longest))
    new = F.array_distinct(F.transform(kept, tag_words))
    return rows.withColumn("cleaned", new).withColumn("changed", F.array_sort(F.array_distinct(tags)) != F.array_sort("cleaned"))
