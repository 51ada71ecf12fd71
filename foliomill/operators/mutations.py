"""Mutations as functions: each returns the new relation, ready to be written."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, key: Any, values: dict[str, Any], id_col: str = "id") -> DataFrame:
    """The given columns of one row set; all other rows and columns as they are."""
    hit = F.col(id_col) == key
    return df.select(*[F.when(hit, F.lit(values[c])).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, keys: list, id_col: str = "id") -> DataFrame:
    return df.filter(~F.col(id_col).isin(keys))


def missing_references(wanted: DataFrame, entity: DataFrame, key: str) -> DataFrame:
    """Requested ids that do not exist; an insert goes ahead only if this is empty."""
    return wanted.select(F.col(key).alias("id")).distinct().join(entity.select("id"), "id", "left_anti")


def restrict_delete(entity: DataFrame, link: DataFrame, key: str, id_: int) -> DataFrame:
    """The entity removed, unless a link still refers to it."""
    used = link.filter(F.col(key) == id_).select(F.col(key).alias("id")).distinct()
    doomed = entity.filter(F.col("id") == id_).join(used, "id", "left_anti").select("id")
    return entity.join(doomed, "id", "left_anti")


def add_unique(entity: DataFrame, new: DataFrame, name: str = "name", normalise=lambda c: c) -> DataFrame:
    """New rows whose normalised name is not there yet, in any case."""
    cleaned = new.withColumn(name, normalise(F.col(name)))
    w = Window.partitionBy(F.lower(name)).orderBy("id")
    first = cleaned.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    taken = entity.select(F.lower(name).alias("_k")).distinct()
    fresh = first.withColumn("_k", F.lower(name)).join(taken, "_k", "left_anti").drop("_k")
    return insert(entity, fresh)


def replace_links(link: DataFrame, new: DataFrame, owner: str = "book") -> DataFrame:
    """All links of the owners in ``new`` replaced by the new ones."""
    return link.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def merge_keys(link: DataFrame, key: str, sources: list[int], target: int, owner: str = "book") -> DataFrame:
    """Links of the sources moved to the target, without duplicates."""
    return link.withColumn(key, F.when(F.col(key).isin(sources), F.lit(target)).otherwise(F.col(key))).dropDuplicates([owner, key])


def affected(link: DataFrame, key: str, sources: list[int], owner: str = "book") -> DataFrame:
    return link.filter(F.col(key).isin(sources)).agg(F.countDistinct(owner).alias("affected"))


def drop_unused(entity: DataFrame, link: DataFrame, key: str) -> DataFrame:
    return entity.join(link.select(F.col(key).alias("id")), "id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows merged by key: new values that are not null win."""
    values = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    on = None
    for k in keys:
        test = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = test if on is None else on & test
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in [*keys, *values]]
    return o.join(n, on, "full").select(*pick)


def append_text(old: DataFrame, new: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Comments merged by key: new text goes below the old."""
    o, n = old.select(*keys, F.col(text).alias("_o")), new.select(*keys, F.col(text).alias("_n"))
    return o.join(n, keys, "full").select(*keys, F.concat_ws("\n", "_o", "_n").alias(text))


def latest(df: DataFrame, keys: list[str], ts: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key, by one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def clamp_percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def percent_done(current: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(current * 100.0, total.cast("double")), F.lit(0.0)), 1)


def pivot_updates(updates: DataFrame, fields: list[str]) -> DataFrame:
    """(book, field, value) triples as one row per book, with what is invalid named."""
    wide = updates.groupBy("book").pivot("field", fields).agg(F.last("value"))
    bad = []
    if "rating" in fields:
        bad.append(F.when(F.col("rating").isNotNull() & ~F.coalesce(F.col("rating").try_cast("int").between(1, 5), F.lit(False)), F.lit("rating")))
    if "pubdate" in fields:
        bad.append(F.when(F.col("pubdate").isNotNull() & F.try_to_date("pubdate", "yyyy-MM-dd").isNull(), F.lit("pubdate")))
    return wide.withColumn("invalid", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))


def batches(df: DataFrame, size: int, order: str = "id") -> DataFrame:
    """Consecutive batch numbers over ranges of ids; no global sort is needed."""
    return df.withColumn("batch", F.floor(F.col(order) / size).cast("long"))


def tally(df: DataFrame, ok: Column) -> DataFrame:
    return df.groupBy(F.when(ok, "success").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def needs_conversion(books: DataFrame, target: str, formats: str = "formats") -> DataFrame:
    """Books that do not have the target format yet."""
    return books.filter(~F.array_contains(F.transform(formats, F.lower), target.lower()))


def keep_newest(backups: DataFrame, k: int, ts: str = "modified", tie: str = "path") -> DataFrame:
    """The backups that go: all but the newest ``k``, which are a top-k and few enough to broadcast."""
    stay = backups.orderBy(F.desc(ts), tie).limit(k).select(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"))
    return backups.join(F.broadcast(stay), F.col(ts).eqNullSafe(F.col("_ts")) & F.col(tie).eqNullSafe(F.col("_tie")), "left_anti")


def target_path(author: Column, series: Column, index: Column, title: Column, ext: Column) -> Column:
    """author/series/NNN - title.ext; without a series author/title.ext."""
    return F.when(series.isNotNull(), F.concat_ws("/", author, series, F.format_string("%03d - %s.%s", index.cast("int"), title, ext))).otherwise(F.concat_ws("/", author, F.format_string("%s.%s", title, ext)))


def glob_match(name: Column, pattern: str) -> Column:
    """File names that match a shell pattern."""
    import fnmatch

    body = fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "")
    return name.rlike(f"^{body}$")


def transition(jobs: DataFrame, job: Any, allowed: list[str], to: str) -> DataFrame:
    """One job moved to a state if its present state allows it."""
    return jobs.withColumn("status", F.when((F.col("id") == job) & F.col("status").isin(allowed), F.lit(to)).otherwise(F.col("status")))


def toggle(rows: DataFrame, new: DataFrame, add: bool) -> DataFrame:
    """Set membership (favourites, follows): rows added once, or removed."""
    return rows.unionByName(new).dropDuplicates() if add else rows.join(new.dropDuplicates(), rows.columns, "left_anti")
