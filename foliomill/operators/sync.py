"""Three-way synchronisation: two copies that changed since a common state, merged field by field.

One exchange brings the three versions of a record together.  A field that one side
changed takes that side's value; one that both changed alike is no conflict.  Where
both changed it differently, or one side deleted a record that the other changed,
there is a conflict, which a policy resolves:

- ``keep_local`` and ``keep_remote`` take that side, deletions included;
- ``keep_both`` keeps the local record and adds the remote one as a copy;
- ``merge`` joins texts by a newline, unites lists, takes the larger of other values,
  and prefers a changed record to a deletion.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of the three versions that a task brings together
TASK_ROWS = 1_000_000

POLICIES = ("keep_local", "keep_remote", "keep_both", "merge")


def versions(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, b, l, r): the three versions of each record as structs, null where it is not.

    Keys are distinct in each of the three; null keys are keys like others.  A task
    sorts some ``TASK_ROWS`` rows, however many there are in all.
    """
    kind = base.select(F.struct(*fields).alias("x")).schema["x"].dataType
    wide = [df.select(*keys, *[(F.struct(*fields) if s == side else F.lit(None)).cast(kind).alias(s) for s in "blr"]) for side, df in zip("blr", (base, local, remote))]
    rows = reduce(DataFrame.unionByName, wide)
    tasks = rows.count() // TASK_ROWS
    if tasks > int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, *keys)
    return rows.groupBy(*keys).agg(*[F.first(s, ignorenulls=True).alias(s) for s in "blr"])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _both_changed(f: str) -> Column:
    b, l, r = (F.col(f"{s}.{f}") for s in "blr")  # noqa: E741
    return ~_same(l, b) & ~_same(r, b) & ~_same(l, r)


def _clash(fields: list[str]) -> tuple[Column, Column]:
    """Whether fields clash between two records, and whether a deletion clashes with a change."""
    there = lambda s: F.col(s).isNotNull()
    in_fields = there("l") & there("r") & reduce(or_, [_both_changed(f) for f in fields])
    deleted = there("b") & ((there("l") & ~there("r") & ~_same(F.col("l"), F.col("b"))) | (there("r") & ~there("l") & ~_same(F.col("r"), F.col("b"))))
    return in_fields, deleted


def _joined(kind: T.DataType, l: Column, r: Column) -> Column:  # noqa: E741
    if isinstance(kind, T.StringType):
        return F.concat_ws("\n", l, r)
    if isinstance(kind, T.ArrayType):
        return F.array_union(F.coalesce(l, r), F.coalesce(r, l))
    return F.greatest(l, r)


def merged(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], fields: list[str], policy: str = "keep_local") -> DataFrame:
    """(keys, fields, copy): the synchronised records; ``copy`` marks a remote one that stands beside a local one."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    v = versions(base, local, remote, keys, fields)
    in_fields, deleted = _clash(fields)
    there = lambda s: F.col(s).isNotNull()

    def value(f: str) -> Column:
        b, l, r = (F.col(f"{s}.{f}") for s in "blr")  # noqa: E741
        clash = {"keep_local": l, "keep_remote": r, "keep_both": l, "merge": _joined(base.schema[f].dataType, l, r)}[policy]
        both = F.when(_same(l, b), r).when(_same(r, b) | _same(l, r), l).otherwise(clash)
        return F.when(there("l") & there("r"), both).when(there("l"), l).otherwise(r).alias(f)

    # a record that one side lacks: new on the other, deleted, or deleted and changed
    lives = {"keep_local": there("l"), "keep_remote": there("r"), "keep_both": F.lit(True), "merge": F.lit(True)}[policy]
    stays = (there("l") & there("r")) | (~there("b") & (there("l") | there("r"))) | (deleted & lives)
    main = F.struct(*[value(f) for f in fields], F.lit(False).alias("copy"))
    if policy != "keep_both":
        return v.filter(stays).select(*keys, main.alias("x")).select(*keys, "x.*")
    # both rows of a record are made where its versions meet, so these meet once
    copy = F.struct(*[F.col(f"r.{f}").alias(f) for f in fields], F.lit(True).alias("copy"))
    return v.select(*keys, F.explode(F.array_compact(F.array(F.when(stays, main), F.when(in_fields, copy)))).alias("x")).select(*keys, "x.*")


def conflicts(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, base, local, remote): each clash of a field, or of a whole record where one side deleted it; values as text."""
    v = versions(base, local, remote, keys, fields)
    _, deleted = _clash(fields)
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    text = lambda s, f: F.col(f"{s}.{f}").cast("string")
    one = [F.when(there & _both_changed(f), F.struct(F.lit(f).alias("field"), text("b", f).alias("base"), text("l", f).alias("local"), text("r", f).alias("remote"))) for f in fields]
    state = lambda s: F.when(F.col(s).isNull(), "deleted").otherwise("changed")
    whole = F.when(deleted, F.struct(F.lit("*").alias("field"), F.lit("there").alias("base"), state("l").alias("local"), state("r").alias("remote")))
    return v.select(*keys, F.explode(F.array_compact(F.array(*one, whole))).alias("x")).select(*keys, "x.*")


def changes(base: DataFrame, side: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change): what a side added, modified and deleted since the common state."""
    v = versions(base, side, side, keys, fields).select(*keys, "b", "l")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("l").isNull(), "deleted").when(~_same(F.col("b"), F.col("l")), "modified")
    return v.select(*keys, kind.alias("change")).filter("change is not null")
