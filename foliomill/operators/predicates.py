"""Three predicate languages as Column builders.

``search`` (15 operators): case-insensitive, list-aware, errors count as false.
``rules`` (11 operators): case-sensitive, exact elements on lists.
``conditions`` (11 operators): dotted paths, conjunctions, type-guarded.

Every predicate is two-valued: nulls never leak into a filter.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Condition = tuple[str, str, Any]

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def data_type(df: DataFrame, path: str) -> T.DataType | None:
    """Type of a column or dotted path, or null where the path does not exist."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
        else:
            return None
    return kind


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def sure(p: Column) -> Column:
    """A predicate that is false where it is unknown."""
    return F.coalesce(p, F.lit(False))


def _empty(c: Column, kind: T.DataType) -> Column:
    """Null, the empty string, the empty list, or zero."""
    if isinstance(kind, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, NUMERIC):
        return c.isNull() | (c == 0)
    return c.isNull()


def _compare(c: Column, op: str, value: Any) -> Column:
    return {">": lambda: c > value, "<": lambda: c < value, ">=": lambda: c >= value, "<=": lambda: c <= value}[op]()


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, NUMERIC)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _equal(c: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return c.isNull()
    return c.eqNullSafe(F.lit(value)) if _comparable(kind, value) else F.lit(False)


def _listed(c: Column, kind: T.DataType, value: Any) -> Column:
    if not isinstance(value, (list, set, tuple)):
        return c.cast("string") == str(value)
    values = list(value)
    if isinstance(kind, T.ArrayType):
        return F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
    return c.isin([v for v in values if _comparable(kind, v)])


def search(df: DataFrame, field: str, op: str, value: Any = None) -> Column:
    """One condition of the search language."""
    kind = data_type(df, field)
    if kind is None:  # an unknown field is null in every row
        return F.lit(op in ("not_contains", "not_in", "not_exists") or (op == "!=" and value is not None) or (op == "=" and value is None))
    c = F.col(field)
    text, listed = isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
    low = str(value).lower()
    if op == "=":
        p = _equal(c, kind, value)
    elif op == "!=":
        p = ~sure(_equal(c, kind, value))
    elif op in (">", "<", ">=", "<="):
        p = _compare(c, op, F.lit(value)) if _comparable(kind, value) else F.lit(False)
    elif op in ("contains", "not_contains"):
        hit = F.lower(c).contains(low) if text else F.exists(c, lambda v: F.lower(v.cast("string")).contains(low)) if listed else F.lit(False)
        p = sure(hit) if op == "contains" else ~sure(hit)
    elif op == "starts_with":
        p = ~_empty(c, kind) & F.lower(c.cast("string")).startswith(low)
    elif op == "ends_with":
        p = ~_empty(c, kind) & F.lower(c.cast("string")).endswith(low)
    elif op == "regex":
        p = ~_empty(c, kind) & c.cast("string").rlike(f"(?i){value}")
    elif op == "in":
        p = ~_empty(c, kind) & _listed(c, kind, value)
    elif op == "not_in":
        p = _empty(c, kind) | ~sure(_listed(c, kind, value))
    elif op in ("exists", "not_exists"):
        there = c.isNotNull() & (c != "") if text else c.isNotNull()
        p = there if op == "exists" else ~there
    else:
        p = F.lit(False)
    return sure(p)


def search_all(df: DataFrame, conditions: list[Condition], must_match_all: bool = True) -> Column:
    parts = [search(df, *c) for c in conditions]
    return all_of(parts) if must_match_all else any_of(parts)


def rule(df: DataFrame, field: str, op: str, value: Any) -> Column:
    """One rule of a stored collection."""
    kind = data_type(df, field)
    if kind is None:
        return F.lit(op in ("not_contains", "not_in") or (op == "!=" and value is not None) or (op == "==" and value is None))
    c = F.col(field)
    text, listed = isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
    if op == "==":
        p = _equal(c, kind, value)
    elif op == "!=":
        p = ~sure(_equal(c, kind, value))
    elif op in (">", "<", ">=", "<="):
        p = _compare(c, op, F.lit(value)) if _comparable(kind, value) else F.lit(False)
    elif op in ("contains", "not_contains"):
        hit = c.contains(value) if text else F.array_contains(c, value) if listed else F.lit(False)
        p = sure(hit) if op == "contains" else ~sure(hit)
    elif op == "regex":
        p = ~_empty(c, kind) & c.cast("string").rlike(f"(?i){value}")
    elif op == "in":
        p = ~_empty(c, kind) & _listed(c, kind, value)
    elif op == "not_in":
        p = _empty(c, kind) | ~sure(_listed(c, kind, value))
    else:
        p = F.lit(False)
    return sure(p)


def matches_rules(df: DataFrame, rules: list[Condition], match_all: bool = True) -> Column:
    """All rules or any; no rules match every row."""
    parts = [rule(df, *r) for r in rules]
    return all_of(parts) if match_all else any_of(parts)


def condition(df: DataFrame, field: str, op: str, value: Any = None) -> Column:
    """One condition of an organisation rule; ``field`` may be a dotted path."""
    kind = data_type(df, field)
    c = F.col(field) if kind is not None else F.lit(None)
    text, listed, number = isinstance(kind, T.StringType), isinstance(kind, T.ArrayType), isinstance(kind, NUMERIC)
    held = c.contains(value) if text else F.array_contains(c, value) if listed else F.lit(False)
    filled = c.isNotNull() & (c != "") if text else c.isNotNull()
    p = {
        "equals": lambda: _equal(c, kind, value) if kind is not None else F.lit(value is None),
        "not_equals": lambda: ~sure(_equal(c, kind, value) if kind is not None else F.lit(value is None)),
        "contains": lambda: held,
        "not_contains": lambda: ~sure(held),
        "starts_with": lambda: c.startswith(value) if text else F.lit(False),
        "ends_with": lambda: c.endswith(value) if text else F.lit(False),
        "matches_regex": lambda: c.rlike(value) if text else F.lit(False),
        "greater_than": lambda: c > F.lit(value) if number else F.lit(False),
        "less_than": lambda: c < F.lit(value) if number else F.lit(False),
        "is_set": lambda: filled,
        "is_not_set": lambda: ~filled,
    }.get(op, lambda: F.lit(True))()
    return sure(p)


def matching_rules(df: DataFrame, rules: list[dict]) -> Column:
    """Names of the enabled rules that match a row, highest priority first."""
    ordered = sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (-r.get("priority", 0), r["name"]))
    flags = [F.when(all_of(condition(df, c["field"], c.get("operator", "equals"), c.get("value")) for c in r["conditions"]), F.lit(r["name"])) for r in ordered]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


class Collections:
    """A registry of stored predicates, evaluated on demand."""

    def __init__(self) -> None:
        self.stored: dict[str, dict] = {}

    def create(self, name: str, rules: list[Condition], match_all: bool = True) -> str:
        if name in self.stored:
            raise ValueError(f"collection {name} exists")
        self.stored[name] = {"rules": list(rules), "match_all": match_all}
        return name

    def create_series(self, series: str) -> str:
        return self.create(f"Series: {series}", [("series", "==", series)])

    def create_recent(self, days: int, now: Any, field: str = "added_at") -> str:
        from datetime import timedelta

        return self.create(f"Last {days} days", [(field, ">=", now - timedelta(days=days))])

    def create_unread(self) -> str:
        return self.create("Unread", [("read_status", "==", "unread")])

    def update(self, name: str, **changes: Any) -> None:
        self.stored[name] |= changes

    def delete(self, name: str) -> bool:
        return self.stored.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.stored)

    def query(self, name: str, df: DataFrame) -> DataFrame:
        c = self.stored[name]
        return df.filter(matches_rules(df, c["rules"], c["match_all"]))
