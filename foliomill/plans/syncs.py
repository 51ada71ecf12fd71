"""Three-way synchronisation of the orders: a base, and two copies changed by rules on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import sync
from foliomill.registry import query
from foliomill.sources import catalog as C

FIELDS = ["status", "price", "priority"]

_BASE = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders"
#: what each side did: (status, price, priority, which records it deleted, which it added, at which ids)
_LOCAL = ("CASE WHEN id % 3 = 0 THEN 'L' ELSE status END", "CASE WHEN id % 5 = 0 THEN price + 1 ELSE price END", "priority", "id % 11 = 0", "id % 17 = 0", "id + 100000000")
_REMOTE = ("CASE WHEN id % 4 = 0 THEN 'R' WHEN id % 9 = 0 THEN 'L' ELSE status END", "CASE WHEN id % 10 = 0 THEN price + 2 ELSE price END", "CASE WHEN id % 7 = 0 THEN NULL ELSE priority END", "id % 13 = 0", "id % 34 = 0", "id + 100000000")


def _side_sql(rules: tuple[str, ...]) -> str:
    status, price, priority, deleted, added, at = rules
    return f"SELECT id, {status} AS status, {price} AS price, {priority} AS priority FROM b WHERE NOT ({deleted}) UNION ALL SELECT {at}, 'N', price, priority FROM b WHERE {added}"


def _sides(s: SparkSession, d: str) -> list[DataFrame]:
    base = C.table(s, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price", "o_orderpriority AS priority")

    def side(rules: tuple[str, ...]) -> DataFrame:
        status, price, priority, deleted, added, at = rules
        kept = base.filter(f"NOT ({deleted})").selectExpr("id", f"{status} AS status", f"{price} AS price", f"{priority} AS priority")
        return kept.unionByName(base.filter(added).selectExpr(f"{at} AS id", "'N' AS status", "price", "priority"))

    return [base, side(_LOCAL), side(_REMOTE)]


_SQL = f"""WITH b AS ({_BASE}), l AS ({_side_sql(_LOCAL)}), r AS ({_side_sql(_REMOTE)}),
v AS (SELECT coalesce(b.id, l.id, r.id) AS id, b.id IS NOT NULL AS ib, l.id IS NOT NULL AS il, r.id IS NOT NULL AS ir, {', '.join(f'{s}.{f} AS {s}_{f}' for s in 'blr' for f in FIELDS)}
 FROM b FULL JOIN l ON b.id = l.id FULL JOIN r ON r.id = coalesce(b.id, l.id)),
w AS (SELECT *, ib AND il AND NOT ir AND ({' OR '.join(f'l_{f} IS DISTINCT FROM b_{f}' for f in FIELDS)}) OR ib AND ir AND NOT il AND ({' OR '.join(f'r_{f} IS DISTINCT FROM b_{f}' for f in FIELDS)}) AS gone,
 {', '.join(f'l_{f} IS DISTINCT FROM b_{f} AND r_{f} IS DISTINCT FROM b_{f} AND l_{f} IS DISTINCT FROM r_{f} AS c_{f}' for f in FIELDS)} FROM v)"""
_JOINED = {"status": "concat_ws(chr(10), l_status, r_status)", "price": "greatest(l_price, r_price)", "priority": "concat_ws(chr(10), l_priority, r_priority)"}


def _merged_sql(policy: str) -> str:
    lives = {"keep_local": "il", "keep_remote": "ir", "keep_both": "true", "merge": "true"}[policy]
    clash = lambda f: {"keep_local": f"l_{f}", "keep_remote": f"r_{f}", "keep_both": f"l_{f}", "merge": _JOINED[f]}[policy]
    value = lambda f: f"CASE WHEN il AND ir THEN CASE WHEN c_{f} THEN {clash(f)} WHEN l_{f} IS NOT DISTINCT FROM b_{f} THEN r_{f} ELSE l_{f} END WHEN il THEN l_{f} ELSE r_{f} END AS {f}"
    main = f"SELECT id, {', '.join(map(value, FIELDS))}, false AS copy FROM w WHERE il AND ir OR NOT ib OR gone AND {lives}"
    copies = f" UNION ALL SELECT id, {', '.join(f'r_{f}' for f in FIELDS)}, true FROM w WHERE il AND ir AND ({' OR '.join(f'c_{f}' for f in FIELDS)})"
    return f"{_SQL} {main}{copies if policy == 'keep_both' else ''}"


def _register(policy: str) -> None:
    query(_merged_sql(policy), f"sync_{policy}")(lambda s, d: sync.merged(*_sides(s, d), ["id"], FIELDS, policy))


for _policy in sync.POLICIES:
    _register(_policy)

_CLASHES = " UNION ALL ".join(f"SELECT id, '{f}' AS field, CAST(b_{f} AS VARCHAR) AS base, CAST(l_{f} AS VARCHAR) AS local, CAST(r_{f} AS VARCHAR) AS remote FROM w WHERE il AND ir AND c_{f}" for f in FIELDS if f != "price")


@query(f"{_SQL} {_CLASHES} UNION ALL SELECT id, 'price', NULL, NULL, NULL FROM w WHERE il AND ir AND c_price UNION ALL SELECT id, '*', 'there', CASE WHEN il THEN 'changed' ELSE 'deleted' END, CASE WHEN ir THEN 'changed' ELSE 'deleted' END FROM w WHERE gone")
def sync_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Every clash of a field or a record; prices without their texts, which engines write differently."""
    out = sync.conflicts(*_sides(s, d), ["id"], FIELDS)
    shown = lambda c: F.when(F.col("field") != "price", F.col(c)).alias(c)
    return out.select("id", "field", shown("base"), shown("local"), shown("remote"))


@query(f"{_SQL} SELECT id, CASE WHEN NOT ib THEN 'added' WHEN NOT il THEN 'deleted' ELSE 'modified' END AS change FROM w WHERE (il OR ib) AND (NOT ib OR NOT il OR {' OR '.join(f'l_{f} IS DISTINCT FROM b_{f}' for f in FIELDS)})")
def sync_changes_since(s: SparkSession, d: str) -> DataFrame:
    base, local, _ = _sides(s, d)
    return sync.changes(base, local, ["id"], FIELDS)
