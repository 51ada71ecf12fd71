"""Keyed state over the event stream: sessions by command, values that expire."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliomill.registry import query
from foliomill.session import shared_folder
from foliomill.sources import catalog as C
from foliomill.streaming import machines as M
from foliomill.streaming import sessions as W

_SESSION_COMMANDS = {"signup": M.OPEN, "view": M.PROGRESS, "click": M.PROGRESS, "purchase": M.COMPLETE, "error": M.CANCEL}
_VALUE_COMMANDS = {"purchase": M.PUT, "error": M.REMOVE, "view": M.GET}
_DAY = 86_400_000_000


def _settled_sql(names: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"""c AS (SELECT user_id, event_id AS id, epoch_us(ts) AS at_us, CASE event_type {cases} END AS command, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pages, value FROM events),
m AS (SELECT max(at_us) // 1000 - 600000 AS mark FROM c WHERE command IS NOT NULL), e AS (SELECT c.*, mark FROM c, m WHERE command IS NOT NULL AND (at_us + 999) // 1000 < mark)"""


_SESSIONS_SQL = f"""WITH {_settled_sql(_SESSION_COMMANDS)},
g AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(command) OVER w IN ('complete', 'cancel') OR at_us - lag(at_us) OVER w > {_DAY} THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_us, id)),
p AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS part FROM g),
f AS (SELECT *, min(CASE WHEN command = 'open' THEN n END) OVER (PARTITION BY user_id, part) AS f FROM p),
s AS (SELECT user_id, part, min(at_us) AS opened, max(at_us) AS last, any_value(mark) AS mark, arg_max(command, n) AS how, coalesce(sum(pages) FILTER (command = 'progress'), 0) AS pages, count(*) FILTER (command = 'progress') AS steps FROM f WHERE n >= f GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY opened) AS session, CASE how WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE CASE WHEN (last + {_DAY} + 999) // 1000 < mark THEN 'expired' END END AS state FROM s)
SELECT user_id, session, state, opened, CASE state WHEN 'expired' THEN last + {_DAY} ELSE last END AS ended, CAST(pages AS BIGINT) AS pages, steps FROM t WHERE state IS NOT NULL
UNION ALL SELECT user_id, NULL, 'refused', at_us, at_us, 0, 0 FROM f WHERE f IS NULL OR n < f OR (command = 'open' AND n > f)"""


@query(_SESSIONS_SQL)
def explicit_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions that events open, move on, complete and cancel; a day without a command ends them."""
    return M.sessions_by_command(M.commands(C.table(s, d, "events"), _SESSION_COMMANDS), _DAY)


def _streamed(s: SparkSession, d: str, names: dict[str, str], machine: M.Ordered) -> DataFrame:
    e = M.commands(W.read_events(s, f"{d}/events.parque[t]"), names)
    with M.stateful(s):
        return W.run_once(M.run_ordered(e, "user_id", machine), f"{shared_folder(s)}/machine-{uuid.uuid4().hex}")


@query(_SESSIONS_SQL)
def explicit_sessions_streamed(s: SparkSession, d: str) -> DataFrame:
    """The same from a stream, with the sessions as state and timers for those that nobody closes."""
    return _streamed(s, d, _SESSION_COMMANDS, M.Sessions(_DAY))


_VALUES_SQL = f"""WITH {_settled_sql(_VALUE_COMMANDS)},
h AS (SELECT *, last_value(CASE WHEN command <> 'get' THEN {{'at_us': at_us, 'value': CASE WHEN command = 'put' THEN value END}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY at_us, id ROWS UNBOUNDED PRECEDING) AS held FROM e)
SELECT user_id, id, at_us AS "at", CASE WHEN at_us < held.at_us + {_DAY} THEN held.value END AS value FROM h WHERE command = 'get'"""


@query(_VALUES_SQL)
def expiring_values(s: SparkSession, d: str) -> DataFrame:
    """What a user's last purchase is at each view: gone after a day, or with an error."""
    return M.values_at(M.commands(C.table(s, d, "events"), _VALUE_COMMANDS), _DAY)


@query(_VALUES_SQL)
def expiring_values_streamed(s: SparkSession, d: str) -> DataFrame:
    return _streamed(s, d, _VALUE_COMMANDS, M.ExpiringValues(_DAY))
