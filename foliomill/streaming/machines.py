"""Sessions that are opened and closed by command, and values that expire, as keyed state.

Rows of a key wait until the watermark has passed them and then take effect in order
of event time and id, whatever order and batch they came in; so a stream gives what
its batch twin gives over the rows that the watermark has passed.  One timer for each
key stands at the next moment when something happens: a waiting row, or the end of a
session that nobody closes.  Rows later than the watermark are dropped by Spark; they
are counted in the query's progress.

State needs the RocksDB store (``stateful``).  Times are microseconds inside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, was)


def moment(at: int) -> int:
    """The first millisecond that is not before ``at``."""
    return -(-at // 1000)


class Ordered(StatefulProcessor):
    """Rows of a key in order of event time: ``step`` for each, ``quiet`` when the watermark moves on.

    The first two columns of ``ROWS`` are ``at`` and ``id``.
    """

    ROWS: str
    STATE: str
    OUT: str

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def quiet(self, state: tuple, watermark: int) -> tuple[tuple, list[tuple]]:
        """What happens without a row, now that the watermark (ms) is there."""
        return state, []

    def deadline(self, state: tuple) -> int | None:
        """When (µs) something happens without a row."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROWS)
        self.value = handle.getValueState("state", self.STATE)
        self.names = [c.split()[0] for c in self.ROWS.split(", ")]
        self.out = [c.split()[0] for c in self.OUT.split(", ")]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a column of whole numbers with nulls comes as fractions
        read = [int if c.endswith(" long") else lambda v: v for c in self.ROWS.split(", ")]
        fresh = [tuple(None if pd.isna(v) else of(v) for of, v in zip(read, r)) for f in rows for r in f[self.names].itertuples(index=False, name=None)]
        self.waiting.appendList(fresh)
        yield from self._pass(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._pass(key, timerValues)

    def close(self) -> None:
        pass

    def _pass(self, key: Any, timer: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timer.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        n = sum(moment(r[0]) < watermark for r in held)
        state = self.value.get() if self.value.exists() else self.begin()
        made: list[tuple] = []
        for r in held[:n]:
            state, some = self.step(tuple(state), r)
            made += some
        state, some = self.quiet(tuple(state), watermark)
        made += some
        if n:
            self.waiting.clear()
            if held[n:]:
                self.waiting.put(held[n:])
        self.value.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        next_at = [moment(held[n][0])] if held[n:] else []
        if (end := self.deadline(state)) is not None:
            next_at.append(moment(end))
        if next_at:
            self.handle.registerTimer(max(min(next_at), watermark))
        if made:
            yield pd.DataFrame([(key[0], *m) for m in made], columns=self.out)


def run_ordered(events: DataFrame, key: str, machine: Ordered, late: str = "10 minutes") -> DataFrame:
    """The machine over a stream with ``ts``, the key, and the machine's columns but ``at``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(machine, machine.OUT, "append", "eventTime")


def settled(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The rows of a batch that the watermark at its end has passed, with ``at``, and ``mark`` (ms)."""
    timed = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    mark = timed.agg((F.floor(F.max("at") / 1000) - F.expr(f"(unix_micros(timestamp'1970-01-01' + interval {late}) - unix_micros(timestamp'1970-01-01')) div 1000")).alias("mark"))
    return timed.crossJoin(F.broadcast(mark)).filter(F.ceil(F.col("at") / 1000) < F.col("mark"))  # one row


# --- sessions -----------------------------------------------------------------------------

#: commands of a session
OPEN, PROGRESS, COMPLETE, CANCEL = "open", "progress", "complete", "cancel"
SESSIONS = "user_id long, session long, state string, opened long, ended long, pages long, steps long"


class Sessions(Ordered):
    """Sessions by command, one at a time for each key.

    Open is refused while a session is open, the other commands while none is.  A
    session ends when it is completed or cancelled, or ``idle`` microseconds after
    the key's last command.  A row for each ended session and each refused command.
    """

    ROWS = "at long, id long, command string, pages long"
    STATE = "number long, opened long, last long, pages long, steps long"
    OUT = SESSIONS

    def __init__(self, idle: int):
        self.idle = idle

    def begin(self) -> tuple:
        return (0, -1, -1, 0, 0)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (at, _, command, more), out = row, []
        if state[1] >= 0 and at - state[2] > self.idle:
            state, out = self._end(state, "expired", state[2] + self.idle)
        number, opened, last, pages, steps = state
        if (command == OPEN) == (opened >= 0):
            refused = (None, "refused", at, at, 0, 0)
            return (number, opened, at if opened >= 0 else last, pages, steps), [*out, refused]
        if command == OPEN:
            return (number + 1, at, at, 0, 0), out
        if command == PROGRESS:
            return (number, opened, at, pages + (more or 0), steps + 1), out
        state, end = self._end(state, "completed" if command == COMPLETE else "cancelled", at)
        return state, out + end

    def _end(self, state: tuple, how: str, at: int) -> tuple[tuple, list[tuple]]:
        number, opened, _, pages, steps = state
        return (number, -1, -1, 0, 0), [(number, how, opened, at, pages, steps)]

    def deadline(self, state: tuple) -> int | None:
        return state[2] + self.idle if state[1] >= 0 else None

    def quiet(self, state: tuple, watermark: int) -> tuple[tuple, list[tuple]]:
        if state[1] >= 0 and moment(state[2] + self.idle) < watermark:
            return self._end(state, "expired", state[2] + self.idle)
        return state, []


def sessions_by_command(events: DataFrame, idle: int, late: str = "10 minutes") -> DataFrame:
    """The batch twin of ``Sessions``: nothing is open after a command that ends a session or after an idle time, so windows between them hold a session each."""
    rows = settled(events, late)
    by = Window.partitionBy("user_id").orderBy("at", "id")
    before = F.lag("command").over(by)
    cut = before.isin(COMPLETE, CANCEL) | (F.col("at") - F.lag("at").over(by) > idle)
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("part", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(by))
    part = Window.partitionBy("user_id", "part")
    rows = rows.withColumn("first", F.min(F.when(F.col("command") == OPEN, F.col("n"))).over(part))
    held = rows.filter(F.col("n") >= F.col("first"))
    progress = F.col("command") == PROGRESS
    ended = held.groupBy("user_id", "part").agg(
        F.min("at").alias("opened"), F.max("at").alias("last"), F.max("mark").alias("mark"), F.max_by("command", "n").alias("how"),
        F.coalesce(F.sum(F.when(progress, F.coalesce("pages", F.lit(0)))), F.lit(0)).alias("pages"), F.count_if(progress).alias("steps"),
    ).withColumn("session", F.row_number().over(Window.partitionBy("user_id").orderBy("opened", "part")).cast("long"))
    state = F.when(F.col("how") == COMPLETE, "completed").when(F.col("how") == CANCEL, "cancelled").when(F.ceil((F.col("last") + idle) / 1000) < F.col("mark"), "expired")
    ended = ended.withColumn("state", state).filter("state is not null").withColumn("ended", F.when(F.col("state") == "expired", F.col("last") + idle).otherwise(F.col("last")))
    refused = rows.filter(F.col("first").isNull() | (F.col("n") < F.col("first")) | ((F.col("command") == OPEN) & (F.col("n") > F.col("first"))))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    refused = refused.select("user_id", none.alias("session"), F.lit("refused").alias("state"), F.col("at").alias("opened"), F.col("at").alias("ended"), zero.alias("pages"), zero.alias("steps"))
    return ended.select(refused.columns).unionByName(refused)


# --- values that expire -------------------------------------------------------------------

PUT, GET, REMOVE = "put", "get", "remove"
GOT = "user_id long, id long, at long, value double"


class ExpiringValues(Ordered):
    """One value for each key, gone ``live`` microseconds after it was put; a row for each get, null where there is none."""

    ROWS = "at long, id long, command string, value double"
    STATE = "value double, until long"
    OUT = GOT

    def __init__(self, live: int):
        self.live = live

    def begin(self) -> tuple:
        return (0.0, -1)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        at, number, command, value = row
        if command == PUT:
            return ((value, at + self.live) if value is not None else (0.0, -1)), []
        if command == REMOVE:
            return (0.0, -1), []
        return state, [(number, at, state[0] if at < state[1] else None)]

    def deadline(self, state: tuple) -> int | None:
        return state[1] if state[1] >= 0 else None

    def quiet(self, state: tuple, watermark: int) -> tuple[tuple, list[tuple]]:
        return ((0.0, -1) if 0 <= state[1] and moment(state[1]) < watermark else state), []


def values_at(events: DataFrame, live: int, late: str = "10 minutes") -> DataFrame:
    """The batch twin of ``ExpiringValues``: a value is valid from its put to the next put or remove, or as long as it lives."""
    rows = settled(events, late)
    by = Window.partitionBy("user_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change: Column = F.when(F.col("command") != GET, F.struct("at", F.when(F.col("command") == PUT, F.col("value")).alias("value")))
    held = rows.withColumn("held", F.last(change, ignorenulls=True).over(by)).filter(F.col("command") == GET)
    return held.select("user_id", "id", "at", F.when(F.col("at") < F.col("held.at") + live, F.col("held.value")).alias("value"))


def commands(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """``events`` with a command for some types of event; the others are left out."""
    pairs: Iterable[tuple[str, str]] = names.items()
    command = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in pairs])
    return events.select("user_id", "ts", F.col("event_id").alias("id"), command.alias("command"), F.get_json_object("props", "$.k").cast("long").alias("pages"), "value").filter("command is not null")
