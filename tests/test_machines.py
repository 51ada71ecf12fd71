"""Sessions by command and expiring values: stream, batch and plain Python agree; a killed stream goes on."""

import random

import pytest
from pyspark.sql import functions as F

from foliomill.streaming import machines as M
from foliomill.streaming import sessions as W

HOUR = 3_600_000_000
START = 1_700_000_000_000_000
SCHEMA = "user_id long, ts_us long, id long, command string, pages long, value double"


def made(seed, n, kinds):
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        u = rng.choice([1, 1, 1, 2, 3, 4])
        at[u] = at.get(u, START) + rng.choice([0, 1, 500, HOUR // 7, HOUR, 5 * HOUR])
        rows.append((u, at[u], i, rng.choice(kinds), rng.choice([None, 1, 2, 30]), rng.choice([None, 1.5, 2.5])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")


def mark_of(rows):
    return max(r[1] for r in rows) // 1000 - 600_000


def plain_sessions(rows, idle):
    out, mark = [], mark_of(rows)
    for u in {r[0] for r in rows}:
        number, now = 0, None
        for _, at, _, command, pages, _ in sorted((r for r in rows if r[0] == u and -(-r[1] // 1000) < mark), key=lambda r: (r[1], r[2])):
            if now and at - now["last"] > idle:
                out.append((u, number, "expired", now["opened"], now["last"] + idle, now["pages"], now["steps"]))
                now = None
            if (command == M.OPEN) == bool(now):
                out.append((u, None, "refused", at, at, 0, 0))
            elif command == M.OPEN:
                number, now = number + 1, {"opened": at, "last": at, "pages": 0, "steps": 0}
            elif command == M.PROGRESS:
                now["pages"], now["steps"] = now["pages"] + (pages or 0), now["steps"] + 1
            else:
                out.append((u, number, "completed" if command == M.COMPLETE else "cancelled", now["opened"], at, now["pages"], now["steps"]))
                now = None
            if now:
                now["last"] = at
        if now and -(-(now["last"] + idle) // 1000) < mark:
            out.append((u, number, "expired", now["opened"], now["last"] + idle, now["pages"], now["steps"]))
    return sorted(out, key=str)


def plain_values(rows, live):
    out, mark = [], mark_of(rows)
    for u in {r[0] for r in rows}:
        value, until = None, -1
        for _, at, i, command, _, v in sorted((r for r in rows if r[0] == u and -(-r[1] // 1000) < mark), key=lambda r: (r[1], r[2])):
            if command == M.GET:
                out.append((u, i, at, value if at < until else None))
            else:
                value, until = (v, at + live) if command == M.PUT else (None, -1)
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


COMMANDS = [M.OPEN, M.OPEN, M.PROGRESS, M.PROGRESS, M.COMPLETE, M.CANCEL]
VALUES = [M.PUT, M.PUT, M.GET, M.GET, M.GET, M.REMOVE]


@pytest.mark.parametrize("seed", range(4))
def test_batch_twins(spark, seed):
    rows = made(seed, 250, COMMANDS)
    assert listed(M.sessions_by_command(frame(spark, rows), 3 * HOUR)) == plain_sessions(rows, 3 * HOUR)
    rows = made(seed, 250, VALUES)
    assert listed(M.values_at(frame(spark, rows), 2 * HOUR)) == plain_values(rows, 2 * HOUR)


def stream_of(spark, rows, folder, parts):
    """Files in order of time, each shuffled inside and with rows of the next that come early."""
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    cuts = [rows[i : i + size] for i in range(0, len(rows), size)]
    for i, part in enumerate(cuts):
        random.Random(i).shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return W.read_events(spark, folder)


@pytest.mark.parametrize("parts", [1, 4])
def test_streams_equal_their_twins(spark, tmp_path, parts):
    rows = made(7, 200, COMMANDS)
    stream = stream_of(spark, rows, str(tmp_path / "in"), parts)
    with M.stateful(spark):
        got = W.run_once(M.run_ordered(stream, "user_id", M.Sessions(3 * HOUR)), str(tmp_path / "s"))
    assert listed(got) == plain_sessions(rows, 3 * HOUR)
    rows = made(8, 200, VALUES)
    stream = stream_of(spark, rows, str(tmp_path / "v_in"), parts)
    with M.stateful(spark):
        got = W.run_once(M.run_ordered(stream, "user_id", M.ExpiringValues(2 * HOUR)), str(tmp_path / "v"))
    assert listed(got) == plain_values(rows, 2 * HOUR)


def test_a_killed_stream_goes_on(spark, tmp_path):
    """The second batch fails after it was written in part; the restarted query gives each row once."""
    rows = made(9, 160, COMMANDS)
    stream = stream_of(spark, rows, str(tmp_path / "in"), 4)
    out, failed = str(tmp_path / "out"), []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost")

    def run():
        query = M.run_ordered(stream, "user_id", M.Sessions(3 * HOUR)).writeStream.outputMode("append").foreachBatch(write)
        query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    with M.stateful(spark):
        with pytest.raises(Exception, match="lost"):
            run()
        run()
    got = spark.read.parquet(out).drop("batch")
    assert failed == [1] and listed(got) == plain_sessions(rows, 3 * HOUR)


def test_store_setting_is_put_back(spark):
    was = spark.conf.get(M.STORE)
    with pytest.raises(ZeroDivisionError), M.stateful(spark):
        assert spark.conf.get(M.STORE) == M.ROCKS
        1 / 0
    assert spark.conf.get(M.STORE) == was


def test_no_events(spark):
    none = frame(spark, made(1, 1, [M.GET])).limit(0)
    assert M.sessions_by_command(none, HOUR).collect() == [] and M.values_at(none, HOUR).collect() == []


# --- latest rows, kept up by a stream ---------------------------------------------------------


def test_latest_rows_touch_only_their_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, ts long, v string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    table = lambda: {r.k: (r.ts, r.v) for r in W.latest_table(spark, path, schema).collect()}
    assert table() == {}
    everything = W.merge_latest(make([(i, 1, "a") for i in range(200)]), 0, path, ["k"], "ts", buckets=16)
    assert everything == list(range(16))
    before = W.Versions(spark, path).read()["buckets"]
    touched = W.merge_latest(make([(3, 2, "b"), (3, 1, "old"), (500, 1, "new")]), 1, path, ["k"], "ts", buckets=16)
    after = W.Versions(spark, path).read()["buckets"]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == set(map(str, touched))
    want = {i: (1, "a") for i in range(200)} | {3: (2, "b"), 500: (1, "new")}
    assert table() == want
    # the same batch again, as after a lost commit
    assert W.merge_latest(make([(3, 9, "x")]), 1, path, ["k"], "ts", buckets=16) == [] and table() == want
    assert W.merge_latest(make([]), 2, path, ["k"], "ts", buckets=16) == [] and table() == want
    W.Versions(spark, path).sweep()
    assert table() == want


def test_latest_rows_from_a_stream(spark, tmp_path):
    rows = [(i % 7, i, f"v{i}") for i in range(60)]
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, "k long, ts long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = W.read_events(spark, str(tmp_path / "in"))
    for _ in range(2):
        W.write_latest(stream, str(tmp_path / "t"), ["k"], "ts", str(tmp_path / "c"), 4).start().awaitTermination()
    got = {r.k: r.v for r in W.latest_table(spark, str(tmp_path / "t"), "k long, ts long, v string").collect()}
    assert got == {i % 7: f"v{i}" for i in range(53, 60)}
