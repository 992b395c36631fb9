"""Streams over small files, read to their end."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from strandweave.streaming import events as S
from strandweave.streaming import marks as M

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    def put(*batches):
        for k, rows in enumerate(batches):
            spark.createDataFrame([(u, T0 + dt.timedelta(minutes=x), i) for u, x, i in rows], "user int, at timestamp, id int").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
            time.sleep(0.01)
        return spark.readStream.schema("user int, at timestamp, id int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")

    return put


def drained(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_windows(source, tmp_path):
    rows = drained(S.windowed(source([(1, 1, 0), (1, 5, 1), (2, 70, 2), (1, 600, 3)]), "at", "1 hour", keys=("user",)), tmp_path, "w", "complete")
    assert {(r.start.hour, r.user, r.n) for r in rows} == {(0, 1, 2), (1, 2, 1), (10, 1, 1)}


def test_late_rows_are_dropped(source, tmp_path):
    rows = drained(S.windowed(source([(1, 1, 0)], [(1, 600, 1)], [(1, 610, 2)], [(1, 2, 3)], [(1, 1200, 4)]), "at", "1 hour", late="1 hour"), tmp_path, "l")
    assert {(r.start.hour, r.n) for r in rows} == {(0, 1), (10, 2)}  # the row at minute 2 came nine hours behind


def test_idle_sessions_end_after_the_gap(source, tmp_path):
    rows = drained(S.idle(source([(1, 0, 0), (1, 700, 1), (2, 5, 2)], [(1, 1500, 3)], [(2, 4000, 4)], [(2, 9000, 5)]), "at", "user"), tmp_path, "i")
    assert {(r.user, (r.start - T0).total_seconds() // 60, r.n) for r in rows} == {(1, 0, 2), (1, 1500, 1), (2, 5, 1), (2, 4000, 1)}


def test_replay_files_once(source, tmp_path):
    rows = drained(S.once(source([(1, 1, 7), (1, 2, 8)], [(1, 1, 7), (1, 3, 9)]), "at", ["id"]), tmp_path, "o")
    assert sorted(r.id for r in rows) == [7, 8, 9]


def test_rate_limit_counts_accepted_only(source, tmp_path):
    rows = drained(S.limited(source([(1, m, m) for m in (0, 1, 2, 3, 59, 61)]), "user", "at", 2, 3600.0), tmp_path, "r")
    assert [(r["at"] - T0).seconds // 60 for r in sorted(rows, key=lambda r: r["at"]) if r.allowed] == [0, 1, 61]


def test_rate_limit_forgets_keys(source, tmp_path):
    stream = S.limited(source([(1, 0, 0)], [(2, 600, 1)], [(3, 1200, 2)], [(4, 1800, 3)]), "user", "at", 2, 60.0, "1 minute")
    q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/rf").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert kept <= 2


def test_bounded_delta_hands_on_all_rows(spark, source, tmp_path):
    """Key 1 sends three rows, then only key 2 sends: key 1's third row goes out all the same."""
    S.stateful(spark)
    try:
        stream = S.deltas(source([(1, 3, 30), (1, 1, 10), (1, 2, 20)], [(2, 4, 40)], [(2, 5, 50)]), "user", "at", 2, "id")
        q = stream.writeStream.format("memory").queryName("d").option("checkpointLocation", f"{tmp_path}/d").outputMode("append").trigger(processingTime="200 milliseconds").start()
        end = time.time() + 120
        while time.time() < end and spark.table("d").count() < 5 and q.isActive:
            time.sleep(0.5)
        time.sleep(3)
        assert q.exception() is None, str(q.exception())[:6000]
        rows = spark.table("d").collect()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.user, r.id, (r["at"] - T0).seconds // 60) for r in rows) == [(1, 10, 1), (1, 20, 2), (1, 30, 3), (2, 40, 4), (2, 50, 5)]
    assert {r.id for r in rows if r.truncated} == {10, 20} and state == 0


LINE = "run_id bigint, at timestamp, line string, seq bigint"


def lines_of(spark, tmp_path, *batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(r, T0 + dt.timedelta(seconds=x), line) for r, x, line in rows], "run_id bigint, at timestamp, line string")
        df.coalesce(1).write.mode("append").json(f"{tmp_path}/log/{k}")
        time.sleep(0.01)
    return spark.readStream.schema("run_id bigint, at timestamp, line string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/log/*")


def test_log_tail_after_a_kill(spark, tmp_path):
    """A batch whose marks were not written is written again on restart, with the same numbers, and shown only then."""
    root, batches = f"{tmp_path}/out", [[(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], [(1, 3, "c"), (2, 2, "y")], [(1, 4, "d")]]
    stream, calls = lines_of(spark, tmp_path, *batches), []
    flush = M.log_sink(root, ["at", "line"])

    def dies(batch, number):
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            batch.withColumn("seq", F.lit(99).cast("long")).write.mode("overwrite").parquet(f"{root}/lines/batch=1")
            raise RuntimeError("killed between lines and marks")
        flush(batch, number)

    start = lambda: stream.writeStream.foreachBatch(dies).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination(120)
    seen = sorted((r.run_id, r.seq, r.line) for r in M.lines(spark, root, LINE).collect())
    assert seen == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]
    start().awaitTermination(120)
    whole = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 1, "x"), (2, 2, "y")]
    assert sorted((r.run_id, r.seq, r.line) for r in M.lines(spark, root, LINE).collect()) == whole and calls.count(1) == 2
    again = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=3), "c"), (2, T0 + dt.timedelta(seconds=2), "y")], "run_id bigint, at timestamp, line string")
    flush(again, 1)  # replayed once more, after later batches
    found = M.lines(spark, root, LINE)
    assert sorted((r.run_id, r.seq, r.line) for r in found.collect()) == whole
    assert [r.line for r in M.tail(found, 1, after=1, most=2).collect()] == ["b", "c"]


def test_marks_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "COMPACT", 2)
    flush = M.log_sink(f"{tmp_path}/out", ["at"])
    for k in range(5):
        flush(spark.createDataFrame([(k % 3, T0, "x"), (7, T0, "y")], "run_id bigint, at timestamp, line string"), k)
    assert {r.run_id: r["last"] for r in M.last_numbers(spark, f"{tmp_path}/out", 9).collect()} == {0: 2, 1: 2, 2: 1, 7: 5}
    assert M.last_numbers(spark, f"{tmp_path}/none", 3).count() == 0


def test_high_water(spark):
    runs = spark.createDataFrame([("a", "succeeded", T0), ("a", "failed", T0 + dt.timedelta(1)), ("b", "failed", T0)], "agent string, status string, started_at timestamp")
    agents = spark.createDataFrame([("a",), ("b",), ("c",)], "agent string")
    found = {r.agent: r.since for r in M.high_water(runs, agents, F.lit(T0 + dt.timedelta(9)), 7).collect()}
    assert found == {"a": T0, "b": T0 + dt.timedelta(2), "c": T0 + dt.timedelta(2)}
