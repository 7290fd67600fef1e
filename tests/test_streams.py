"""Streams over several batches and restarts: warnings of stops, an outbox that fails, filings that come again."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators.stored import filings_table
from tidebook.plans import streams
from tidebook.storage import scratch
from tidebook.streaming import monitor, outbox
from tidebook.streaming.ingest import drain, filings_stream
from tidebook.tables import Table

BARS = "instrument_id long, bar_start timestamp, close double"


def rows(d):
    return sorted(map(tuple, d.collect()), key=str)


def at(day, minute):
    return datetime(2024, 3, day, 9) + timedelta(minutes=minute)


@pytest.fixture
def positions(spark):
    r = [(1, 10, 100.0, "OPEN"), (2, 10, 50.0, "OPEN"), (3, 11, None, "OPEN"), (4, 10, 100.0, "CLOSED"), (5, 12, 200.0, "OPEN")]
    return spark.createDataFrame(r, "position_id long, instrument_id long, stop_price double, status string")


def feed(spark, folder, bars):
    spark.createDataFrame(bars, BARS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_one_warning_a_position_day_and_state_over_restarts(spark, positions):
    folder, kept = scratch(spark, "bars"), (scratch(spark, "out"), scratch(spark, "state"))

    def go(*bars):
        with monitor.keyed_state(spark):
            return rows(drain(monitor.stop_warnings(feed(spark, folder, list(bars)), positions), "w", folders=kept).select("position_id", F.date_format("session_date", "dd"), "state", "price"))

    assert go((10, at(4, 0), 120.0), (11, at(4, 0), 1.0), (12, at(4, 0), 203.0)) == [(5, "04", "NEAR_STOP", 203.0)]
    # another run goes on: the same state again says nothing, a breach does; the bar of before nine comes too late
    assert go((12, at(4, 5), 202.0), (10, at(4, 5), 101.0), (10, at(4, -5), 1.0)) == [(1, "04", "NEAR_STOP", 101.0), (5, "04", "NEAR_STOP", 203.0)]
    third = go((10, at(4, 10), 99.0), (10, at(4, 15), 101.0), (12, at(4, 10), None))
    assert third == [(1, "04", "NEAR_STOP", 101.0), (1, "04", "STOP_BREACH", 99.0), (5, "04", "NEAR_STOP", 203.0)]
    # the next session warns anew
    assert (1, "05", "NEAR_STOP", 100.5) in go((10, at(5, 0), 100.5)) and len(go((10, at(5, 5), 100.6))) == 4


def test_stream_equals_the_table_when_bars_come_in_order(spark, positions):
    r = random.Random(4)
    bars = [(i, at(d, 5 * k), r.choice([None, r.uniform(45, 210)])) for d in (4, 5, 6) for k in range(30) for i in (10, 11, 12)]
    folder = scratch(spark, "bars")
    for k in range(0, len(bars), 70):
        stream = feed(spark, folder, bars[k : k + 70])
    with monitor.keyed_state(spark):
        got = rows(drain(monitor.stop_warnings(stream, positions), "w"))
    assert got == rows(monitor.warnings_of(spark.createDataFrame(bars, BARS), positions)) and len(got) > 5


def test_no_bars_and_no_positions_warn_of_nothing(spark, positions):
    none = spark.createDataFrame([], BARS)
    assert rows(monitor.warnings_of(none, positions)) == [] == rows(monitor.warnings_of(spark.createDataFrame([(10, at(4, 0), 1.0)], BARS), positions.limit(0)))


ORDERS = "id long, status string, signal_sent boolean, fill_sent boolean"


def queue(spark):
    r = [(1, "PENDING", False, False), (2, "FILLED", False, False), (3, "LAPSED", True, False), (4, "PARTIAL", True, True), (5, "PENDING", True, False), (3, "LAPSED", True, False)]
    return spark.createDataFrame(r, ORDERS)


def test_a_line_that_fails_keeps_its_cards(spark, tmp_path):
    ledger = outbox.ledger_table(spark, scratch(spark, "ledger"), buckets=4)
    log = str(tmp_path)

    def send(key, text):
        if key.startswith("3") and not os.path.exists(f"{log}/up"):
            raise ConnectionError("down")
        if key.startswith("2") and not os.path.exists(f"{log}/up"):
            return False
        with open(f"{log}/{key}-{random.random()}", "w") as f:
            f.write(text)
        return True

    first = outbox.deliver(outbox.due(queue(spark)), ledger, send)
    assert rows(first.select("order_id", "kind", "status", "attempts")) == [(1, "signal", "sent", 1), (2, "outcome", "failed", 1), (2, "signal", "passed over", 1), (3, "outcome", "failed", 1)]
    assert {r["order_id"]: r["reason"] for r in first.filter("status = 'failed'").collect()} == {2: "not delivered", 3: "ConnectionError: down"}
    open(f"{log}/up", "w").close()
    outbox.deliver(outbox.due(queue(spark)), ledger, send)
    outbox.deliver(outbox.due(queue(spark)), ledger, send)
    assert rows(ledger.read().select("order_id", "kind", "status", "attempts")) == [(1, "signal", "sent", 1), (2, "outcome", "sent", 2), (2, "signal", "passed over", 1), (3, "outcome", "sent", 2)]
    assert sorted(f.rpartition("-")[0] for f in os.listdir(log) if f != "up") == ["1-signal", "2-outcome", "3-outcome"]
    left = outbox.due(outbox.marked(queue(spark), ledger))
    assert left.count() == 0


def test_a_batch_that_fails_half_way_and_runs_again(spark, tmp_path, monkeypatch):
    """The receiver drops ids that it has seen: what was sent before the batch fell is not seen twice."""
    ledger, state, folder = outbox.ledger_table(spark, scratch(spark, "ledger")), scratch(spark, "state"), scratch(spark, "queue")
    log = str(tmp_path)

    def send(key, text):
        with open(f"{log}/{key}", "a") as f:
            f.write("x")
        return True

    queue(spark).write.parquet(folder)

    def run():
        source = spark.readStream.schema(ORDERS).parquet(folder)
        source.writeStream.foreachBatch(outbox.outbox(ledger, send)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    with monkeypatch.context() as mp:
        mp.setattr(Table, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    assert ledger.read() is None
    run()
    seen = set(os.listdir(log))
    assert seen == {"1-signal", "2-outcome", "3-outcome"}
    assert rows(ledger.read().select("order_id", "kind", "status")) == [(1, "signal", "sent"), (2, "outcome", "sent"), (2, "signal", "passed over"), (3, "outcome", "sent")]
    before = {k: os.path.getsize(f"{log}/{k}") for k in seen}
    queue(spark).write.mode("append").parquet(folder)  # the same orders come again: nothing leaves
    run()
    assert {k: os.path.getsize(f"{log}/{k}") for k in seen} == before


def test_filings_that_come_again_change_nothing(spark):
    schema = "dedup_key string, published_at timestamp, title string"
    t, folder, state = filings_table(spark, scratch(spark, "filings"), buckets=8), scratch(spark, "feed"), scratch(spark, "state")

    def go(*r):
        spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(folder)
        filings_stream(spark.readStream.schema(schema).parquet(folder), t, state=state)
        return {r["dedup_key"]: r["title"] for r in t.read().collect()}

    assert go(("a", at(4, 5), "second"), ("a", at(4, 0), "first"), ("b", at(4, 0), "b")) == {"a": "first", "b": "b"}
    assert go(("a", at(3, 0), "earlier, but late"), ("c", at(4, 0), "c")) == {"a": "first", "b": "b", "c": "c"}
    assert go() == {"a": "first", "b": "b", "c": "c"}


def test_parts_of_a_feed_come_in_turn_from_as_many_tasks_as_wrote_them(spark):
    d = spark.range(400, numPartitions=4).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"))
    seen, folders, files = [], (scratch(spark, "out"), scratch(spark, "state")), []
    for feed in streams.arrivals(d, "day", "parts", 2):
        got = drain(feed, "parts", folders=folders).withColumn("file", F.input_file_name())
        seen.append(got.agg(F.count("id"), F.max("day").cast("string")).first())
        files.append(got.select("file").distinct().count())
    assert list(map(tuple, seen)) == [(200, "2024-01-20"), (400, "2024-02-09")] and files[0] > 1 < files[1] - files[0]


def test_a_batch_of_a_bucket_takes_few_messages_whatever_its_positions():
    """State and timers are messages to the JVM, which cost more than bars: their number follows sessions, not positions."""
    calls = []

    class Handle:
        rows: list = []

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or self

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = rows

    def bars(day, close, n=500):
        at = day * 86_400_000_000 + 1
        return pd.DataFrame([(p, at + k, day, (day + 1) * 86_400_000, "NEAR_STOP" if k else None, close, at + k) for p in range(n) for k in range(3)], columns=["position_id", "at", "day", "ends", "state", "close", "bar_start"])

    handle, watch = Handle(), monitor.Watch()
    watch.init(handle)
    calls.clear()
    first = pd.concat(watch.handleInputRows((0,), iter([bars(1, 5.0), bars(2, 6.0)]), None))
    again = pd.concat(watch.handleInputRows((0,), iter([bars(2, 7.0), bars(3, 8.0)]), None))
    assert sorted(set(zip(first["day"], first["price"], strict=True))) == [(1, 5.0), (2, 6.0)] and len(first) == 1000
    assert set(zip(again["day"], again["price"], strict=True)) == {(3, 8.0)} and len(again) == 500
    assert len(calls) <= 8
