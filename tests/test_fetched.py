"""Fetching by an injected function: failures, refusals, days without a session, and a stream that goes on."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidebook.sources import fetched
from tidebook.storage import scratch

def rows(d):
    return sorted(map(tuple, d.collect()), key=str)


def archive(log):
    head = ["Data", "Nazwa", "ISIN", "Waluta", "Kurs otwarcia", "Kurs max", "Kurs min", "Kurs zamknięcia", "Zmiana", "Wolumen"]

    def line(day, name, close="10,5", volume="1 000"):
        return [day, name, f"PL{name}", "PLN", "10", "11", "9", close, "0", volume]

    def fetch(day, address):
        with open(f"{log}/{day}", "a") as f:
            f.write("x")
        tries = os.path.getsize(f"{log}/{day}")
        if day.endswith("03"):
            return None
        if day.endswith("04") and tries < 3:
            raise ConnectionError("reset")
        if day.endswith("05"):
            raise TimeoutError("slow")
        if day.endswith("08"):
            raise fetched.Refused("daily limit")
        if day.endswith("09"):
            return [["not", "a", "header"]]
        if day.endswith("10"):
            if address == "one":
                raise fetched.Refused("bot check")
            return [["title"], head, line(day, "B")]
        return [head, line(day, "A"), line(day, "S", close=""), line(day, "Z", close="0"), line(day, "N", volume=""), ["short"]]

    return fetch


DAYS = [f"2024-01-{d:02d}" for d in (2, 3, 4, 5, 8, 9, 10)]


def test_every_entry_has_an_outcome_and_none_stops_another(spark, tmp_path):
    slept = []
    d = fetched.sessions(spark, "archive-a", archive(str(tmp_path)), DAYS, addresses=("one", "two"), sleep=lambda s: None).cache()
    assert rows(fetched.outcomes(d)) == [
        ("2024-01-02", "fetched", None, 1),
        ("2024-01-03", "nothing", None, 1),
        ("2024-01-04", "fetched", None, 3),
        ("2024-01-05", "failed", "TimeoutError: slow", 6),
        ("2024-01-08", "refused", "daily limit", 2),
        ("2024-01-09", "failed", "ValueError: no header", 1),
        ("2024-01-10", "fetched", None, 2),
    ]
    assert [e for e, _ in rows(fetched.failures(d))] == ["2024-01-05", "2024-01-08", "2024-01-09"]
    got = rows(fetched.session_rows(d).select("entry", F.date_format("date", "dd"), "name", "close", "volume"))
    assert got == [("2024-01-02", "02", "A", 10.5, 1000.0), ("2024-01-02", "02", "N", 10.5, 0.0), ("2024-01-04", "04", "A", 10.5, 1000.0), ("2024-01-04", "04", "N", 10.5, 0.0), ("2024-01-10", "10", "B", 10.5, 1000.0)]
    assert not slept and d.rdd.getNumPartitions() == len(DAYS)
    d.unpersist()


def test_waits_grow_and_refusals_do_not_wait(tmp_path):
    waits = []
    f = fetched.Fetcher(archive(str(tmp_path)), retries=3, backoff=2.0, sleep=waits.append)
    assert [x[1] for x in f.rows("2024-01-05")] == ["failed"] and waits == [2.0, 4.0, 6.0]
    waits.clear()
    assert [x[1] for x in f.rows("2024-01-08")] == ["refused"] and waits == []
    f.delay = 1.5
    list(f.read(fetched.Entries(["2024-01-02", "2024-01-03"])))
    assert waits == [1.5]


def test_nothing_to_fetch(spark, tmp_path):
    d = fetched.sessions(spark, "archive-none", archive(str(tmp_path)), [])
    assert d.count() == 0 and fetched.session_rows(d).count() == 0


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    folder, state, until = scratch(spark, "out"), scratch(spark, "state"), str(tmp_path / "until")
    calls = tmp_path / "calls"
    calls.mkdir()

    def due():
        with open(until) as f:
            return int(f.read())

    spark.dataSource.register(fetched.source("archive-s", fetched.Fetcher(archive(str(calls)), sleep=lambda s: None, check=fetched.grid_header), DAYS, due))

    def go(n):
        with open(until, "w") as f:
            f.write(str(n))
        q = spark.readStream.format("archive-s").load().writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [e for e, *_ in rows(fetched.outcomes(spark.read.schema(fetched.SCHEMA).parquet(folder)))]

    assert go(2) == DAYS[:2]
    assert go(2) == DAYS[:2]
    assert go(5) == DAYS[:5]
    assert os.path.getsize(calls / "2024-01-02") == 1  # fetched once, though the stream began three times


@pytest.mark.parametrize("together", [2, 3])
def test_entries_of_a_task(spark, tmp_path, together):
    d = fetched.sessions(spark, f"archive-{together}", archive(str(tmp_path)), DAYS[:2] * 2, together=together, sleep=lambda s: None)
    assert d.rdd.getNumPartitions() == -(-4 // together)
