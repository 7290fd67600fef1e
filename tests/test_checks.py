"""Checks of bars and filings, who waits for a score, and whom a name stands for."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidebook.operators import quality, research

BARS = "ticker string, date date, close double, volume double"


def rows(d):
    return sorted(map(tuple, d.collect()), key=str)


def day(n):
    return date(2024, 1, 1) + timedelta(n)


@pytest.fixture
def market(spark):
    bars = [("a", day(k), 10.0, 5.0) for k in range(20)] + [("b", day(k), 10.0, 5.0) for k in range(5)] + [("gone", day(k), 10.0, 5.0) for k in range(5)] + [("a", day(21), 99.0, 0.0), ("stranger", day(0), 1.0, None)]
    universe = [("a", None), ("b", None), ("gone", day(6)), ("nobody", None), ("nobody", None)]
    return spark.createDataFrame(bars, BARS), spark.createDataFrame(universe, "ticker string, delisted_on date")


def actions(spark):
    return spark.createDataFrame([], "ticker string, action_type string, ex_date date, value_or_ratio double")


def test_price_checks(spark, market):
    index = spark.createDataFrame([(day(k),) for k in range(20)], "date date")
    got = rows(quality.price_checks(*market, index, "IDX", actions(spark)))
    assert ("no_data", "nobody", "") in got and ("stale_benchmark", "IDX", f"{day(19)} {day(21)}") in got
    assert ("stale_ticker", "b", f"{day(4)} 15") in got and not any(t in ("gone", "stranger") for _, t, _ in got)
    assert ("bad_volume", "a", str(day(21))) in got


def test_price_checks_without_a_calendar(spark, market):
    got = rows(quality.price_checks(*market, spark.createDataFrame([], "date date"), "IDX", actions(spark)))
    assert ("no_data", "IDX", "") in got and ("no_data", "nobody", "") in got
    assert not any(c in ("stale_ticker", "stale_benchmark", "missing_session") for c, _, _ in got)


FILINGS = "source string, published_at timestamp, instrument_id long, full_text string"
NOW = "2024-03-08 12:00:00"  # a Friday


def checked(spark, filings, feeds, **how):
    f = spark.createDataFrame(filings, FILINGS)
    return {(r["category"], r["source"]): r["value"] for r in quality.filings_checks(f, spark.createDataFrame(feeds, "name string, enabled boolean, max_hours double"), F.lit(NOW).cast("timestamp"), **how).collect()}


def test_filings_checks(spark):
    at = lambda d, h=12: datetime(2024, 3, d, h)
    filings = [("wire", at(8, 11), 1, "x" * 500), ("wire", at(8, 10), 1, None), ("wire", at(7), 1, "short"), ("slow", at(1), None, ""), ("operator", at(1), 1, "short"), ("off", at(2), 1, None)]
    feeds = [("wire", True, None), ("slow", True, None), ("operator", True, 500.0), ("off", False, None), ("never", True, None)]
    got = checked(spark, filings, feeds)
    assert got == {("feed_silent", "slow"): 120.0, ("feed_silent", "never"): None, ("filings_low_volume", "collector"): 3.0, ("filings_missing_text", "wire"): pytest.approx(2 / 3)}
    assert checked(spark, filings, feeds, least=3, ratio=0.7).keys() == {("feed_silent", "slow"), ("feed_silent", "never")}
    old = [(s, t - timedelta(days=7), i, x) for s, t, i, x in filings]
    assert checked(spark, old, feeds)[("filings_silent", "collector")] == 121.0


def test_nothing_stored_and_nothing_enabled(spark):
    assert checked(spark, [], [("wire", True, None)]) == {("filings_silent", "collector"): None, ("feed_silent", "wire"): None, ("filings_low_volume", "collector"): 0.0}
    assert checked(spark, [], [("wire", False, None)]) == {("filings_silent", "collector"): None}


def test_who_waits_by_an_instant(spark):
    d = spark.createDataFrame([(1, 7, datetime(2024, 1, 1, 12), False, 0), (2, 8, datetime(2024, 1, 1, 12), False, 0), (3, 7, datetime(2024, 1, 1, 12), True, 0), (4, 7, datetime(2024, 1, 1, 12), False, 3), (5, 7, datetime(2024, 1, 3), False, 0)], "filing_id long, instrument_id long, published_at timestamp, processed boolean, attempts int")
    at = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    assert sorted(r["filing_id"] for r in research.waiting(d, at).collect()) == [1, 2]
    assert [r["filing_id"] for r in research.waiting(d, at, instrument_id=7).collect()] == [1]
    assert research.waiting(d, at - timedelta(seconds=1)).count() == 0
    with pytest.raises(ValueError):
        research.waiting(d, datetime(2024, 1, 1))


def test_a_name_stands_for_one_instrument_or_none(spark):
    i = spark.createDataFrame([(1, "abc", "Alpha"), (2, "xyz", "Beta"), (3, "beta", None), (4, "solo", "SOLO")], "instrument_id long, ticker string, name string")
    asked = spark.createDataFrame([(" ALPHA ",), ("abc",), ("Beta",), ("solo",), ("nobody",), (None,), ("abc",)], "name string")
    got = rows(research.sole_instrument(asked, i).select("name", "instrument_id"))
    assert got == sorted([(" ALPHA ", 1), ("abc", 1), ("abc", 1), ("Beta", None), ("solo", 4), ("nobody", None), (None, None)], key=str)


def test_an_unknown_verdict_has_no_score(spark):
    from tidebook.functions import text

    d = spark.createDataFrame([("bullish", 2.0), ("bearish", 0.4), ("neutral", 1.0), ("splendid", 1.0), (None, 1.0), ("bullish", None)], "v string, c double")
    assert [r[0] for r in d.select(text.verdict_score(F.col("v"), F.col("c"))).collect()] == [1.0, -0.4, 0.0, None, None, None]


def test_made_up_bars_equal_a_loop(spark):
    import hashlib
    import math

    from tidebook.sources import files

    got = {(r["ticker"], r["date"]): tuple(r)[2:] for r in files.demo_bars(spark.createDataFrame([("pko", False), ("wig20", True), (None, False)], "ticker string, is_index boolean"), 60).collect()}
    assert len(got) == 120
    for ticker, index in (("pko", False), ("wig20", True)):
        seed = int(hashlib.sha256(ticker.encode()).hexdigest(), 16) % 2**32
        base = price = 2000.0 if index else 100.0 + seed % 80
        at, i, n = date(2015, 1, 1), 0, 0
        while n < 60:
            if at.weekday() < 5:
                wave = math.sin((seed % 1000 + i) / 17) * 0.4 + math.cos((seed % 333 + i) / 9) * 0.3
                price = max(1.0, price * (1.0004 + seed % 7 * 0.00005) + wave * 0.05 * base / 100)
                assert got[ticker, at] == pytest.approx((price * 0.998, price * 1.012, price * 0.988, price, 200_000 + i % 60 * 3_000), abs=6e-5)
                n += 1
            at, i = at + timedelta(days=1), i + 1
    assert files.demo_bars(spark.createDataFrame([], "ticker string, is_index boolean"), 5).count() == 0


def test_overrides_of_unknown_decisions_are_refused(spark):
    from tidebook.operators import stored
    from tidebook.storage import scratch
    from tidebook.tables import Table

    t = Table(spark, scratch(spark, "overrides"), ["id"], buckets=2)
    schema = "user_id string, at timestamp, decision_id long, action string, reason string"
    asked = spark.createDataFrame([("u", datetime(2024, 1, 2), 5, "skip", "x"), ("u", datetime(2024, 1, 1), None, "buy", None), ("u", datetime(2024, 1, 3), 99, "skip", None)], schema)
    decisions = spark.createDataFrame([(5,), (5,)], "id long")
    refused = [stored.append_overrides(t, asked, decisions, ("d", 1)) for _ in range(2)][-1]
    assert [r["decision_id"] for r in refused.collect()] == [99]
    assert rows(t.read().select("id", "decision_id")) == [(1, None), (2, 5)]
    assert stored.append_overrides(t, asked.limit(0), decisions, ("d", 2)).count() == 0
