"""Books, loads, gates and records: cases that the given tables don't hold."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import text
from tidebook.operators import collect, desk, gates, load, records, research, universe
from tidebook.plans import catalogue
from tidebook.sources import files

SF = "/root/testdata/sf0.001"
DAY = lambda x: dt.date.fromisoformat(x)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_books_without_anything_have_a_row(spark):
    state = frame(spark, [("a", 1.0, 100.0, DAY("2024-01-02"), 1), ("b", 2.0, 0.0, None, None)], "user_id string, cash double, initial_capital double, last_settled_date date, strategy_id int")
    equity = frame(spark, [("a", DAY("2024-01-02"), 110.0, 0.1)], "user_id string, date date, equity double, exposure double")
    none = frame(spark, [], "user_id string, status string, signal_sent boolean, fill_sent boolean")
    got = {r["user_id"]: r for r in desk.overview(state, frame(spark, [(1, "trend", 3)], "id int, name string, version int"), equity, none, none).collect()}
    assert (got["a"]["delta"], round(got["a"]["delta_pct"], 9), got["a"]["strategy_name"], got["a"]["n_open"]) == (10.0, 0.1, "trend", 0)
    assert got["b"]["delta"] is None and got["b"]["total_return"] is None and got["b"]["n_unsent"] == 0


def test_open_positions_without_a_close_come_last(spark):
    p = frame(spark, [(1, "a", 1, 10, 5.0, 4.0, "OPEN"), (2, "a", 2, 10, 5.0, None, "OPEN"), (3, "a", 3, 1, 0.0, 9.9, "OPEN"), (4, "a", 1, 1, 1.0, 1.0, "CLOSED"), (5, "a", 9, 1, 1.0, 1.0, "OPEN")], "position_id int, user_id string, instrument_id int, qty int, entry_price double, stop_price double, status string")
    i = frame(spark, [(1, "X"), (2, "Y"), (3, "Z")], "instrument_id int, ticker string")
    last = frame(spark, [(1, 6.0), (3, 10.0)], "instrument_id int, last_close double")
    rows = desk.open_positions(p, i, last, frame(spark, [("a", DAY("2024-01-02"), 200.0)], "user_id string, date date, equity double"))
    got = {r["position_id"]: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 3] and [got[k]["rank"] for k in (1, 3, 2)] == [1, 2, 3]
    assert got[1]["weight"] == 0.3 and got[2]["pnl"] is None and got[3]["pnl_pct"] is None and got[3]["near_stop"] and not got[2]["near_stop"]
    assert desk.unrealised(rows).first()["unrealised"] == 20.0


def test_texts(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    n = lambda x: F.lit(x).cast("double")
    got = row(desk.money_text(n(1234567.5)), desk.money_text(n(None)), desk.percent_text(n(0.0512)), desk.percent_text(n(-1.0), signed=False), desk.quantity_text(n(-12345.9)), desk.points_text(n(-0.0315)), desk.points_text(n(None)))
    assert list(got) == ["1 234 567,50", "—", "+5,12%", "-100,00%", "-12 345", "-3,15 p.p.", "—"]
    card = row(desk.card(F.lit("EXIT"), F.lit(None).cast("string"), F.lit(DAY("2024-05-06")), n(3.0), F.lit(7), n(None)))[0]
    assert card.split("\n")[1:] == ["Akcja: WYJSCIE", "Walor: ?", "Data: 2024-05-06", "Cena: 3.00 PLN", "Ilosc: 7"]
    assert row(*desk.snapshot_time(F.lit("gpw-20240102-030405.db")))[1] == "2024-01" and row(*desk.snapshot_time(F.lit("gpw-20241302-030405.db.gz")))[0] is None
    assert list(row(desk.identity(F.lit("Name"), F.lit("plx1"), F.lit("PLX1")), desk.identity(F.lit("Name"), F.lit("abc"), F.lit("PLX1")))) == ["Name (PLX1)", "ABC"]


def test_numbers_are_rounded_as_the_doubles_that_they_are(spark):
    """Ties go to even digits, and what only looks like a tie to its own side, as Python's formats do."""
    r = random.Random(3)
    given = [0.34625, 0.00125, 0.00375, 1.00005, -0.34625, 0.0, -0.0, -1e-9, 12345.678, float("nan"), float("inf"), *(r.choice([-1, 1]) * r.randrange(10**7) / 8e4 for _ in range(300)), *(r.uniform(-9, 9) for _ in range(300))]
    d = spark.createDataFrame(list(enumerate(given)), "i int, x double").select("i", desk.percent_text(F.col("x")), desk.points_text(F.col("x")), desk.money_text(F.col("x") * 100), desk.percent_text(F.col("x"), False, 1))
    for i, *got in d.collect():
        x = given[i] * 100
        signed = f"{x:+.2f}".replace(".", ",")
        assert got == [f"{signed}%", f"{signed} p.p.", f"{x:,.2f}".replace(",", "\u00a0").replace(".", ","), f"{x:.1f}%".replace(".", ",")]


def test_hashes_are_of_canonical_json():
    want = hashlib.sha256(json.dumps({"a": [1, "ż"], "b": "2024-01-02"}, sort_keys=True).encode()).hexdigest()
    assert records.digest({"b": DAY("2024-01-02"), "a": [1, "ż"]}) == want != records.digest({"b": DAY("2024-01-02"), "a": [1, "ż"]}, ascii_only=False)
    config = {"costs": {"x": 1}, "initial_capital": 5, "paper": {"y": 2}, "universe": {"index": "wig"}}
    assert records.trial_hash({}, config) == records.trial_hash({}, config | {"paper": None}) != records.trial_hash({}, config | {"initial_capital": 6})
    assert records.book_hash({}, config, {}) == records.book_hash({}, config | {"initial_capital": 6}, {}) != records.book_hash({}, config, {"instruments": ["a"]})


def test_results_of_runs_replace_their_own_rows(spark):
    days = frame(spark, [(DAY("2024-01-02"), 0), (DAY("2024-01-03"), 1)], "date date, session long")
    ddl = "run_id string, session long, kind string, id int, qty long, price double, fee double, equity double, cash double, exposure double"
    events = frame(spark, [("x", 1, "ENTER", 3, 5, 2.0, 0.1, None, None, None), ("x", 1, "equity", None, None, None, None, 9.0, 1.0, 0.5), ("x", 0, "EXIT", 4, 5, 2.0, 0.1, None, None, None), ("x", 1, "CLOSE", 3, 5, 2.0, 0.1, None, None, None)], ddl)
    decided = frame(spark, [(7, "x", 1, None, None, "ENTER"), (9, "y", 1, None, None, "EXIT")], "id long, user_id string, instrument_id int, decision_date date, fill_date date, action string")
    traded = frame(spark, [(1, "y", 1, "BUY", 1, 1.0, 0.0, None)], "id long, user_id string, instrument_id int, side string, qty long, price double, fee double, date date")
    curve = frame(spark, [("x", DAY("2023-01-02"), 1.0, 1.0, 0.0), ("y", DAY("2023-01-02"), 1.0, 1.0, 0.0)], "user_id string, date date, equity double, cash double, exposure double")
    d, t, c = records.result_of(events, days, (decided, traded, curve))
    assert sorted((r["user_id"], r["id"], r["action"], r["decision_date"]) for r in d.collect()) == [("x", 10, "EXIT", None), ("x", 11, "ENTER", DAY("2024-01-02")), ("y", 9, "EXIT", None)]
    assert sorted((r["user_id"], r["side"]) for r in t.collect()) == [("x", "BUY"), ("x", "SELL"), ("x", "SELL"), ("y", "BUY")] and c.count() == 2
    with pytest.raises(ValueError):
        records.result_of(events.withColumn("run_id", F.lit("paper:me")), days, (decided, traded, curve))
    with pytest.raises(ValueError):
        records.labelled(frame(spark, [], "filing_id long, label string, labelled_at long"), frame(spark, [(1, "great", 1)], "filing_id long, label string, labelled_at long"))
    trials = records.trial(frame(spark, [(4, "h", None, "{}")], "id long, config_hash string, run_at timestamp, metrics string"), "h2", frame(spark, [(1.5, 2)], "sharpe double, n int"), F.lit("2024-01-01").cast("timestamp")).first()
    assert trials["id"] == 5 and json.loads(trials["metrics"]) == {"n": 2, "sharpe": 1.5}
    odd = frame(spark, [("x", "anomaly", "no bar"), ("x", "anomaly", "no bar"), ("y", "ENTER", None)], "run_id string, kind string, note string")
    assert [tuple(r) for r in records.anomalies(odd).collect()] == [("x", "no bar", 2)]


def test_loads(spark):
    stored = frame(spark, [(3, "abc", "Old", None)], "id long, ticker string, name string, isin string")
    got = load.instruments(stored, frame(spark, [("ABC", None, "PL1"), ("new", "New", None)], "ticker string, name string, isin string")).collect()
    assert sorted((r["id"], r["ticker"], r["name"], r["isin"]) for r in got) == [(3, "abc", "Old", "PL1"), (4, "new", "New", None)]
    rows = frame(spark, [(DAY("2024-01-05"), "A1", "PLN"), (DAY("2024-01-05"), "b2", "EUR"), (DAY("2024-01-05"), "C3", "PLN")], "date date, isin string, currency string")
    universe = frame(spark, [("one", "a1", None, None), ("two", "b2", None, None), ("none", None, None, None), ("gone", "G9", DAY("2020-01-01"), None), ("late", "L9", None, DAY("2030-01-01"))], "ticker string, isin string, delisted_on date, listed_from date")
    assert [r["ticker"] for r in load.matched(rows, universe).collect()] == ["one"]
    assert sorted(r["ticker"] for r in load.matched(rows, universe, True).collect()) == ["c3", "one"]
    said = lambda r, a, b: sorted((x["ticker"], x["reason"]) for x in load.absences(r, universe, F.lit(a).cast("date"), F.lit(b).cast("date")).collect())
    assert said(rows.filter("isin != 'b2'"), "2024-01-01", "2024-01-31") == [("none", "no isin"), ("two", "not in any file")]
    assert said(rows, "2024-02-01", "2024-02-02") == [("none", "no isin")]
    index = frame(spark, [(DAY("2024-01-04"), "WIG20TR", "I1"), (DAY("2024-01-05"), "other", "I2")], "date date, name string, isin string")
    assert load.index_isin(index, "wig20tr", F.lit("2024-01-04").cast("date")).first()["isin"] == "I1" and load.index_isin(index, "wig20tr", F.lit("2024-01-06").cast("date")).isEmpty()
    members = frame(spark, [("wig", 3, DAY("2001-01-01"), None, "f"), ("old", 3, DAY("2001-01-01"), None, "f")], "index_name string, instrument_id long, date_from date, date_to date, source string")
    given = frame(spark, [("WIG", "ABC", DAY("2002-01-01"), None, "f"), ("WIG", "abc", DAY("2002-01-01"), DAY("2003-01-01"), "f"), ("WIG", "nobody", DAY("2002-01-01"), None, "f")], "index_name string, ticker string, date_from date, date_to date, source string")
    good, unknown = load.membership(members, given, stored.select(F.col("id").alias("instrument_id"), "ticker"))
    assert sorted((r["index_name"], str(r["date_from"]), r["date_to"]) for r in good.collect()) == [("old", "2001-01-01", None), ("wig", "2002-01-01", None)] and [r["ticker"] for r in unknown.collect()] == ["nobody"]


def gate(spark, rows=None, state=None, **more):
    rows = rows or [(i, DAY(f"2024-01-{d:02d}"), "real") for d in range(1, 21) for i in (1, 2, 3)]
    prices = frame(spark, rows, "instrument_id int, date date, source string")
    names = frame(spark, [(1, None), (2, None), (3, DAY("2024-01-10"))], "instrument_id int, delisted_on date")
    books = frame(spark, state or [("a", "h", DAY("2024-01-19")), ("b", "h", None), ("c", "h", DAY("2024-01-20"))], "user_id string, config_hash string, last_settled_date date")
    return {r["user_id"]: (r["sessions"], r["reason"]) for r in gates.paper_gate(prices, names, books, F.lit(more.pop("today", "2024-01-21")).cast("date"), "h", **more).collect()}


def test_a_book_runs_or_is_refused(spark):
    assert gate(spark) == {"a": (1, None), "b": (1, None), "c": (0, None)}
    assert gate(spark, lag=0)["a"][1] == "lag"
    assert gate(spark, rows=[(1, DAY("2024-01-20"), "demo")])["a"][1] == "demo bars"
    assert gate(spark, today="2024-02-01")["a"][1] == "stale" and gate(spark, today="2024-02-01", replay=True)["a"][1] is None
    thin = [(i, DAY(f"2024-01-{d:02d}"), "real") for d in range(1, 20) for i in (1, 2)] + [(3, DAY("2024-01-20"), "real")]
    assert gate(spark, rows=thin)["a"][1] == "coverage"
    old = [("a", "g", DAY("2024-01-19"))]
    assert gate(spark, state=old)["a"][1] == "config changed" and gate(spark, state=old, accept_change=True)["a"][1] is None
    assert gate(spark, state=[("a", "h", DAY("2024-01-02"))])["a"] == (18, "too far behind")


def test_candidates_need_floors_and_values(spark):
    ddl = "run_id string, cagr double, sharpe double, sortino double, max_drawdown double, calmar double, total_return double, n_trades int, dsr double, percentile double"
    rows = [("base", 0.1, 1.0, 1.0, -0.2, 0.5, 1.0, 9, None, None), ("good", 0.1, 1.1, 1.0, -0.2, 0.5, 1.0, 9, 0.97, 0.99), ("luck", 0.1, 1.1, 1.0, -0.2, 0.5, 1.0, 9, 0.5, None), ("deep", 0.1, 1.1, 1.0, -0.3, 0.5, 1.0, 9, 0.97, 0.99)]
    floors = {"min_dsr": 0.95, "min_random_percentile": 0.95}
    got = {r["run_id"]: (r["better"], r["accepted"], r["notes"]) for r in gates.compared(frame(spark, rows, ddl), "base", floors).collect()}
    assert got == {"good": (True, True, ""), "luck": (True, False, "dsr under 0.95; percentile missing"), "deep": (False, False, "")}
    assert not any(r["accepted"] for r in gates.compared(frame(spark, rows, ddl), "base", {"min_dsr": 0.0}).collect())


@pytest.mark.parametrize("name", ["books_overview", "paper_gate", "service_status"])
def test_queries_keep_their_columns(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_feeds_of_both_kinds_and_zones(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title> T </title><guid>g</guid><pubDate>Mon, 06 May 2024 09:00:00 +0100</pubDate></item><item><title>U</title><link>l</link><guid> </guid><pubDate>soon</pubDate></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed><entry><title>A</title><id>i</id><link rel="self" href="s"/><link href="h"/><updated>2024-05-06T09:00:00Z</updated></entry><entry><title></title><id>j</id><updated>2024-05-06T09:00:00Z</updated></entry></feed>')
    utc = lambda d: {r["title"]: (r["dedup_key"], r["link"], str(r["t"])) for r in d.withColumn("t", F.date_format("published_at", "HH:mm")).collect()}
    assert utc(files.feed_items(spark, str(tmp_path))) == {"T": ("g", None, "08:00"), "A": ("i", "h", "09:00")}
    assert utc(files.feed_items(spark, str(tmp_path), "Europe/Warsaw")) == {"T": ("g", None, "07:00"), "A": ("i", "h", "07:00")}
    key = spark.range(1).select(text.item_key(F.lit(" "), F.lit("l"), F.lit("x")), text.item_key(F.lit(None).cast("string"), F.lit(""), F.lit("x"))).first()
    assert key[0] == "l" and key[1] == hashlib.sha256(b"x\0").hexdigest()


def test_a_cycle_is_sound_only_if_all_feeds_are(spark):
    state = frame(spark, [(1, dt.datetime(2024, 1, 1), None, "old")], "id int, last_success timestamp, last_error timestamp, message string")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    done = lambda rows: collect.beacon(state, frame(spark, rows, "feed string, status string"), at).first()
    assert done([("a", "ok"), ("b", "ok")])["last_success"] == dt.datetime(2024, 1, 2)
    for rows in ([("a", "ok"), ("b", "skipped")], []):
        r = done(rows)
        assert r["last_success"] == dt.datetime(2024, 1, 1) and r["last_error"] == dt.datetime(2024, 1, 2)


def test_scans_and_modes(spark):
    prices = frame(spark, [(1, DAY("2024-01-02"), DAY("2024-01-02"), 1.0, False), (1, DAY("2024-01-02"), DAY("2024-01-05"), 2.0, True), (2, DAY("2024-01-02"), DAY("2024-01-02"), 3.0, False)], "instrument_id int, date date, as_of_date date, close double, adjusted boolean")
    names = frame(spark, [(1, "A", None), (2, "I", True)], "instrument_id int, ticker string, is_index boolean")
    assert [r["close"] for r in universe.price_scan(prices, names).collect()] == [1.0]
    at = lambda x: F.lit(x).cast("date")
    assert universe.prices_asof(prices, 1, at("2024-01-04"), adjusted=True).isEmpty() and universe.prices_asof(prices, 1, at("2024-01-05"), adjusted=True).count() == 1
    assert universe.close_series(prices, names, "I").first()["close"] == 3.0 and universe.close_series(prices, names, "no").isEmpty()
    d = names.select("ticker")
    assert universe.of_mode(d, d.limit(1), "config").count() == 1 and universe.of_mode(d, d.limit(1), "full").count() == 2
    with pytest.raises(ValueError):
        universe.of_mode(d, d, "half")


@pytest.fixture
def coarse(spark):
    """Few rows are dealt as many are: in several ranges, with bounds from a small sample, so that two runs of a plan deal them differently."""
    given = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_candidate_has_its_place_whatever_the_ranges(spark, coarse):
    n = 20_000
    d = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n).alias("published_at"), F.lit(0).alias("feed_ord"), "id").withColumnRenamed("id", "pos")
    got = desk.in_order(d).select("published_at", "place").collect()
    assert len(got) == n and all(r["published_at"] == r["place"] for r in got)


def test_ids_of_a_log_go_on_without_gaps_whatever_the_ranges(spark, coarse):
    n = 20_000
    d = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n).alias("at"))
    got = records.numbered(spark.createDataFrame([(4,), (2,)], "id long"), d, ["at"]).collect()
    assert len(got) == n and all(r["id"] == r["at"] + 5 for r in got)


def test_no_task_orders_all_calls_of_a_month(spark, coarse):
    n = 5_000
    d = spark.range(n, numPartitions=8).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7919 % n * 1000).alias("at"), (F.col("id") % 9).cast("double").alias("usd"), (F.col("id") % 4 == 0).alias("cached"))
    found = research.within_budget(d, 3_000.0)
    spent, want = {}, {}
    for r in sorted(d.collect(), key=lambda r: (r["at"], r["id"])):
        month = r["at"].strftime("%Y-%m")
        want[r["id"]] = (spent.get(month, 0.0), r["cached"] or spent.get(month, 0.0) < 3_000)
        spent[month] = spent.get(month, 0.0) + (0.0 if r["cached"] else r["usd"])
    assert {r["id"]: (r["spent"], r["allowed"]) for r in found.collect()} == want and len(spent) > 1
    most = found.sparkSession.read.parquet(found.inputFiles()[0].rpartition("/")[0]).groupBy("_part", "_month").count().agg(F.max("count")).first()[0]
    assert most < n // 2
