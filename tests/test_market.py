"""Known values, and what must hold whatever the data."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebook.functions import money, text
from tidebook.operators import features, guards, metrics, quality, refdata, research, rules, simulation, universe
from tidebook.operators.asof import align, asof
from tidebook.operators.book import Book, Position, Replay
from tidebook.sources import files
from tidebook.streaming.paper import paper_book

RISK = rules.TREND["risk"]


def days(n, start=date(2020, 1, 1)):
    return [start + timedelta(days=i) for i in range(n)]


def frame(spark, closes, ticker="A", volume=1000.0):
    rows = [(ticker, d, c, c, c, c, volume) for d, c in zip(days(len(closes)), closes, strict=True)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def one(d, *columns):
    return [tuple(r) for r in d.select(*columns).collect()]


def test_average_needs_a_full_frame(spark):
    got = one(features.averages(frame(spark, [float(i) for i in range(60)])).orderBy("date"), "sma50")
    assert got[48] == (None,) and got[49] == (24.5,)


def test_a_null_close_leaves_the_frame_open(spark):
    got = one(features.averages(frame(spark, [1.0] * 30 + [None] + [1.0] * 30)).orderBy("date"), "sma50")
    assert got[60] == (None,)


def test_values_do_not_change_when_later_rows_come(spark):
    closes = [100 + 10 * math.sin(i / 5) for i in range(150)]
    early = {r["date"]: r for r in features.panel(frame(spark, closes[:130])).collect()}
    late = {r["date"]: r for r in features.panel(frame(spark, closes)).collect()}
    assert all(early[d] == late[d] for d in early)


def test_true_range_of_first_row(spark):
    d = spark.createDataFrame([("A", date(2020, 1, 1), 9.0, 12.0, 8.0, 10.0, 1.0), ("A", date(2020, 1, 2), 15.0, 16.0, 15.0, 15.0, 1.0)], "ticker string, date date, open double, high double, low double, close double, volume double")
    assert one(d.withColumn("t", features.true_range()).orderBy("date"), "t") == [(4.0,), (6.0,)]


def test_asof_keeps_a_null_and_never_looks_ahead(spark):
    left = spark.createDataFrame([("A", date(2020, 1, d)) for d in (1, 5, 9)], "k string, at date")
    right = spark.createDataFrame([("A", date(2020, 1, 2), 1.0), ("A", date(2020, 1, 5), None)], "k string, known date, v double")
    assert one(asof(left, right, "k", "at", "known", ["v"]).orderBy("at"), "v") == [(None,), (None,), (None,)]
    assert one(asof(left, right, "k", "at", "known", ["v"], strict=True).orderBy("at"), "v") == [(None,), (1.0,), (None,)]


def test_align_fills_forward_then_back(spark):
    ds = spark.createDataFrame([(d,) for d in days(4)], "date date")
    s = spark.createDataFrame([(days(4)[1], 5.0)], "date date, close double")
    assert one(align(ds, s).orderBy("date"), "close") == [(5.0,)] * 4


def test_rules(spark):
    d = spark.createDataFrame([(1.0, None)], "a double, b double")
    ok = lambda c: d.select(rules.clause(c)).first()[0]
    a = {"feature": "a", "op": "gte", "value": 1}
    assert ok({"all": []}) and not ok({"any": []}) and ok({"all": [a], "any": []})
    assert not ok({"all": [a, {"feature": "b", "op": "lt", "value": 9}]})
    with pytest.raises(ValueError):
        rules.condition({"feature": "a", "op": "near", "value": 1})
    with pytest.raises(ValueError):
        rules.condition({"type": "other"})
    assert rules.without_model_features({"entry": {"all": [{"feature": "llm_score", "op": "gt", "value": 0}]}}) is None
    both = {"entry": {"all": [{"feature": "llm_score", "op": "gt", "value": 0}, {"feature": "x", "op": "gt", "value": 0}]}, "exit": {"any": [{"feature": "llm_score", "op": "lt", "value": 0}]}}
    assert rules.without_model_features(both) == both | {"entry": {"all": [{"feature": "x", "op": "gt", "value": 0}]}} and rules.features_read(both) == {"llm_score", "x"}
    with pytest.raises(ValueError):
        rules.clause({"some": []})
    flat = spark.range(1).select(rules.signal({"entry": {"any": []}}, F.lit(True)).alias("held"), rules.signal({}, F.lit(False)).alias("flat")).first()
    assert tuple(flat) == ("HOLD", "HOLD")


def test_tiers(spark):
    d = spark.createDataFrame([(20e6,), (5e6,), (100.0,), (None,)], "t double")
    assert [r[0][0] for r in d.select(money.tier_rates(F.col("t"))).collect()] == [20.0, 35.0, 250.0, 250.0]
    assert [money.Costs().rates(x)[0] for x in (20e6, 5e6, 100.0, None)] == [20.0, 35.0, 250.0, 250.0]


def test_fills():
    flat = money.Costs(tiers=())
    assert flat.fill(True, 100, 100.0, 1e6, None)[1] == pytest.approx(100.20)
    assert flat.fill(False, 100, 100.0, 1e6, None)[1] == pytest.approx(99.80)
    assert flat.fill(True, 1, 10.0, 1e6, None)[2] == 3.0
    assert flat.fill(True, 500, 10.0, 1000.0, None)[0] == 100


def test_sizes(spark):
    l = lambda *x: [F.lit(float(v)) for v in x]  # noqa: E731, E741
    q = lambda price, atr, *state: spark.range(1).select(money.size(*l(price, atr), *l(*state), RISK)["qty"]).first()[0]
    assert q(100, 4, 1e5, 1e5, 1e5, 0, 0, 0, 0) == 100
    assert q(100, 0.1, 1e5, 1e5, 1e5, 0, 0, 0, 0) == 200
    assert q(100, 0.1, 1e5, 1e5, 1e5, 0, 0, 39_000, 0) == 10
    assert q(100, 0.1, 1e5, 1e5, 500, 0, 0, 0, 0) == 5
    assert q(100, 4, 1e5, 1e5, 1e5, 8, 0, 0, 0) == 0
    assert q(100, 4, 7e4, 1e5, 1e5, 0, 0, 0, 0) == 0


def test_metrics(spark):
    d = spark.createDataFrame([("r", x, e) for x, e in zip(days(4), [100.0, 120.0, 90.0, 110.0], strict=True)], "run_id string, date date, equity double")
    assert metrics.curve_metrics(d).first()["max_drawdown"] == pytest.approx(-0.25)
    t = metrics.trade_metrics(spark.createDataFrame([("r", p) for p in (10.0, 20.0, -5.0, -5.0)], "run_id string, pnl double")).first()
    assert (t["win_rate"], t["profit_factor"]) == (0.5, 3.0)
    v = spark.createDataFrame([(1, 2.0), (2, 2.5)], "id int, x double")
    y = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "y double")
    assert sorted(one(metrics.midrank(v, y), "id", "percentile")) == [(1, 0.375), (2, 0.5)]


def test_trials_use_the_latest_valid_row(spark):
    rows = [(1, "A", '{"sharpe_pp": 0.02}'), (2, "A", '{"sharpe_pp": 0.03}'), (3, "B", '{"sharpe_pp": -0.01}'), (4, "B", "broken")]
    s = metrics.trial_stats(spark.createDataFrame(rows, "id long, config_hash string, metrics string")).first()
    assert s["n_trials"] == 2 and s["variance"] == pytest.approx(0.0004)


def test_walk_forward():
    cal = days(1500)
    w = metrics.walk_forward(cal, 12, 6, 10)
    assert w[0][2] == cal[cal.index(date(2021, 1, 1)) + 10] and w[-1][3] == cal[-1]
    assert metrics.walk_forward([]) == []


def test_adjustment(spark):
    b = frame(spark, [100.0, 100.0, 50.0, 50.0])
    cal = features.calendar(b)
    act = lambda kind, v: spark.createDataFrame([("A", kind, days(4)[2], v)], "ticker string, action_type string, ex_date date, value_or_ratio double")
    d = refdata.back_adjusted(b, act("split", 2.0), cal).orderBy("date")
    assert one(d, "close", "volume") == [(50.0, 2000.0)] * 2 + [(50.0, 1000.0)] * 2
    d = refdata.back_adjusted(frame(spark, [100.0, 100.0, 90.0, 90.0]), act("dividend", 10.0), cal).orderBy("date")
    assert [r[0] for r in one(d, "close")] == pytest.approx([90.0] * 4)


def test_reverse_split_pays_the_part_of_a_share():
    b = Book(0.0, 0.0, {1: Position(15, 100.0, 90.0, 0)})
    b.action(1, "split", 0.1, 100.0)
    assert (b.positions[1].qty, round(b.cash, 9), b.positions[1].entry) == (1, 500.0, 1000.0)


def test_upsert_and_first_write(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(one(refdata.upsert(base, new, ["k"], F.col("v")), "k", "v")) == [(1, "a"), (2, "c"), (3, "e")]
    assert one(refdata.insert_new(base, new, ["k"], F.col("v")), "k", "v") == [(3, "d")]


def test_gaps(spark):
    a, b = frame(spark, [1.0] * 6), frame(spark, [1.0] * 6, "B").filter("day(date) not in (2, 3)")
    u = a.unionByName(b)
    assert [r[1].day for r in sorted(one(quality.missing_sessions(u, features.calendar(u)), "ticker", "date"))] == [2, 3]


def test_business_hours(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 5, 18), datetime(2024, 1, 8, 6))], "a timestamp, b timestamp")
    assert d.select(quality.business_hours(F.col("a"), F.col("b"))).first()[0] == pytest.approx(12.0)


def test_text(spark):
    d = spark.createDataFrame([("Bank Polski S.A.: report 12 / 2024", "<p>a<b>b</b></p>", "Mon, 05 Feb 2024 10:00:00 +0100")], "t string, h string, p string")
    r = d.select(text.issuer(F.col("t")), text.strip_html(F.col("h")), F.date_format(text.published_at(F.col("p")), "HH:mm"), text.report_number(F.lit("Nr 12 / 2024")), text.isin(F.lit(None), F.lit("x PLPKO0000016 y"))).first()
    assert tuple(r) == ("Bank Polski", "a b", "09:00", "12/2024", "PLPKO0000016")


def test_strict_json(spark):
    ok = lambda s: spark.range(1).select(text.strict_json(F.lit(s), {"conviction": (0, 1)}, {"verdict": ["bullish", "bearish"]}, ["rationale"])).first()[0]
    assert ok('{"verdict": "bullish", "conviction": 0.5, "rationale": "x"}')
    for bad in ('{"verdict": "bullish", "conviction": 2, "rationale": "x"}', '{"verdict": "bullish", "conviction": "0.5", "rationale": "x"}', '{"verdict": "up", "conviction": 0.5, "rationale": "x"}', '{"verdict": "bullish", "conviction": 0.5, "rationale": "x", "more": 1}', "no"):
        assert not ok(bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Data,Otwarcie,Najwyzszy,Najnizszy,Zamkniecie\n2024-01-02,1,2,0.5,1.5\n2024-01-03,x,2,1,1\n")
    assert one(files.daily_csv(spark, str(tmp_path / "a.csv")), "close", "volume") == [(1.5, 0.0)]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        files.daily_csv(spark, str(tmp_path / "b.csv"))
    grid = [["Data", "Nazwa", "ISIN", "Waluta", "Kurs otwarcia", "Kurs max", "Kurs min", "Kurs zamknięcia", "Zmiana", "Wolumen"], ["2024-01-02", "AAA", "PL1", "PLN", "1,0", "2", "1", "1 000,5", "0", ""], ["2024-01-02", "BBB", "PL2", "PLN", "", "", "", "", "", ""]]
    assert one(files.session_grid(spark, grid), "name", "close", "volume") == [("AAA", 1000.5, 0.0)]
    chart = '{"chart":{"result":[{"timestamp":[300,600,900],"indicators":{"quote":[{"open":[1,null,3],"high":[1,2,3],"low":[1,2,3],"close":[1,2,3],"volume":[null,1,1]}]}}]}}'
    d = spark.createDataFrame([("A", chart)], "ticker string, value string")
    assert one(files.intraday_json(d, "ticker", drop_last=False).orderBy("bar_start"), "close", "volume") == [(1.0, 0.0), (3.0, 1.0)]
    assert files.intraday_json(d, "ticker").count() == 1
    index = spark.createDataFrame([('[{"data":[{"t":1704150000,"o":0,"h":2,"l":1,"c":3}]}]',)], "value string")
    assert one(files.index_json(index), "open", "close") == [(3.0, 3.0)]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><guid>g</guid><pubDate>Mon, 06 May 2024 09:00:00 +0200</pubDate></item><item><title> </title></item></channel></rss>")
    assert one(files.feed_items(spark, str(tmp_path / "f.xml")), "title", "guid") == [("T", "g")]


@pytest.fixture(scope="module")
def run(spark):
    """A small made-up market and its candidates."""
    d = files.synthetic_bars(spark, ["A", "B", "C"], 500)
    d = features.turnover(features.atr(features.averages(features.returns(d)))).cache()
    cal = features.calendar(d).cache()
    inst = spark.createDataFrame([("A", 1, 0), ("B", 2, 0), ("C", 3, 1)], "ticker string, instrument_id int, sector int").withColumn("delisted_on", F.lit(None).cast("date"))
    acts = spark.createDataFrame([("A", "split", date(2016, 3, 6), 2.0)], "ticker string, action_type string, ex_date date, value_or_ratio double")
    return simulation.candidates("r", d, inst, cal, acts, rules.TREND, 1.0).cache(), d, cal, inst


def test_equity_is_cash_and_holdings(run):
    rows, _, _, _ = run
    events = simulation.simulate(rows, 0, 499, RISK).orderBy("session").collect()
    equity = [e for e in events if e["kind"] == "equity"]
    assert len(equity) == 500 and any(e["kind"] == "ENTER" for e in events)
    cash = 100_000.0
    for e in events:
        if e["kind"] == "ENTER":
            cash -= e["qty"] * e["price"] + e["fee"]
        elif e["kind"] in ("EXIT", "CLOSE"):
            cash += e["qty"] * e["price"] - e["fee"]
    assert abs(cash - equity[-1]["cash"]) < 1.0 or any(r["actions"] for r in rows.collect())
    assert all(abs(e["cash"] + e["exposure"] * e["equity"] - e["equity"]) < 1e-6 for e in equity)


def test_paper_book_follows_the_backtest(spark, run, tmp_path):
    rows, _, _, _ = run
    want = [tuple(r) for r in simulation.simulate(rows, 0, 499, RISK).filter("kind = 'equity' and session < 499").orderBy("session").select("session", "equity").collect()]
    folder = str(tmp_path / "in")
    for low in (0, 200, 350):
        rows.filter(F.col("session").between(low, {0: 199, 200: 349, 350: 499}[low])).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = paper_book(source, 0, RISK).writeStream.format("memory").queryName("paper").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("select session, equity from paper where kind = 'equity' and session < 499 order by session").collect()]
    assert [s for s, _ in got] == [s for s, _ in want]
    assert [e for _, e in got] == pytest.approx([e for _, e in want], rel=1e-12)


def test_random_runs_are_the_same_whatever_the_partitions(spark, run):
    _, d, cal, inst = run
    ok = universe.random_entries(d, inst, cal, 1.0)
    a = simulation.random_runs(d, ok, cal, inst, [5, 10], 5, 3, 1, RISK).orderBy("run_id", "date").collect()
    b = simulation.random_runs(d.repartition(5), ok.repartition(3), cal, inst, [5, 10], 5, 3, 1, RISK).orderBy("run_id", "date").collect()
    assert a == b and len(a) == 1500 and any(r["equity"] != 100_000.0 for r in a)


def test_random_entries_span_the_calendar(spark):
    cal = spark.range(1000).select(F.col("id").alias("session"))
    got = simulation.attempts(cal, [3, 7], 40, 30, 5, 10).collect()
    first = [r["session"] for r in got if r["attempt"] == 0]
    assert len(first) == 1200 and min(first) < 20 and 980 < max(first) < 999 and abs(sum(first) / 1200 - 499) < 30
    chains = {}
    for r in sorted(got, key=lambda r: r["attempt"]):
        chains.setdefault((r["run"], r["draw"]), []).append(r)
    for c in chains.values():
        s = [r["session"] for r in c]
        assert s == sorted(set(s)) and s[-1] < 999 and len({r["hold"] for r in c}) == 1 and (len(s) == 10 or s[-1] >= 998)


def test_random_runs_equal_a_plain_replay(spark, run):
    """Every run again, by dicts over all bars, one session after the other."""
    _, d, cal, inst = run
    ok = universe.random_entries(d, inst, cal, 1.0)
    risk, costs, capital, entries, last = RISK, money.Costs(), 100_000.0, 12, 499
    got = {}
    for r in simulation.random_runs(d, ok, cal, inst, [5, 10, 30], entries, 4, 3, risk, slack=500).join(cal, "date").collect():
        got.setdefault(int(r["run_id"]), {})[r["session"]] = r["equity"]
    bars = {(r["ticker"], r["session"]): r for r in d.join(cal, "date").collect()}
    sector = {r["ticker"]: r["sector"] for r in inst.collect()}
    able = {}
    for r in ok.filter("ok").orderBy("ticker").collect():
        able.setdefault(r["session"], []).append(r["ticker"])
    chains = {}
    for r in simulation.attempts(cal, [5, 10, 30], entries, 4, 3, 10).orderBy("attempt").collect():
        if able.get(r["session"]):
            chains.setdefault(r["run"], {}).setdefault(r["draw"], []).append(r)
    close = lambda t, s: (bars[t, s]["close"] if (t, s) in bars else None) or 0.0
    for run_id, by_draw in chains.items():
        cash, qty, held, peak, n, name_of = [0.0] * 500, {}, [], capital, 0, {}

        def worth(p, s, qty=qty):
            return close(p["t"], s) * sum(q for at, q in qty[p["k"]] if at <= s)

        def sell(p, cash=cash, qty=qty):
            tier = next((bars[p["t"], s]["turnover_med_63"] for s in range(p["exit"] - 1, -1, -1) if (p["t"], s) in bars and bars[p["t"], s]["turnover_med_63"] is not None), None)
            for s in range(p["exit"], 500):
                left, b = sum(q for _, q in qty[p["k"]]), bars.get((p["t"], s))
                if b and left:
                    q, paid, fee = costs.fill(False, left, b["open"] if b["open"] is not None else b["close"], b["volume"], tier)
                    if q:
                        cash[s] += paid * q - fee
                        qty[p["k"]].append((s, -q))

        waiting = {k: list(v) for k, v in by_draw.items()}
        while n < entries and any(waiting.values()):
            s, k = min((v[0]["session"], k) for k, v in waiting.items() if v)
            row = waiting[k].pop(0)
            for p in [p for p in held if p["exit"] <= s]:
                sell(p)
                held.remove(p)
            names = able[s]
            t = names[int(row["pick"] * len(names))]
            have, now = capital + sum(cash[: s + 1]), bars[t, s]
            if len(held) >= risk["max_open_positions"] or (t, s + 1) not in bars:
                continue
            equity = have + sum(worth(p, s) for p in held)
            peak = max(peak, equity)
            gap = now["close"] - max(0.0, now["close"] - risk["atr_mult_stop"] * now["atr"])
            if 1 - equity / peak > risk["drawdown_circuit_breaker"] or gap <= 0:
                continue
            room = [risk["max_exposure_per_name"] * equity - sum(worth(p, s) for p in held if p["t"] == t), risk["max_total_exposure"] * equity - sum(worth(p, s) for p in held), max(0.0, have)]
            if "max_exposure_per_sector" in risk:
                room.append(risk["max_exposure_per_sector"] * equity - sum(worth(p, s) for p in held if sector[p["t"]] == sector[t]))
            want = int(min([equity * risk["risk_per_trade"] // gap, *(max(0.0, x) // now["close"] for x in room)]))
            nxt = bars[t, s + 1]
            q, paid, fee = costs.fill(True, want, nxt["open"] or nxt["close"], nxt["volume"], now["turnover_med_63"])
            if q <= 0:
                continue
            cash[s + 1] -= paid * q + fee
            qty[n] = [(s + 1, q)]
            waiting[k] = []
            held.append({"t": t, "k": n, "exit": min(s + 1 + row["hold"], last)})
            n += 1
            name_of[n - 1] = t
        for p in held:
            sell(p)
        assert n > 0
        final = got[run_id]
        for s in range(500):
            stock = sum(close(name_of[k], s) * sum(q for at, q in qty[k] if at <= s) for k in qty)
            assert final[s] == pytest.approx(capital + sum(cash[: s + 1]) + stock, rel=1e-9)


def test_state_survives_json():
    r = Replay(RISK, money.Costs(), 1000.0, 0)
    r.book.positions[3] = Position(2, 1.0, 0.5, None, {"close": 1.0})
    s = Replay(RISK, money.Costs(), 1.0, 0)
    s.load(r.dump())
    assert s.book == r.book


def test_guards(spark):
    prices = spark.createDataFrame([(1, "demo")], "instrument_id int, source string")
    guards.one_kind_of_source(prices, "demo")
    with pytest.raises(ValueError):
        guards.one_kind_of_source(prices, "archive")
    real, derived = guards.purge(prices, {"x": prices})
    assert real.count() == 0 and derived["x"].count() == 0
    state = spark.createDataFrame([(1, datetime(2024, 1, 1), None, "ok")], "id int, last_success timestamp, last_error timestamp, message string")
    h = guards.health(state, F.lit("2024-01-02").cast("timestamp"), False, "down").first()
    assert h["last_success"] == datetime(2024, 1, 1) and h["last_error"] == datetime(2024, 1, 2)


def test_alerts_come_once(spark):
    p = spark.createDataFrame([(1, 7, 100.0, date(2024, 1, 2)), (2, 8, 10.0, date(2024, 1, 2))], "position_id int, instrument_id int, stop_price double, session_date date")
    b = spark.createDataFrame([(7, datetime(2024, 1, 2, 10), 101.0), (7, datetime(2024, 1, 2, 11), 99.0), (8, datetime(2024, 1, 1, 11), 1.0)], "instrument_id int, bar_start timestamp, close double")
    sent = spark.createDataFrame([], "position_id int, session_date date, state string")
    got = guards.alerts(p, b, 0.02, sent)
    assert one(got, "position_id", "state") == [(1, "BREACH")] and guards.alerts(p, b, 0.02, got).count() == 0


def test_attempts_and_regression(spark):
    f = spark.createDataFrame([(1, False, 0), (2, False, 2), (3, False, 1)], "filing_id int, processed boolean, attempts int")
    a = research.after_attempt(f, f.filter("filing_id = 1"), f.filter("filing_id = 2"))
    assert sorted(one(a, "filing_id", "processed", "attempts")) == [(1, True, 0), (2, False, 3), (3, False, 1)]
    runs = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.7), (3, "b", 0.6)], "id int, config_hash string, f1 double")
    x = research.regression(runs).first()
    assert (x["config_hash"], x["previous"]) == ("b", 0.5) and x["delta"] == pytest.approx(0.1)
