"""Queries that simulate portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import metrics, rules, simulation, universe
from ..sources import market as m
from ..storage import written
from .features import FLOOR, r

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def traded(spark, sf_dir):
    """Bars with what the trend strategy reads, and their calendar, written once, as each is read many times."""
    d = written(fe.turnover(fe.atr(fe.averages(fe.returns(m.bars(spark, sf_dir))))), "traded")
    return d, written(fe.calendar(d), "calendar")


#: Prices of this market are high and its volumes low, so a book needs some capital to trade at all.
CAPITAL = 10_000_000.0
RANDOM_RUNS = 200


def events(spark, sf_dir):
    """What happens to two books of the trend strategy: all instruments, and members of the index only."""
    d, cal = traded(spark, sf_dir)
    inst, acts = m.instruments(spark, sf_dir), m.actions(spark, sf_dir)
    rows = simulation.candidates("all", d, inst, cal, acts, rules.TREND, FLOOR / 100)
    rows = rows.unionByName(simulation.candidates("members", d, inst, cal, acts, rules.TREND, FLOOR / 100, m.membership(spark, sf_dir)))
    return simulation.simulate(rows, 0, cal.agg(F.max("session")).first()[0], rules.TREND["risk"], capital=CAPITAL), cal


@query
def portfolio_backtest(spark, sf_dir):
    e, _ = events(spark, sf_dir)
    return r(e, "price", "fee", "pnl", "equity", "cash", "exposure")


@query
def portfolio_metrics(spark, sf_dir):
    e, cal = events(spark, sf_dir)
    e = written(e, "events")
    curve = e.filter("kind = 'equity'").join(cal, "session").select("run_id", "date", "equity")
    trades = metrics.trade_metrics(e.filter("pnl is not null").select("run_id", "pnl"))
    return r(metrics.curve_metrics(curve).join(trades, "run_id", "left"), "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return", "mean_equity", "win_rate", "profit_factor")


@query
def random_null(spark, sf_dir):
    """Measures of RANDOM_RUNS runs that enter at random, forty times each."""
    d, cal = traded(spark, sf_dir)
    i = m.instruments(spark, sf_dir)
    ok = universe.random_entries(d, i, cal, FLOOR / 100)
    curves = simulation.random_runs(d, ok, cal, i, [5, 10, 21, 42, 63], 40, RANDOM_RUNS, 4242, rules.TREND["risk"], capital=CAPITAL)
    return r(metrics.curve_metrics(curves), "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return", "mean_equity")


@query
def walk_forward_run(spark, sf_dir):
    """The trend strategy from the first out-of-sample day to the last one in a single pass, and how many windows that is.

    Without a window the whole span is run, and 0 says that nothing of it is out of sample.
    """
    d, cal = traded(spark, sf_dir)
    days = [x["date"] for x in cal.orderBy("session").select("date").collect()]
    windows = metrics.walk_forward(days)
    first, last = (windows[0][2], windows[-1][3]) if windows else (days[0], days[-1])
    session = {day: k for k, day in enumerate(days)}
    end = max(k for day, k in session.items() if day <= last)
    rows = simulation.candidates("out-of-sample", d, m.instruments(spark, sf_dir), cal, m.actions(spark, sf_dir), rules.TREND, FLOOR / 100)
    e = written(simulation.simulate(rows, session[first], end, rules.TREND["risk"], capital=CAPITAL), "walk-forward")
    curve = e.filter("kind = 'equity'").join(cal, "session").select("run_id", "date", "equity")
    return r(metrics.curve_metrics(curve).withColumn("windows", F.lit(len(windows))), "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return", "mean_equity")
