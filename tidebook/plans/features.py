"""Queries on bars, features, rules and the universe, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import rules, universe
from ..sources import market as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Columns of prices, which are ratios of short decimals and so are rounded where no tie is.
PRICES = ("open", "high", "low", "close", "prev_close", "price")


def r(d: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return d.withColumns({c: F.round(c, 9 if c in PRICES else places) for c in columns})


W = "PARTITION BY ticker ORDER BY date"
RET = lambda k: f"close / nullif(lag(close, {k}) OVER ({W}), 0) - 1"
FULL = lambda agg, x, n: f"CASE WHEN count({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {agg} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
SMA = lambda n: FULL("avg(close)", "close", n)
TR = f"SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr, {RET(1)} AS r1, close * volume AS v FROM bars"
PANEL = f"""SELECT ticker, date, close, {RET(21)} AS ret_1m, {RET(63)} AS ret_3m, {RET(126)} AS ret_6m, {RET(252)} AS ret_12m, {RET(126)} AS momentum_6m,
 {SMA(50)} AS sma50, {SMA(200)} AS sma200, close / nullif({SMA(50)}, 0) - 1 AS close_vs_sma50, close / nullif({SMA(200)}, 0) - 1 AS close_vs_sma200,
 {FULL('avg(tr)', 'tr', 14)} AS atr, {FULL('stddev_samp(r1)', 'r1', 21)} * sqrt(252.0) AS realized_vol, {FULL('median(v)', 'v', 63)} AS turnover_med_63 FROM tr"""
INDEXED = f"SELECT bars.*, last_value(i.close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY bars.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ix FROM bars LEFT JOIN mkt_index i ON bars.date = i.date"
STRENGTH = f"SELECT ticker, date, {RET(126)} - (ix / nullif(lag(ix, 126) OVER ({W}), 0) - 1) AS rel_strength_6m FROM ix"


@query(m.sql("SELECT ticker, date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume FROM bars", "bars"))
def bars(spark, sf_dir):
    return r(m.bars(spark, sf_dir), "open", "high", "low", "close")


FEATURES = ["ret_1m", "ret_3m", "ret_6m", "ret_12m", "momentum_6m", "sma50", "sma200", "close_vs_sma50", "close_vs_sma200", "atr", "realized_vol"]


@query(m.sql(f"SELECT p.ticker, p.date, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)}, round(turnover_med_63, 3) AS turnover_med_63, round(rel_strength_6m, 6) AS rel_strength_6m FROM p JOIN s ON p.ticker = s.ticker AND p.date = s.date", "bars", "mkt_index", tr=TR, p=PANEL, ix=INDEXED, s=STRENGTH))
def feature_panel(spark, sf_dir):
    d = fe.panel(m.bars(spark, sf_dir), m.index_bars(spark, sf_dir))
    return r(d, *FEATURES, "rel_strength_6m").withColumn("turnover_med_63", F.round("turnover_med_63", 3)).select("ticker", "date", *FEATURES, "turnover_med_63", "rel_strength_6m")


@query(m.sql(f"SELECT ticker, date, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES[:5])} FROM p", "bars", tr=TR, p=PANEL))
def returns_multi_horizon(spark, sf_dir):
    return r(fe.returns(m.bars(spark, sf_dir)), *FEATURES[:5]).select("ticker", "date", *FEATURES[:5])


@query(m.sql(f"SELECT ticker, date, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES[5:9])} FROM p", "bars", tr=TR, p=PANEL))
def sma_distance(spark, sf_dir):
    return r(fe.averages(m.bars(spark, sf_dir)), *FEATURES[5:9]).select("ticker", "date", *FEATURES[5:9])


@query(m.sql("SELECT ticker, date, round(atr, 6) AS atr FROM p", "bars", tr=TR, p=PANEL))
def atr_14(spark, sf_dir):
    return r(fe.atr(m.bars(spark, sf_dir)), "atr").select("ticker", "date", "atr")


@query(m.sql("SELECT ticker, date, round(realized_vol, 6) AS realized_vol FROM p", "bars", tr=TR, p=PANEL))
def realized_vol_21(spark, sf_dir):
    return r(fe.volatility(m.bars(spark, sf_dir)), "realized_vol").select("ticker", "date", "realized_vol")


@query(m.sql("SELECT ticker, date, round(turnover_med_63, 3) AS turnover_med_63 FROM p", "bars", tr=TR, p=PANEL))
def turnover_median_63(spark, sf_dir):
    return r(fe.turnover(m.bars(spark, sf_dir)), "turnover_med_63", places=3).select("ticker", "date", "turnover_med_63")


@query(m.sql("SELECT ticker, date, round(rel_strength_6m, 6) AS rel_strength_6m FROM s", "bars", "mkt_index", ix=INDEXED, s=STRENGTH))
def rel_strength_6m(spark, sf_dir):
    d = fe.relative_strength(fe.returns(m.bars(spark, sf_dir)), m.index_bars(spark, sf_dir))
    return r(d, "rel_strength_6m").select("ticker", "date", "rel_strength_6m")


CAL = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date FROM bars)"


@query(m.sql("SELECT date, session FROM cal", "bars", cal=CAL))
def trading_calendar(spark, sf_dir):
    return fe.calendar(m.bars(spark, sf_dir))


@query(m.sql(f"SELECT ticker, date, round(last_value(nullif(close, 0) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS prev_close FROM bars", "bars"))
def prev_valid_close(spark, sf_dir):
    return r(fe.previous_valid_close(m.bars(spark, sf_dir)), "prev_close").select("ticker", "date", "prev_close")


ENTER = "coalesce(close_vs_sma200 > 0, false) AND coalesce(momentum_6m > 0, false)"


@query(m.sql(f"SELECT ticker, date, CASE WHEN {ENTER} THEN 'ENTER' ELSE 'HOLD' END AS flat, CASE WHEN coalesce(close_vs_sma200 < 0, false) THEN 'EXIT' ELSE 'HOLD' END AS held, round(close_vs_sma200, 6) AS close_vs_sma200, round(momentum_6m, 6) AS momentum_6m, round(atr, 6) AS atr, round(turnover_med_63, 3) AS turnover_med_63 FROM p", "bars", tr=TR, p=PANEL))
def signals_flat(spark, sf_dir):
    """What the trend strategy says of every bar, without a position and with one (whose stop isn't known here)."""
    d = fe.turnover(fe.atr(fe.averages(fe.returns(m.bars(spark, sf_dir)))))
    d = d.withColumns({"flat": rules.signal(rules.TREND, F.lit(False)), "held": rules.signal(rules.TREND, F.lit(True))})
    d = r(d, "close_vs_sma200", "momentum_6m", "atr").withColumn("turnover_med_63", F.round("turnover_med_63", 3))
    return d.select("ticker", "date", "flat", "held", "close_vs_sma200", "momentum_6m", "atr", "turnover_med_63")


FLOOR = 600_000.0


@query(m.sql(f"SELECT ticker, date, coalesce(turnover_med_63 >= {FLOOR}, false) AS may_enter FROM p", "bars", tr=TR, p=PANEL))
def liquidity_gate(spark, sf_dir):
    d = fe.turnover(m.bars(spark, sf_dir))
    return d.select("ticker", "date", universe.entry_gate(FLOOR, F.lit(True)).alias("may_enter"))


@query(m.sql("SELECT b.ticker, b.date, coalesce(b.date <= delisted_on, true) AS alive FROM bars b JOIN instruments i ON b.ticker = i.ticker", "bars", "instruments"))
def alive_filter(spark, sf_dir):
    d = m.bars(spark, sf_dir).join(m.instruments(spark, sf_dir), "ticker")
    return d.select("ticker", "date", universe.alive().alias("alive"))


@query(m.sql(f"SELECT p.ticker, p.date, session, coalesce(p.date <= delisted_on, true) AND coalesce(lead(session) OVER (PARTITION BY p.ticker ORDER BY session) = session + 1, false) AND coalesce(atr > 0, false) AND coalesce(turnover_med_63 >= {FLOOR}, false) AS ok FROM p JOIN cal ON p.date = cal.date JOIN instruments i ON p.ticker = i.ticker", "bars", "instruments", tr=TR, p=PANEL, cal=CAL))
def mc_eligibility(spark, sf_dir):
    b = m.bars(spark, sf_dir)
    return universe.random_entries(fe.turnover(fe.atr(b)), m.instruments(spark, sf_dir), fe.calendar(b), FLOOR)


@query(m.sql("""SELECT b.ticker, b.date FROM bars b WHERE EXISTS (SELECT 1 FROM membership g WHERE g.ticker = b.ticker AND b.date >= g.date_from AND (g.date_to IS NULL OR b.date <= g.date_to))""", "bars", "membership"))
def membership_on_date(spark, sf_dir):
    return universe.members(m.bars(spark, sf_dir), m.membership(spark, sf_dir)).select("ticker", "date")


@query(m.sql("""SELECT d.date, a.active, d.present, round(CAST(d.present AS DOUBLE) / a.active, 6) AS coverage FROM
 (SELECT date, count(DISTINCT ticker) AS present FROM bars GROUP BY date) d JOIN cal ON d.date = cal.date
 JOIN (SELECT session, count(*) AS active FROM (SELECT DISTINCT ticker, unnest(range(session, session + 15)) AS session FROM bars JOIN cal ON bars.date = cal.date) GROUP BY session) a ON cal.session = a.session""", "bars", cal=CAL))
def session_coverage(spark, sf_dir):
    b = m.bars(spark, sf_dir)
    return r(universe.coverage(b, fe.calendar(b)), "coverage")


@query("""WITH f AS (SELECT source AS ticker, min(doc_id) AS first_at FROM documents GROUP BY source),
 o AS (SELECT ticker, first_at FROM f WHERE ticker NOT IN ('src1', 'src2') ORDER BY first_at, ticker LIMIT 5)
 SELECT ticker, first_at FROM f WHERE ticker IN ('src1', 'src2') UNION ALL SELECT * FROM o""")
def new_instrument_cap(spark, sf_dir):
    """Curated sources and the first five others, by first appearance."""
    found = m.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("ticker")).agg(F.min("doc_id").alias("first_at"))
    return universe.first_new(found, found.filter(F.col("ticker").isin("src1", "src2")), 5).select("ticker", "first_at")


@query(m.sql("SELECT p.ticker, p.date, CASE WHEN " + ENTER + " AND coalesce(f.score > 0, false) THEN 'ENTER' ELSE 'HOLD' END AS gated, CASE WHEN " + ENTER + " THEN 'ENTER' ELSE 'HOLD' END AS plain FROM p LEFT JOIN LATERAL (SELECT score FROM s WHERE s.ticker = p.ticker AND s.known <= p.date ORDER BY known DESC LIMIT 1) f ON true", "bars", "fundamentals", tr=TR, p=PANEL, s="SELECT ticker, as_of_date AS known, pe - 20 AS score FROM fundamentals"))
def signals_llm_gate(spark, sf_dir):
    """Signals of a strategy that also asks for a score known by then, and of the same without that condition."""
    from ..operators.asof import asof

    gated = rules.TREND | {"entry": {"all": [*rules.TREND["entry"]["all"], {"feature": "llm_score", "op": "gt", "value": 0.0}]}}
    plain = rules.without_model_features(gated)
    scores = m.fundamentals(spark, sf_dir).select("ticker", F.col("as_of_date").alias("known"), (F.col("pe") - 20).alias("llm_score"))
    d = asof(fe.averages(fe.returns(m.bars(spark, sf_dir))), scores, "ticker", "date", "known", ["llm_score"])
    return d.select("ticker", "date", rules.signal(gated, F.lit(False)).alias("gated"), rules.signal(plain, F.lit(False)).alias("plain"))


@query(m.sql(f"SELECT ticker, date, round(close, 9) AS close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) WHERE n <= 40", "bars"))
def sparkline_tail(spark, sf_dir):
    """The last forty closes of each instrument."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    d = m.bars(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 40")
    return r(d, "close").select("ticker", "date", "close")
