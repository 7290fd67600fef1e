"""Queries on curves, money, quality, text and books, each with its SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import money, normal, text
from ..operators import features as fe
from ..operators import metrics, quality, snapshots
from ..sources import market as m
from ..storage import scratch, written
from ..tables import Table
from .features import CAL, PANEL, TR, r

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STEPS = "SELECT run_id, date, equity, equity / nullif(lag(equity) OVER (PARTITION BY run_id ORDER BY date), 0) - 1 AS ret, equity / nullif(max(equity) OVER (PARTITION BY run_id ORDER BY date), 0) - 1 AS drawdown FROM curves"
METRICS = """SELECT run_id, n, mean_equity, max_drawdown, total_return, cagr, coalesce(sqrt(ppy) * mean / nullif(dev, 0), 0) AS sharpe, coalesce(sqrt(ppy) * mean / nullif(down, 0), 0) AS sortino,
 CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar FROM (
 SELECT *, n / years AS ppy, l / f - 1 AS total_return, CASE WHEN f > 0 AND l >= 0 THEN power(l / f, 1 / years) - 1 ELSE 0 END AS cagr FROM (
 SELECT run_id, count(*) AS n, date_diff('day', min(date), max(date)) / 365.25 AS years, arg_min(equity, date) AS f, arg_max(equity, date) AS l, avg(equity) AS mean_equity, avg(ret) AS mean, stddev_pop(ret) AS dev, stddev_pop(CASE WHEN ret < 0 THEN ret END) AS down, min(drawdown) AS max_drawdown FROM steps GROUP BY run_id))"""


@query(m.sql("SELECT run_id, round(cagr, 6) AS cagr, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(calmar, 6) AS calmar, round(total_return, 6) AS total_return, n FROM x", "curves", steps=STEPS, x=METRICS))
def equity_metrics(spark, sf_dir):
    d = metrics.curve_metrics(m.curves(spark, sf_dir)).drop("mean_equity")
    return r(d, "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return")


@query(m.sql("SELECT run_id, date, round(ret, 6) AS ret, round(drawdown, 6) AS drawdown FROM steps", "curves", steps=STEPS))
def drawdown_curve(spark, sf_dir):
    return r(metrics.steps(m.curves(spark, sf_dir)), "ret", "drawdown").select("run_id", "date", "ret", "drawdown")


@query(m.sql("SELECT run_id, count(ret) AS n_obs, round(avg(ret) / stddev_pop(ret), 6) AS sharpe_pp, round(skewness(ret), 6) AS skew, round(kurtosis(ret) + 3, 5) AS kurtosis FROM steps GROUP BY run_id", "curves", steps=STEPS))
def return_moments(spark, sf_dir):
    return r(metrics.moments(m.curves(spark, sf_dir)), "sharpe_pp", "skew").withColumn("kurtosis", F.round("kurtosis", 5))


TRIALS = "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS config_hash, value / 1000 AS v FROM events"
OF_RUNS = "SELECT run_id, count(ret) AS n_obs, avg(ret) / stddev_pop(ret) AS sharpe_pp, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurtosis FROM steps GROUP BY run_id"
LATEST = "SELECT count(*) AS n_trials, var_pop(v) AS variance FROM (SELECT v FROM {} QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY id DESC) = 1)"
#: Quantiles at 1 - 1 / n and 1 - 1 / (n e) of the number of trials.
ENDS = "SELECT n_trials, variance, unnest([1, 2]) AS k, 1 - 1 / (n_trials * unnest([1.0::DOUBLE, exp(1.0::DOUBLE)])) AS p FROM latest"
BAR = f"SELECT n_trials, sqrt(variance) * ((1 - {metrics.EULER_GAMMA!r}) * max(q) FILTER (k = 1) + {metrics.EULER_GAMMA!r} * max(q) FILTER (k = 2)) AS sr_star FROM quantiles GROUP BY n_trials, variance"
Z = "SELECT *, (sharpe_pp - sr_star) * sqrt(n_obs - 1) / sqrt(greatest(1 - skew * sharpe_pp + (kurtosis - 1) / 4 * sharpe_pp * sharpe_pp, 1e-12)) AS z FROM of_runs, bar"
DEFLATED = {"steps": STEPS, "of_runs": OF_RUNS}
BARS_OF = {"ends": ENDS, "quantiles": normal.quantile_sql("ends", "p", "q"), "bar": BAR, "z": Z}


def trial_rows(spark, sf_dir):
    """A registry of trials: the event log, each user a configuration."""
    e = m.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("config_hash"), F.to_json(F.struct((F.col("value") / 1000).alias("sharpe_pp"))).alias("metrics"))


@query(m.sql(f"SELECT run_id, n_obs, n_trials, round(variance, 6) AS variance, round(sharpe_pp, 6) AS sharpe_pp, round(skew, 6) AS skew, round(kurtosis, 5) AS kurtosis, round(sr_star, 6) AS sr_star, round({normal.cdf_sql('z')}, 6) AS dsr FROM z, (SELECT variance FROM latest)", "curves", **DEFLATED, trials=TRIALS, latest=LATEST.format("trials"), **BARS_OF))
def deflated_sharpe(spark, sf_dir):
    """The chance that each run's Sharpe ratio is skill, given a registry of trials."""
    d = metrics.deflated_sharpe(m.curves(spark, sf_dir), metrics.trial_stats(trial_rows(spark, sf_dir)))
    return r(d, "dsr", "sr_star", "sharpe_pp", "skew", "variance").withColumn("kurtosis", F.round("kurtosis", 5))


LOG = "SELECT * FROM trials UNION ALL SELECT (SELECT max(id) FROM trials) + row_number() OVER (ORDER BY run_id), CAST(length(run_id) % 3 AS VARCHAR), sharpe_pp FROM of_runs WHERE length(run_id) % 2 = 0"


@query(m.sql(f"SELECT run_id, n_trials, round(sr_star, 6) AS sr_star, round({normal.cdf_sql('z')}, 6) AS dsr FROM z WHERE length(run_id) % 2 = 0", "curves", **DEFLATED, trials=TRIALS, log=LOG, latest=LATEST.format("log"), **BARS_OF))
def validated_runs(spark, sf_dir):
    """Runs out of sample, logged as trials of their configurations and judged by all that were tried; the others, whose names
    have an odd number of letters, are in-sample."""
    c = m.curves(spark, sf_dir)
    runs = c.select("run_id").distinct().select("run_id", (F.length("run_id") % 3).cast("string").alias("config_hash"), ((F.length("run_id") + 1) % 2).alias("walk_forward_windows"))
    d, _ = metrics.validated(c, runs, trial_rows(spark, sf_dir))
    return r(d.select("run_id", "n_trials", "sr_star", "dsr"), "sr_star", "dsr")


@query(f"SELECT event_id, round(z, 8) AS z FROM ({normal.quantile_sql('(SELECT event_id, (event_id % 9999 + 0.5) / 9999::DOUBLE AS p FROM events)', 'p', 'z')})")
def normal_scores(spark, sf_dir):
    """Normal quantiles of numbers that are evenly spread between 0 and 1."""
    e = m.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(normal.quantile((F.col("event_id") % 9999 + 0.5) / 9999), 8).alias("z"))


@query("""WITH t AS (SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, event_id) AS v FROM events GROUP BY user_id)
 SELECT count(*) AS n_trials, round(var_pop(v), 9) AS variance FROM t""")
def trial_stats(spark, sf_dir):
    """Trials: the events' JSON, one configuration for each user, latest by event."""
    e = m.table(spark, sf_dir, "events")
    trials = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("config_hash"), F.to_json(F.struct((F.get_json_object("props", "$.k").cast("double") / 100).alias("sharpe_pp"))).alias("metrics"))
    return r(metrics.trial_stats(trials), "variance", places=9)


@query("SELECT s_suppkey AS id, s_acctbal AS x, round((SELECT (count(*) FILTER (c_acctbal < s_acctbal) + 0.5 * count(*) FILTER (c_acctbal = s_acctbal)) / count(*) FROM customer), 6) AS percentile FROM supplier")
def midrank_percentile(spark, sf_dir):
    """Where suppliers' balances stand among customers'."""
    v = m.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return r(metrics.midrank(v, m.table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("y"))), "percentile")


DELTAS = ["cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return"]


@query(m.sql(f"SELECT b.run_id, {', '.join(f'round(b.{c} - a.{c}, 6) AS d_{c}' for c in DELTAS)}, b.sharpe > a.sharpe AND b.max_drawdown >= a.max_drawdown AS better FROM x b, x a WHERE a.run_id = '1-URGENT' AND b.run_id <> '1-URGENT'", "curves", steps=STEPS, x=METRICS))
def ab_deltas(spark, sf_dir):
    """Every run against the first one; better only with a higher Sharpe ratio and no deeper drawdown."""
    x = metrics.curve_metrics(m.curves(spark, sf_dir))
    a = x.filter("run_id = '1-URGENT'").select(*[F.col(c).alias(f"_{c}") for c in DELTAS])
    d = x.filter("run_id <> '1-URGENT'").join(F.broadcast(a))
    gate = (F.col("sharpe") > F.col("_sharpe")) & (F.col("max_drawdown") >= F.col("_max_drawdown"))
    return d.select("run_id", *[F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"d_{c}") for c in DELTAS], gate.alias("better"))


@query(m.sql("""SELECT CAST(i AS INT) AS window, CAST(start AS DATE) AS in_start, CAST(in_end AS DATE) AS in_end, out_start, CAST(least(stop, z) AS DATE) AS out_end FROM (
 SELECT *, lag(stop) OVER (ORDER BY i) AS before FROM (SELECT k.*, c.date AS out_start, c.date + INTERVAL 6 MONTH AS stop FROM (
 SELECT i, start, start + INTERVAL 24 MONTH AS in_end, z, (SELECT count(*) FROM cal WHERE date < start + INTERVAL 24 MONTH) + 252 AS at FROM (SELECT i, a + to_months(CAST(6 * i AS INT)) AS start, z FROM (SELECT min(date) AS a, max(date) AS z FROM cal), range(40) t(i))) k
 JOIN cal c ON c.session = k.at)) WHERE before IS NULL OR before < z""", "bars", cal=CAL))
def walk_forward_windows(spark, sf_dir):
    days = [x["date"] for x in fe.calendar(m.bars(spark, sf_dir)).orderBy("session").select("date").collect()]
    rows = [(i, *w) for i, w in enumerate(metrics.walk_forward(days))]
    return spark.createDataFrame(rows, "window int, in_start date, in_end date, out_start date, out_end date")


TIER = "CASE WHEN turnover_med_63 >= 20000000 THEN [20.0, 10.0] WHEN turnover_med_63 >= 5000000 THEN [35.0, 15.0] WHEN turnover_med_63 >= 1000000 THEN [60.0, 25.0] WHEN turnover_med_63 >= 250000 THEN [120.0, 40.0] ELSE [250.0, 80.0] END"


@query(m.sql(f"SELECT ticker, date, CAST(t[1] AS DOUBLE) AS spread_bps, CAST(t[2] AS DOUBLE) AS slippage_bps, round(greatest(close * volume * (38e0 * 1e-4), 3e0), 10) AS fee FROM (SELECT p.ticker, p.date, p.close, volume, {TIER} AS t FROM p JOIN bars b ON p.ticker = b.ticker AND p.date = b.date)", "bars", tr=TR, p=PANEL))
def cost_tiers(spark, sf_dir):
    d = fe.turnover(m.bars(spark, sf_dir)).withColumn("t", money.tier_rates(F.col("turnover_med_63")))
    return d.select("ticker", "date", "t.spread_bps", "t.slippage_bps", F.round(money.commission(F.col("close") * F.col("volume")), 10).alias("fee"))


@query(m.sql(f"""SELECT ticker, date, side, qty, round(CASE WHEN qty > 0 THEN px ELSE 0 END, 9) AS price, round(CASE WHEN qty > 0 THEN greatest(px * qty * (38e0 * 1e-4), 3e0) ELSE 0 END, 10) AS fee, round(CASE WHEN qty > 0 THEN cost * qty ELSE 0 END, 10) AS slippage, qty < wanted AS capped FROM (
 SELECT *, CASE WHEN side = 'BUY' THEN open + cost ELSE greatest(open - cost, 0) END AS px FROM (
 SELECT b.ticker, b.date, b.open, CASE WHEN day(b.date) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 1 + day(b.date) % 9 AS wanted, CAST(least(1 + day(b.date) % 9, floor(b.volume * 0.1)) AS BIGINT) AS qty, b.open * (CAST(t[1] AS DOUBLE) * 1e-4) / 2e0 + b.open * (CAST(t[2] AS DOUBLE) * 1e-4) AS cost
 FROM bars b JOIN (SELECT ticker, date, {TIER} AS t FROM p) q ON b.ticker = q.ticker AND b.date = q.date))""", "bars", tr=TR, p=PANEL))
def simulated_fills(spark, sf_dir):
    d = fe.turnover(m.bars(spark, sf_dir))
    side = F.when(F.dayofmonth("date") % 2 == 0, "BUY").otherwise("SELL")
    f = money.fill(side, (1 + F.dayofmonth("date") % 9).cast("long"), F.col("open"), F.col("volume"), F.col("turnover_med_63"))
    out = d.select("ticker", "date", side.alias("side"), *[c.alias(n) for n, c in f.items()])
    return r(out, "price").withColumns({"fee": F.round("fee", 10), "slippage": F.round("slippage", 10)})


@query(m.sql("""SELECT ticker, date, reject, CASE WHEN reject IS NULL THEN qty ELSE 0 END AS qty, round(stop, 6) AS stop FROM (
 SELECT *, CASE WHEN NOT coalesce(close > 0 AND atr > 0, false) THEN 'invalid_price_or_atr' WHEN open_n >= 8 THEN 'max_open_positions' WHEN close - stop <= 0 THEN 'non_positive_stop_distance' WHEN budget <= 0 THEN 'risk_budget_too_small' WHEN qty <= 0 THEN 'exposure_or_cash_limit' END AS reject FROM (
 SELECT *, CAST(greatest(least(budget, floor(20000 / close), floor((40000 - used) / close), floor(greatest(cash, 0) / close)), 0) AS BIGINT) AS qty FROM (
 SELECT ticker, date, close, atr, greatest(close - 2.5 * atr, 0) AS stop, floor(1000.0 / nullif(close - greatest(close - 2.5 * atr, 0), 0)) AS budget, day(date) % 10 AS open_n, CAST(month(date) * 3000 AS DOUBLE) AS used, CAST(day(date) * 1000 AS DOUBLE) AS cash FROM p)))""", "bars", tr=TR, p=PANEL))
def position_sizing(spark, sf_dir):
    """Sizes at every close for a book of 100,000 whose state follows the date."""
    from ..operators.rules import TREND

    d = fe.atr(m.bars(spark, sf_dir))
    full = F.lit(100000.0)
    s = money.size(F.col("close"), F.col("atr"), full, full, F.dayofmonth("date") * 1000.0, F.dayofmonth("date") % 10, F.lit(0.0), F.month("date") * 3000.0, F.lit(0.0), TREND["risk"])
    return d.select("ticker", "date", s["reject"].alias("reject"), F.coalesce(s["qty"], F.lit(0)).alias("qty"), F.round(s["stop"], 6).alias("stop"))


@query(m.sql("SELECT ticker, date FROM bars WHERE volume IS NULL OR volume <= 5", "bars"))
def dq_bad_volume(spark, sf_dir):
    return quality.bad_volume(m.bars(spark, sf_dir).withColumn("volume", F.col("volume") - 5))


@query(m.sql("""SELECT ticker, date, round(close / (prev * f) - 1, 6) AS move FROM (
 SELECT b.ticker, b.date, b.close, last_value(nullif(b.close, 0) IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bars b) x
 JOIN LATERAL (SELECT coalesce((SELECT CASE action_type WHEN 'split' THEN 1 / value_or_ratio WHEN 'rights_issue' THEN value_or_ratio ELSE CASE WHEN prev > 0 THEN greatest((prev - value_or_ratio) / prev, 0) ELSE 1 END END FROM actions a WHERE a.ticker = x.ticker AND (SELECT min(date) FROM cal WHERE date >= ex_date) = x.date), 1) AS f) y ON true
 WHERE abs(close / (prev * f) - 1) > 0.25""", "bars", "actions", cal=CAL))
def dq_jumps(spark, sf_dir):
    b = m.bars(spark, sf_dir)
    return r(quality.jumps(b, quality.action_factors(m.actions(spark, sf_dir), fe.calendar(b), b)), "move")


@query(m.sql("SELECT ticker, last_date, (SELECT max(session) FROM cal) - session AS behind FROM (SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker) l JOIN cal ON last_date = cal.date WHERE (SELECT max(session) FROM cal) - session > 1", "bars", cal=CAL))
def dq_stale(spark, sf_dir):
    b = m.bars(spark, sf_dir)
    return quality.stale(b, fe.calendar(b), 1)


@query("SELECT source, count(*) AS n, round(count(*) FILTER (length(coalesce(text, '')) < 500) / CAST(count(*) AS DOUBLE), 6) AS short_ratio FROM documents GROUP BY source HAVING count(*) >= 10")
def dq_short_text(spark, sf_dir):
    return r(quality.short_bodies(m.filings(spark, sf_dir), 500), "short_ratio")


JUMPS = """SELECT ticker, date FROM (SELECT b.ticker, b.date, b.close, last_value(nullif(b.close, 0) IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bars b) x
 JOIN LATERAL (SELECT coalesce((SELECT CASE action_type WHEN 'split' THEN 1 / value_or_ratio WHEN 'rights_issue' THEN value_or_ratio ELSE CASE WHEN prev > 0 THEN greatest((prev - value_or_ratio) / prev, 0) ELSE 1 END END FROM actions a WHERE a.ticker = x.ticker AND (SELECT min(date) FROM cal WHERE date >= ex_date) = x.date), 1) AS f) y ON true
 WHERE abs(close / (prev * f) - 1) > 0.25"""
LATE = "SELECT ticker || ' ' || last_date || ' ' || ((SELECT max(session) FROM cal) - session) AS x FROM (SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker) l JOIN cal ON last_date = cal.date WHERE (SELECT max(session) FROM cal) - session > 5"
GAPS = "SELECT s.ticker || ' ' || cal.date AS x FROM (SELECT ticker, min(date) AS a, max(date) AS z FROM bars GROUP BY ticker) s JOIN cal ON cal.date BETWEEN a AND z WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = s.ticker AND b.date = cal.date)"


@query(m.sql("""SELECT category, n, array_to_string(few, ', ') || CASE WHEN n > len(few) THEN ' (+' || (n - len(few)) || ' more)' ELSE '' END AS examples FROM (SELECT category, count(*) AS n, list_sort(list(DISTINCT x))[1:3] AS few FROM (
 SELECT 'missing_session' AS category, x FROM gaps UNION ALL SELECT 'bad_volume', ticker || ' ' || date FROM bars WHERE volume IS NULL OR volume <= 0 UNION ALL SELECT 'jump', ticker || ' ' || date FROM jumps UNION ALL SELECT 'stale', x FROM late) GROUP BY category)""", "bars", "actions", cal=CAL, jumps=JUMPS, late=LATE, gaps=GAPS))
def dq_report(spark, sf_dir):
    """Counts of all bar checks by category, with examples."""
    b = m.bars(spark, sf_dir)
    s = fe.calendar(b)
    found = {"missing_session": quality.missing_sessions(b, s), "bad_volume": quality.bad_volume(b), "jump": quality.jumps(b, quality.action_factors(m.actions(spark, sf_dir), s, b)).select("ticker", "date"), "stale": quality.stale(b, s)}
    return quality.summary(quality.report(found))


@query(m.sql("SELECT max(date) AS date FROM (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) >= 20)", "bars"))
def full_market_session(spark, sf_dir):
    d = m.bars(spark, sf_dir).groupBy("date").agg(F.count_distinct("ticker").alias("n")).filter("n >= 20")
    return d.agg(F.max("date").alias("date"))


@query(m.sql("SELECT ticker, max(date) AS last_date, count(*) AS n, count(*) FILTER (volume > 30) AS n_heavy FROM bars GROUP BY ticker", "bars"))
def price_freshness(spark, sf_dir):
    return m.bars(spark, sf_dir).groupBy("ticker").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("volume") > 30).alias("n_heavy"))


@query("SELECT date_trunc('month', ts)::DATE AS month, count(*) AS calls, round(coalesce(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0) / 1e6, 9) AS usd FROM events GROUP BY 1")
def month_spend(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum(k), F.lit(0.0)) / 1e6, 9).alias("usd"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def strip_html_pages(spark, sf_dir):
    return m.table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query("SELECT doc_id, sha256(coalesce(source, '') || chr(0) || coalesce(text, '') || chr(0)) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return m.table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query("SELECT min(doc_id) AS filing_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup_earliest(spark, sf_dir):
    """Of filings with equal content the earliest, and how many there are."""
    return m.filings(spark, sf_dir).groupBy("content_hash").agg(F.min("filing_id").alias("filing_id"), F.count(F.lit(1)).alias("copies"))


TITLES = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN c_name || ' S.A. (EBI) : raport' WHEN 1 THEN c_name || ' sp. z o.o., S.A.: report ' WHEN 2 THEN ' ' || o_orderpriority ELSE c_name || ' ASA (' END || CASE WHEN o_orderkey % 3 = 0 THEN ' nr ' || (o_orderkey % 90 + 1) || ' / 2024' ELSE '' END AS title,
 'ESPI ' || o_clerk || CASE WHEN o_orderkey % 5 < 2 THEN ' PL' || lpad(CAST(o_custkey AS VARCHAR), 10, 'X') ELSE ' none' END AS body FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(f"""WITH t AS ({TITLES.replace("o_clerk", "o_orderpriority")})
 SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN regexp_extract(body, 'PL[A-Z0-9]{{10}}') END AS isin, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90 + 1) || '/2024' END AS report_no,
 CASE WHEN o_orderkey % 4 <> 2 THEN regexp_extract(title, '^(Customer#[0-9]+)') || CASE WHEN o_orderkey % 4 = 3 THEN ' ASA' ELSE '' END END AS issuer, CASE WHEN o_orderkey % 2 = 0 THEN 'ESPI' WHEN o_orderkey % 4 = 0 THEN 'EBI' WHEN contains(title, 'EBI') THEN 'EBI' ELSE 'OTHER' END AS channel FROM t""")
def extract_ids(spark, sf_dir):
    """ISIN, report number, issuer and system of titles and texts that name them in several ways, or not at all."""
    key, c = F.col("o_orderkey"), F.col("c_name")
    o = m.table(spark, sf_dir, "orders").join(m.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = key % 4
    head = F.when(k == 0, F.concat(c, F.lit(" S.A. (EBI) : raport"))).when(k == 1, F.concat(c, F.lit(" sp. z o.o., S.A.: report "))).when(k == 2, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.concat(c, F.lit(" ASA (")))
    title = F.concat(head, F.when(key % 3 == 0, F.concat(F.lit(" nr "), (key % 90 + 1).cast("string"), F.lit(" / 2024"))).otherwise(""))
    body = F.concat(F.lit("ESPI "), "o_orderpriority", F.when(key % 5 < 2, F.concat(F.lit(" PL"), F.lpad(F.col("o_custkey").cast("string"), 10, "X"))).otherwise(" none"))
    d = o.select("o_orderkey", title.alias("title"), body.alias("body"))
    t, b = F.col("title"), F.col("body")
    system = F.when(key % 2 == 0, text.channel(F.lit("OTHER"), t, b)).otherwise(text.channel(F.lit("OTHER"), t))
    return d.select("o_orderkey", text.isin(t, b).alias("isin"), text.report_number(t, b).alias("report_no"), text.issuer(t).alias("issuer"), system.alias("channel"))


CHECKED = "SELECT ticker, delisted_on, instrument_id FROM instruments UNION ALL SELECT 'new ' || instrument_id, NULL, 0 FROM instruments WHERE instrument_id % 10 = 1"
QUOTED = "SELECT row_number() OVER (ORDER BY date) - 1 AS session, date FROM mkt_index WHERE date <= DATE '1998-08-31'"
CUT = "SELECT b.* FROM bars b JOIN instruments i USING (ticker) WHERE instrument_id % 6 > 0 OR date < DATE '1998-07-01'"


@query(m.sql("""SELECT 'no_data' AS category, ticker, '' AS detail FROM u WHERE ticker NOT IN (SELECT ticker FROM bars) UNION ALL
 SELECT 'stale_benchmark', 'WIG', (SELECT max(date) FROM q) || ' ' || (SELECT max(date) FROM c) UNION ALL
 SELECT 'stale_ticker', ticker, last || ' ' || behind FROM (SELECT ticker, last, (SELECT count(*) FROM q WHERE date > last) AS behind FROM (SELECT ticker, max(date) AS last FROM c GROUP BY ticker) JOIN u USING (ticker) WHERE delisted_on IS NULL OR delisted_on > (SELECT max(date) FROM q)) WHERE behind > 5 UNION ALL
 SELECT 'bad_volume', ticker, CAST(date AS VARCHAR) FROM c WHERE volume IS NULL OR volume <= 0""", "bars", "instruments", "mkt_index", u=CHECKED, q=QUOTED, c=CUT))
def price_checks(spark, sf_dir):
    """Entries without bars, names that stopped (a sixth), and an index that ends before they do, by the index' calendar."""
    i = m.instruments(spark, sf_dir)
    u = i.select("ticker", "delisted_on").unionByName(i.filter("instrument_id % 10 = 1").select(F.concat(F.lit("new "), F.col("instrument_id").cast("string")).alias("ticker"), F.lit(None).cast("date").alias("delisted_on")))
    b = written(m.bars(spark, sf_dir).join(i.select("ticker", "instrument_id"), "ticker").filter("instrument_id % 6 > 0 or date < date '1998-07-01'").drop("instrument_id"), "bars")
    index = written(m.index_bars(spark, sf_dir).filter("date <= date '1998-08-31'"), "index")
    return quality.price_checks(b, u, index, "WIG", m.actions(spark, sf_dir)).filter("category not in ('missing_session', 'unexplained_jump')")


FEEDS = "SELECT * FROM (VALUES ('click', true, 100.0::DOUBLE), ('view', true, NULL), ('purchase', false, NULL), ('never', true, NULL), ('signup', true, 1.0::DOUBLE)) v(name, enabled, max_hours)"
NOW = "TIMESTAMP '2024-02-02 12:00:00'"
HOURS = "(SELECT sum(greatest(least(epoch(" + NOW + "), epoch(d) + 86400) - greatest(epoch(newest), epoch(d)), 0)) / 3600 FROM generate_series(date_trunc('day', newest), " + NOW + ", INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5)"


@query(m.sql(f"""SELECT 'filings_silent' AS category, 'collector' AS source, round({HOURS}, 6) AS value FROM (SELECT max(seen) AS newest FROM f) WHERE {HOURS} > 12 UNION ALL
 SELECT 'feed_silent', name, round({HOURS}, 6) FROM (SELECT name, coalesce(max_hours, 48) AS most, max(seen) AS newest FROM feeds LEFT JOIN f ON name = source WHERE enabled GROUP BY ALL) WHERE newest IS NULL OR {HOURS} > most UNION ALL
 SELECT 'filings_low_volume', 'collector', count(*) FROM f WHERE seen >= {NOW} - INTERVAL 3 DAY HAVING count(*) < 10000000 UNION ALL
 SELECT 'filings_missing_text', name, round(count(*) FILTER (k < 100) / count(*), 6) FROM feeds JOIN f ON name = source WHERE enabled AND mapped AND seen >= {NOW} - INTERVAL 7 DAY GROUP BY name HAVING count(*) >= 3 AND count(*) FILTER (k < 100) > 0.05 * count(*)""",
 feeds=FEEDS, f="SELECT event_type AS source, date_trunc('second', ts) AS seen, user_id % 4 > 0 AS mapped, CAST(value AS BIGINT) AS k FROM events"))
def filings_checks(spark, sf_dir):
    """Events as filings of feeds, of which one is off and one never gave anything, three days after the log's end."""
    e = m.table(spark, sf_dir, "events")
    body = F.repeat(F.lit("x"), F.round("value").cast("int"))
    f = e.select(F.col("event_type").alias("source"), F.date_trunc("second", "ts").cast("timestamp").alias("published_at"), F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("instrument_id"), body.alias("full_text"))
    feeds = spark.createDataFrame([("click", True, 100.0), ("view", True, None), ("purchase", False, None), ("never", True, None), ("signup", True, 1.0)], "name string, enabled boolean, max_hours double")
    return r(quality.filings_checks(f, feeds, F.lit("2024-02-02 12:00:00").cast("timestamp"), least=10_000_000, chars=100, ratio=0.05), "value")


@query(m.sql("SELECT instrument_id, count(*) AS n, min(filing_id) AS first_id FROM filings WHERE filing_id NOT IN (SELECT doc_id FROM labels) GROUP BY instrument_id", "filings"))
def discovery_backlog(spark, sf_dir):
    """Filings not processed yet (those without a label), by instrument; those without one are counted together."""
    done = m.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filing_id"))
    return m.filings(spark, sf_dir).join(done, "filing_id", "left_anti").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.min("filing_id").alias("first_id"))


PAIRS = "SELECT CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS truth, CASE WHEN n_chars > 500 THEN 'relevant' ELSE 'irrelevant' END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@query(f"WITH pairs AS ({PAIRS}), c AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS np, count(*) FILTER (truth = label) AS nt FROM pairs, (VALUES ('relevant'), ('irrelevant'), ('uncertain')) v(label) GROUP BY label) SELECT label, round(coalesce(tp / nullif(CAST(np AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(nt AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(np + nt, 0), 0), 6) AS f1 FROM c")
def per_class_f1(spark, sf_dir):
    d = m.table(spark, sf_dir, "labels").join(m.table(spark, sf_dir, "documents"), "doc_id")
    pick = lambda c: F.when(c, "relevant").otherwise("irrelevant")
    return r(metrics.per_class(d.select(pick(F.col("quality") == 1).alias("truth"), pick(F.col("n_chars") > 500).alias("pred")), ["relevant", "irrelevant", "uncertain"]), "precision", "recall", "f1")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN -1.0 WHEN 'purchase' THEN 0.0 END * CASE WHEN value > 100 THEN 1 ELSE value / 100 END AS score FROM events")
def verdict_score(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "click", "bullish").when(F.col("event_type") == "view", "bearish").when(F.col("event_type") == "purchase", "neutral")
    return e.select("event_id", text.verdict_score(verdict, F.col("value") / 100).alias("score"))


@query("""WITH last AS (SELECT o_orderpriority AS run_id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, count(*) FILTER (o_orderstatus = 'O') AS open_n, count(*) FILTER (o_orderstatus = 'F') AS closed_n FROM orders GROUP BY 1)
 SELECT * FROM last""")
def book_overview(spark, sf_dir):
    o = m.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"), F.count_if(F.col("o_orderstatus") == "O").alias("open_n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed_n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_trades(spark, sf_dir):
    """The twenty newest orders, a report of fixed length."""
    return m.table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_custkey", "o_totalprice")


@query(m.sql("SELECT ticker, epoch_us(bar_start) // 1000000 AS bar_start_s, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume FROM intraday", "intraday"))
def intraday_bars(spark, sf_dir):
    return r(m.intraday(spark, sf_dir).withColumn("bar_start_s", F.unix_seconds("bar_start")).drop("bar_start"), "open", "high", "low", "close")


KEEP = """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS n, row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS k, dense_rank() OVER (ORDER BY date_trunc('month', day) DESC) AS mth FROM days)
 SELECT day FROM a WHERE n <= 14 OR (k = 1 AND mth <= 12)"""


@query(KEEP)
def retention_keep(spark, sf_dir):
    """The fourteen newest snapshots and the first of each of the twelve newest months: one row for each day there was one."""
    return snapshots.kept(m.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))


@query("""SELECT 'customer' AS "table", count(*) AS rows_then, count(*) AS rows_now, 'lacks c_name' AS wrong FROM customer
 UNION ALL SELECT 'events', 2 * count(*), count(*), 'more rows than now' FROM events UNION ALL SELECT 'nation', NULL, count(*), 'not in the snapshot' FROM nation
 UNION ALL SELECT 'old', count(*), NULL, 'not known' FROM region UNION ALL SELECT 'orders', count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01'), count(*), NULL FROM orders""")
def restore_check(spark, sf_dir):
    """A snapshot of stored tables against what is there now: one lost a column, one has too many rows, one is missing, one is
    unknown, and the orders have only grown."""
    at = lambda name: m.table(spark, sf_dir, name)
    tables = {n: Table(spark, scratch(spark, f"live-{n}"), k, buckets=4) for n, k in {"orders": ["o_orderkey"], "old": ["r_regionkey"], "customer": ["c_custkey"], "events": ["copy", "event_id"]}.items()}
    tables["orders"].overwrite(at("orders").filter("o_orderdate < timestamp '1998-01-01'"))
    tables["old"].overwrite(at("region"))
    tables["customer"].overwrite(at("customer").drop("c_name"))
    tables["events"].overwrite(at("events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    log = snapshots.log_table(spark, scratch(spark, "snapshots"))
    snapshots.take(log, tables, F.lit("2024-01-01").cast("timestamp"))
    tables["orders"].upsert(at("orders"))
    then = snapshots.restore(log, tables, F.lit("2024-02-01").cast("timestamp"))
    now = {"orders": tables["orders"].read()} | {n: at(n) for n in ("customer", "nation")} | {"events": at("events").withColumn("copy", F.lit(1))}
    return snapshots.compared(snapshots.described(then), snapshots.described(now))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 1 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 1")
def upsert_by_key(spark, sf_dir):
    """Updates of a stored table replace rows of equal key and add the others; written twice, they are there once."""
    c = m.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    base = c.filter("c_custkey % 5 <> 1")
    changed = base.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0))
    added = c.filter("c_custkey % 5 = 1").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    t = Table(spark, scratch(spark, "customers"), ["c_custkey"])
    t.upsert(base)
    for _ in range(2):
        t.upsert(changed.unionByName(added))
    return t.read()


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 4 <> 0 GROUP BY o_custkey")
def insert_first(spark, sf_dir):
    """Of orders the first of each customer that isn't stored yet (a quarter is)."""
    o = m.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    t = Table(spark, scratch(spark, "firsts"), ["o_custkey"])
    t.insert_first(o.filter("o_custkey % 4 = 0").withColumn("o_orderkey", F.lit(-1).cast(o.schema["o_orderkey"].dataType)), F.col("o_orderkey"))
    t.insert_first(o, F.col("o_orderkey"))
    return t.read().filter("o_orderkey >= 0")


@query("""SELECT source, CAST(epoch(newest) AS BIGINT) AS newest_s, round(hours, 6) AS hours FROM (SELECT source, newest, (SELECT sum(greatest(least(epoch(TIMESTAMP '2024-01-31 12:00:00'), epoch(d) + 86400) - greatest(epoch(newest), epoch(d)), 0)) / 3600 FROM generate_series(date_trunc('day', newest), TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5) AS hours
 FROM (SELECT event_type AS source, date_trunc('second', max(ts)) AS newest FROM events WHERE ts < '2024-01-29' GROUP BY 1)) WHERE hours > CASE source WHEN 'click' THEN 100 ELSE 24 END""")
def filing_silence(spark, sf_dir):
    """Event types whose newest event before the 29th of January lies more business hours back than allowed two days later."""
    e = m.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.date_trunc("second", "ts").cast("timestamp").alias("published_at"))
    d = quality.silence(e.filter("published_at < '2024-01-29'"), F.lit("2024-01-31 12:00:00").cast("timestamp"), {"click": 100.0})
    return d.select("source", F.unix_seconds("newest").alias("newest_s"), F.round("hours", 6).alias("hours"))
