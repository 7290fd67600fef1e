"""Queries on books, loads, gates and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import collect, desk, gates, load, metrics, records, rules, stored, universe
from ..operators import features as fe
from ..operators.asof import asof
from ..sources import market as m
from ..storage import scratch, written
from ..tables import Table
from .books import METRICS, STEPS
from .features import ENTER, PANEL, TR, r
from .joins import FACTOR, PRIOR

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CURVE = "SELECT run_id AS user_id, date, equity, 0.5 AS exposure FROM curves"
LAST = "SELECT instrument_id, arg_max(close, date) AS last_close FROM bars JOIN instruments USING (ticker) GROUP BY instrument_id"
COUNTS = "SELECT u.user_id, coalesce(n_open, 0) AS n_open, coalesce(n_pending, 0) AS n_pending, coalesce(n_unsent, 0) AS n_unsent FROM (SELECT user_id FROM positions UNION SELECT user_id FROM paper_orders) u LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'OPEN') AS n_open FROM positions GROUP BY 1) p ON u.user_id = p.user_id LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'PENDING') AS n_pending, count(*) FILTER (NOT signal_sent OR (NOT fill_sent AND status IN ('FILLED', 'PARTIAL', 'LAPSED'))) AS n_unsent FROM paper_orders GROUP BY 1) o ON u.user_id = o.user_id"
CHANGE = "SELECT user_id, equity - before AS delta, equity / before - 1 AS delta_pct FROM (SELECT e.user_id, equity, date, nullif(CASE WHEN count(*) OVER (PARTITION BY e.user_id) >= 2 THEN lag(equity) OVER (PARTITION BY e.user_id ORDER BY date) ELSE initial_capital END, 0) AS before FROM curve e LEFT JOIN paper_state s ON e.user_id = s.user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) = 1"


def equity(spark, sf_dir):
    return m.curves(spark, sf_dir).select(F.col("run_id").alias("user_id"), "date", "equity", F.lit(0.5).alias("exposure"))


def last_closes(spark, sf_dir):
    last = m.bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"))
    return last.join(m.instruments(spark, sf_dir), "ticker").select("instrument_id", "last_close")


def open_rows(spark, sf_dir):
    return desk.open_positions(m.positions(spark, sf_dir), m.instruments(spark, sf_dir), last_closes(spark, sf_dir), equity(spark, sf_dir))


@query(m.sql("SELECT s.user_id, cash, e.equity, e.exposure, n_open, n_pending, n_unsent, strategy_name, round(delta, 6) AS delta, round(delta_pct, 8) AS delta_pct, round(e.equity / 100000 - 1, 8) AS total_return FROM paper_state s LEFT JOIN (SELECT user_id, arg_max(equity, date) AS equity, arg_max(exposure, date) AS exposure FROM curve GROUP BY 1) e ON s.user_id = e.user_id LEFT JOIN n ON s.user_id = n.user_id LEFT JOIN (SELECT * FROM (VALUES (0, 'trend'), (1, 'value')) v(id, strategy_name)) st ON s.strategy_id = st.id LEFT JOIN c ON s.user_id = c.user_id", "paper_state", "positions", "paper_orders", "curves", curve=CURVE, n=COUNTS, c=CHANGE).replace("e.equity, e.exposure,", "round(e.equity, 6) AS equity, CAST(e.exposure AS DOUBLE) AS exposure,"))
def books_overview(spark, sf_dir):
    """A row for each book: money, newest equity, counts, strategy and the change of the day."""
    kinds = spark.createDataFrame([(0, "trend", 1), (1, "value", 1)], "id int, name string, version int")
    d = desk.overview(m.paper_state(spark, sf_dir), kinds, equity(spark, sf_dir), m.positions(spark, sf_dir), m.paper_orders(spark, sf_dir))
    out = d.select("user_id", "cash", "equity", "exposure", "n_open", "n_pending", "n_unsent", "strategy_name", "delta", "delta_pct", "total_return")
    return r(r(out, "equity", "delta", places=6), "delta_pct", "total_return", places=8)


@query(m.sql(COUNTS, "positions", "paper_orders"))
def book_counts(spark, sf_dir):
    return desk.counts(m.positions(spark, sf_dir), m.paper_orders(spark, sf_dir))


@query(m.sql("SELECT user_id, round(delta, 6) AS delta, round(delta_pct, 8) AS delta_pct FROM c", "paper_state", "curves", curve=CURVE, c=CHANGE))
def day_change(spark, sf_dir):
    return r(r(desk.day_change(equity(spark, sf_dir), m.paper_state(spark, sf_dir).select("user_id", "initial_capital")), "delta", places=6), "delta_pct", places=8)


OPEN = "SELECT p.*, ticker, last_close, last_close * qty AS value, (last_close - entry_price) * qty AS pnl FROM positions p JOIN instruments i ON p.instrument_id = i.instrument_id LEFT JOIN last l ON p.instrument_id = l.instrument_id WHERE status = 'OPEN'"


@query(m.sql("SELECT position_id, o.user_id, ticker, round(value, 9) AS value, round(pnl, 9) AS pnl, round(last_close / nullif(entry_price, 0) - 1, 8) AS pnl_pct, round(value / nullif(e.equity, 0), 8) AS weight, round(1 - stop_price / nullif(last_close, 0), 8) AS stop_buffer, coalesce(1 - stop_price / nullif(last_close, 0) < 0.03, false) AS near_stop, row_number() OVER (PARTITION BY o.user_id ORDER BY coalesce(value, 0) DESC, position_id) AS rank FROM o LEFT JOIN (SELECT user_id, arg_max(equity, date) AS equity FROM curve GROUP BY 1) e ON o.user_id = e.user_id", "bars", "instruments", "positions", "curves", curve=CURVE, last=LAST, o=OPEN))
def open_positions(spark, sf_dir):
    """Open positions by falling value within their book."""
    d = open_rows(spark, sf_dir).select("position_id", "user_id", "ticker", "value", "pnl", "pnl_pct", "weight", "stop_buffer", "near_stop", "rank")
    return r(r(d, "value", "pnl", places=9), "pnl_pct", "weight", "stop_buffer", places=8)


@query(m.sql("SELECT user_id, round(sum(coalesce(pnl, 0)), 2) AS unrealised FROM o GROUP BY 1", "bars", "instruments", "positions", last=LAST, o=OPEN))
def unrealised_profit(spark, sf_dir):
    return r(desk.unrealised(open_rows(spark, sf_dir)), "unrealised", places=2)


@query(m.sql("SELECT user_id, sector, round(worth, 2) AS worth, round(worth / nullif(sum(worth) OVER (PARTITION BY user_id), 0), 8) AS share FROM (SELECT o.user_id, i.sector, sum(coalesce(value, 0)) AS worth FROM o JOIN instruments i ON o.instrument_id = i.instrument_id GROUP BY 1, 2)", "bars", "instruments", "positions", last=LAST, o=OPEN))
def sector_exposure(spark, sf_dir):
    """What open positions of each sector are worth, and their share of the book's holdings."""
    d = open_rows(spark, sf_dir).join(m.instruments(spark, sf_dir).select("instrument_id", "sector"), "instrument_id")
    return r(r(desk.exposures(d, "sector"), "worth", places=2), "share", places=8)


@query(m.sql("SELECT ticker, side, count(*) AS n, sum(qty) AS qty FROM (SELECT instrument_id, CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, id % 9 AS qty FROM paper_orders) o JOIN instruments USING (instrument_id) GROUP BY 1, 2", "instruments", "paper_orders"))
def orders_by_name(spark, sf_dir):
    o = m.paper_orders(spark, sf_dir).select("instrument_id", F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("id") % 9).alias("qty"))
    return desk.named(o, m.instruments(spark, sf_dir)).groupBy("ticker", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query(m.sql("SELECT c.run_id, round(coalesce(bought, 0) / mean, 8) AS turnover FROM (SELECT run_id, avg(equity) AS mean FROM curves GROUP BY 1) c LEFT JOIN (SELECT o_orderpriority AS run_id, sum(l_extendedprice) AS bought FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1) b ON c.run_id = b.run_id", "curves"))
def book_turnover(spark, sf_dir):
    """What was bought (items that weren't returned) over the mean equity."""
    o = m.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("run_id"))
    t = m.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    side = F.when(F.col("l_returnflag") != "R", "BUY").otherwise("SELL")
    t = t.select("run_id", side.alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return r(desk.turnover(t, m.curves(spark, sf_dir)), "turnover", places=8)


@query(m.sql("SELECT date FROM curves UNION SELECT date FROM mkt_index", "curves", "mkt_index"))
def chart_dates(spark, sf_dir):
    return desk.chart_dates(m.curves(spark, sf_dir), m.index_bars(spark, sf_dir))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def latest_calls(spark, sf_dir):
    """The ten newest calls, a report of fixed length."""
    return desk.newest(m.table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"], 10)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, user_id, event_id) - 1 AS place FROM events")
def candidate_order(spark, sf_dir):
    """Candidates of all feeds (users here) by instant, feed and place in the feed."""
    e = m.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published_at"), F.col("user_id").alias("feed_ord"), F.col("event_id").alias("pos"))
    return desk.in_order(e).select("event_id", "place")


ISIN = "'PL' || lpad(CAST(instrument_id AS VARCHAR), 10, '0')"


@query(m.sql(f"SELECT filing_id, (SELECT min(i.instrument_id) FROM instruments i WHERE {ISIN.replace('instrument_id', 'i.instrument_id - i.instrument_id % 2')} = f.isin) AS instrument_id FROM (SELECT filing_id, 'PL' || lpad(CAST(filing_id % 60 AS VARCHAR), 10, '0') AS isin FROM filings) f", "instruments", "filings"))
def filing_owner(spark, sf_dir):
    """Filings by isin; two instruments share one, and the one of least number counts."""
    i = m.instruments(spark, sf_dir).select("instrument_id", F.concat(F.lit("pl"), F.lpad((F.col("instrument_id") - F.col("instrument_id") % 2).cast("string"), 10, "0")).alias("isin"))
    f = m.filings(spark, sf_dir).select("filing_id", F.concat(F.lit("PL"), F.lpad((F.col("filing_id") % 60).cast("string"), 10, "0")).alias("isin"))
    return desk.filing_owner(f, i).select("filing_id", "instrument_id")


@query(m.sql("SELECT ticker FROM instruments WHERE instrument_id % 9 <> 0 AND (delisted_on IS NULL OR delisted_on >= DATE '2000-07-01') AND lower(ticker) <> 'brand#12'", "instruments"))
def live_equities(spark, sf_dir):
    """Instruments that still trade on the 1st of July 2000; numbers divisible by nine stand for indices."""
    i = m.instruments(spark, sf_dir).withColumn("is_index", F.col("instrument_id") % 9 == 0)
    return desk.live(i, ["BRAND#12"], F.lit("2000-07-01").cast("date")).select("ticker")


@query("""SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), ',', chr(160)), '.', ','), chr(160), chr(160)) AS money,
 replace(format('{:+.2f}', (o_totalprice - 150000) / 1000000 * 100), '.', ',') || '%' AS percent, replace(format('{:,}', o_custkey), ',', chr(160)) AS quantity,
 replace(format('{:+.2f}', (o_totalprice - 150000) / 1000000 * 100), '.', ',') || ' p.p.' AS points FROM orders""")
def number_texts(spark, sf_dir):
    """Prices and shares as Polish texts."""
    part = (F.col("o_totalprice") - 150000) / 1000000
    return m.table(spark, sf_dir, "orders").select("o_orderkey", desk.money_text(F.col("o_totalprice")).alias("money"), desk.percent_text(part).alias("percent"), desk.quantity_text(F.col("o_custkey")).alias("quantity"), desk.points_text(part).alias("points"))


@query(m.sql("SELECT position_id, '📈 Sygnal GPW (paper)' || chr(10) || 'Akcja: ' || CASE status WHEN 'OPEN' THEN 'WEJSCIE' ELSE 'WYJSCIE' END || chr(10) || 'Walor: ' || ticker || chr(10) || 'Data: ?' || chr(10) || CASE WHEN position_id % 3 <> 0 THEN 'Cena: ' || format('{:.2f}', round(entry_price * 100, 2)) || ' PLN' || chr(10) ELSE '' END || 'Ilosc: ' || qty AS card FROM positions JOIN instruments USING (instrument_id)", "positions", "instruments"))
def alert_cards(spark, sf_dir):
    """The texts of alerts on positions; a third has no price."""
    p = desk.named(m.positions(spark, sf_dir), m.instruments(spark, sf_dir))
    none, no_day = F.lit(None).cast("double"), F.lit(None).cast("date")
    word = F.when(F.col("status") == "OPEN", "ENTER").otherwise("EXIT")
    return p.select("position_id", desk.card(word, F.col("ticker"), no_day, F.when(F.col("position_id") % 3 != 0, F.round(F.col("entry_price") * 100, 2)), F.col("qty"), none).alias("card"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (PL' || c_custkey || ')' ELSE 'T' || c_custkey END AS identity, 'T' || c_custkey || '.WA' AS symbol FROM customer")
def company_names(spark, sf_dir):
    """How companies are called in a question and in a feed; a third is known by its isin only."""
    key = F.col("c_custkey").cast("string")
    isin = F.concat(F.lit("PL"), key)
    ticker = F.when(F.col("c_custkey") % 3 == 0, F.lower(isin)).otherwise(F.concat(F.lit("t"), key))
    return m.table(spark, sf_dir, "customer").select("c_custkey", desk.identity(F.col("c_name"), ticker, isin).alias("identity"), desk.feed_symbol(F.concat(F.lit("t"), key)).alias("symbol"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS taken, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m') END AS month FROM events")
def snapshot_times(spark, sf_dir):
    """Instants that snapshots' file names hold; every fifth name is another one."""
    e = m.table(spark, sf_dir, "events")
    name = F.concat(F.when(F.col("event_id") % 5 != 0, "gpw-").otherwise("old-"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".db"))
    at, month = desk.snapshot_time(name)
    return e.select("event_id", at.cast("timestamp_ntz").alias("taken"), month.alias("month"))


# --- loads ---------------------------------------------------------------------------------------------------------------

#: Rows of session files, from customers' orders: the isin is the customer's, a day the order's.
ROWS = "SELECT CAST(o_orderdate AS DATE) AS date, 'PL' || o_custkey AS isin, CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'PLN' END AS currency, o_totalprice AS close FROM orders"
UNIVERSE = "SELECT 'C' || c_custkey AS ticker, CASE WHEN c_custkey % 13 <> 0 THEN 'PL' || c_custkey END AS isin, CASE WHEN c_custkey % 7 = 0 THEN DATE '1994-01-01' END AS delisted_on, CASE WHEN c_custkey % 11 = 0 THEN DATE '1997-01-01' END AS listed_from FROM customer WHERE c_custkey % 2 = 0"


def session_rows(spark, sf_dir):
    o = m.table(spark, sf_dir, "orders")
    return o.select(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("PL"), F.col("o_custkey").cast("string")).alias("isin"), F.when(F.col("o_orderkey") % 10 == 0, "EUR").otherwise("PLN").alias("currency"), F.col("o_totalprice").alias("close"))


def universe_rows(spark, sf_dir):
    key, d = F.col("c_custkey"), lambda x: F.lit(x).cast("date")
    isin = F.when(key % 13 != 0, F.concat(F.lit("PL"), key.cast("string")))
    return m.table(spark, sf_dir, "customer").filter(key % 2 == 0).select(F.concat(F.lit("C"), key.cast("string")).alias("ticker"), isin.alias("isin"), F.when(key % 7 == 0, d("1994-01-01")).alias("delisted_on"), F.when(key % 11 == 0, d("1997-01-01")).alias("listed_from"))


@query(m.sql("SELECT coalesce(ticker, lower(r.isin)) AS ticker, count(*) AS n, min(date) AS first_day, max(close) AS high FROM r LEFT JOIN u ON r.isin = u.isin WHERE currency = 'PLN' GROUP BY 1", r=ROWS, u=UNIVERSE))
def full_market_rows(spark, sf_dir):
    """Rows of all złoty instruments, those outside the universe under their isin."""
    d = load.matched(session_rows(spark, sf_dir), universe_rows(spark, sf_dir), full_market=True)
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("close").alias("high"))


@query(m.sql("SELECT ticker, 'no isin' AS reason FROM u WHERE isin IS NULL UNION ALL SELECT ticker, 'not in any file' FROM u WHERE isin IS NOT NULL AND NOT coalesce(delisted_on < DATE '1995-01-01', false) AND NOT coalesce(listed_from > DATE '1995-12-31', false) AND isin NOT IN (SELECT isin FROM r WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31')", r=ROWS, u=UNIVERSE))
def load_absences(spark, sf_dir):
    """Entries of the universe that no file of 1995 has."""
    return load.absences(session_rows(spark, sf_dir), universe_rows(spark, sf_dir), F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))


FILES = "SELECT CAST(o_orderdate AS DATE) AS date, o_custkey, o_orderpriority AS name, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS isin FROM orders"


@query(m.sql("SELECT min(isin) AS isin FROM f WHERE name = '5-LOW' AND date = (SELECT max(date) FROM f WHERE date <= DATE '1996-05-11' AND date > DATE '1996-05-11' - 14) HAVING count(*) > 0", f=FILES))
def index_isin(spark, sf_dir):
    """The isin of an index by name in any case, of the newest of a fortnight's files: orders are lines of day files, priorities names."""
    rows = m.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.initcap("o_orderpriority").alias("name"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("isin"))
    return load.index_isin(rows, "5-low", F.lit("1996-05-11").cast("date"))


@query("SELECT s_suppkey AS id, s_name AS ticker, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 8 <> 0 THEN 'PL' || s_nationkey END AS isin FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY 'New' || s_suppkey), 'New' || s_suppkey, 'PL' || s_nationkey FROM supplier WHERE s_suppkey % 5 = 0")
def instrument_upsert(spark, sf_dir):
    """Suppliers as instruments: some get an isin by their name in capitals, others are new."""
    s = m.table(spark, sf_dir, "supplier").withColumn("isin", F.concat(F.lit("PL"), F.col("s_nationkey").cast("string")))
    stored = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("ticker"), F.lit(None).cast("string").alias("isin"))
    known = s.filter("s_suppkey % 4 = 0").select(F.upper("s_name").alias("ticker"), F.when(F.col("s_suppkey") % 8 != 0, F.col("isin")).alias("isin"))
    fresh = s.filter("s_suppkey % 5 = 0").select(F.concat(F.lit("New"), F.col("s_suppkey").cast("string")).alias("ticker"), "isin")
    return load.instruments(stored, known.unionByName(fresh))


@query(m.sql("SELECT 'old' AS index_name, instrument_id, date_from, date_to FROM membership JOIN instruments USING (ticker) UNION ALL SELECT 'wig', instrument_id, DATE '1997-01-01', CASE WHEN instrument_id % 4 = 0 THEN DATE '1999-01-01' END FROM instruments WHERE instrument_id % 3 = 0", "instruments", "membership"))
def membership_load(spark, sf_dir):
    """The ranges of one index are replaced as a whole, those of another stay."""
    i = m.instruments(spark, sf_dir)
    rows = m.membership(spark, sf_dir).join(i.select("ticker", "instrument_id"), "ticker").select("instrument_id", "date_from", "date_to", F.lit("file").alias("source"))
    before = rows.withColumn("index_name", F.lit("old")).unionByName(rows.withColumn("index_name", F.lit("wig")))
    given = i.filter("instrument_id % 3 = 0").select(F.lit("WIG").alias("index_name"), F.upper("ticker").alias("ticker"), F.lit("1997-01-01").cast("date").alias("date_from"), F.when(F.col("instrument_id") % 4 == 0, F.lit("1999-01-01").cast("date")).alias("date_to"), F.lit("file").alias("source"))
    unknown = given.limit(1).withColumn("ticker", F.lit("nobody"))
    t = stored.membership_table(spark, scratch(spark, "membership"))
    t.replace(before.select("index_name", "instrument_id", "date_from", "date_to", "source"))
    for _ in range(2):
        stored.store_membership(t, given.unionByName(unknown), i)
    return t.read().select("index_name", "instrument_id", "date_from", "date_to")


@query("SELECT n_nationkey AS ticker, CASE WHEN n_nationkey % 4 = 0 THEN 'close' ELSE 'ok' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def readable_files(spark, sf_dir):
    """Files (nations here) of which some lack a price: these fail as a whole, the others load."""
    c = m.table(spark, sf_dir, "customer").join(m.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("n_nationkey").alias("ticker"), F.when(F.col("n_nationkey") % 4 != 0, F.col("c_acctbal")).alias("close"))
    good, failed = load.split_readable(rows, ["close"])
    n = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return good.select("ticker", F.lit("ok").alias("outcome")).distinct().unionByName(failed.withColumnRenamed("reason", "outcome")).join(n, "ticker")


# --- gates and records ---------------------------------------------------------------------------------------------------


@query(m.sql("""SELECT s.user_id, g.latest, date_diff('day', g.latest, DATE '1998-12-05') AS age, with_bar, active, behind AS sessions,
 CASE WHEN date_diff('day', g.latest, DATE '1998-12-05') > 4 THEN 'stale' WHEN with_bar < 0.5 * active THEN 'coverage' WHEN config_hash <> 'new' THEN 'config changed' WHEN behind > 150 THEN 'too far behind' END AS reason
 FROM paper_state s, (SELECT max(date) AS latest FROM bars) g,
 (SELECT count(*) FILTER (has) AS with_bar, count(*) AS active FROM (SELECT b.ticker, bool_or(date = (SELECT max(date) FROM bars)) AS has FROM bars b JOIN instruments i ON b.ticker = i.ticker WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 15)) AND (delisted_on IS NULL OR delisted_on >= (SELECT max(date) FROM bars)) GROUP BY 1)) c,
 LATERAL (SELECT count(DISTINCT date) AS behind FROM bars WHERE date > s.last_settled_date) n""", "bars", "instruments", "paper_state"))
def paper_gate(spark, sf_dir):
    """Which books may run on the day after the market's last one, and what refuses the others."""
    i = m.instruments(spark, sf_dir)
    prices = m.bars(spark, sf_dir).join(i.select("ticker", "instrument_id"), "ticker").select("instrument_id", "date", F.lit("real").alias("source"))
    return gates.paper_gate(prices, i, m.paper_state(spark, sf_dir), F.lit("1998-12-05").cast("date"), "new", max_sessions=150)


@query(m.sql("SELECT b.run_id, round(b.sharpe - a.sharpe, 6) AS d_sharpe, round(b.max_drawdown - a.max_drawdown, 6) AS d_max_drawdown, b.sharpe > a.sharpe AND b.sortino >= a.sortino AND b.max_drawdown >= a.max_drawdown AS better, CASE WHEN length(b.run_id) % 2 = 0 THEN 'dsr missing' WHEN length(b.run_id) < 9 THEN 'dsr under 0.90' ELSE '' END AS notes FROM x b, x a WHERE a.run_id = '1-URGENT' AND b.run_id <> '1-URGENT'", "curves", steps=STEPS, x=METRICS))
def ab_gates(spark, sf_dir):
    """Runs against the first one, with floors for what luck would give (here by the length of a name)."""
    x = metrics.curve_metrics(m.curves(spark, sf_dir))
    n = F.length("run_id")
    x = x.withColumns({"n_trades": F.lit(0), "dsr": F.when(n % 2 != 0, n / 10.0), "percentile": F.lit(0.99)})
    d = gates.compared(x, "1-URGENT", {"min_dsr": 0.9, "min_random_percentile": 0.95})
    return r(d.select("run_id", "d_sharpe", "d_max_drawdown", "better", "notes"), "d_sharpe", "d_max_drawdown")


@query("SELECT doc_id AS filing_id, arg_max(label, (labelled_at, label)) AS label FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'bullish' ELSE 'irrelevant' END AS label, doc_id AS labelled_at FROM labels UNION ALL SELECT doc_id, 'bearish', doc_id + 1 FROM labels WHERE toxic = 1) GROUP BY 1")
def label_upsert(spark, sf_dir):
    """Labels of filings, of which later ones replace earlier ones."""
    d = m.table(spark, sf_dir, "labels")
    first = d.groupBy(F.col("doc_id").alias("filing_id")).agg(F.max(F.struct(F.when(F.col("quality") == 1, "bullish").otherwise("irrelevant").alias("label"))).alias("x")).select("filing_id", F.col("x.label").alias("label"), F.col("filing_id").alias("labelled_at"))
    later = d.filter("toxic = 1").select(F.col("doc_id").alias("filing_id"), F.lit("bearish").alias("label"), (F.col("doc_id") + 1).alias("labelled_at"))
    t = Table(spark, scratch(spark, "labels"), ["filing_id"])
    for rows in (first, later, later):
        stored.store_labels(t, rows)
    return t.read().select("filing_id", "label")


@query(m.sql("SELECT 'prices' AS what, CAST(max(date) AS VARCHAR) AS detail, false AS stale FROM bars UNION ALL SELECT 'demo bars', CAST(count(*) FILTER (instrument_id = 12) AS VARCHAR), count(*) FILTER (instrument_id = 12) > 0 FROM bars JOIN instruments USING (ticker) UNION ALL SELECT 'collector', strftime(max(ts), '%Y-%m-%d %H:%M:%S'), date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01 00:00:00') / 60 > 120 FROM events UNION ALL SELECT 'filings', CAST(count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS VARCHAR), false FROM documents UNION ALL SELECT 'paper ' || user_id, CAST((SELECT count(DISTINCT date) FROM bars WHERE date > s.last_settled_date) AS VARCHAR), (SELECT count(DISTINCT date) FROM bars WHERE date > s.last_settled_date) >= 2 FROM paper_state s UNION ALL SELECT 'backup', strftime(max(ts), '%Y-%m-%d %H:%M:%S'), date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01 00:00:00') / 3600 > 36 FROM events", "bars", "instruments", "paper_state"))
def service_status(spark, sf_dir):
    """What is watched: bars (those of Brand#12 count as made up), collector, filings without a label, books, backup."""
    i = m.instruments(spark, sf_dir).select("ticker", "instrument_id")
    prices = m.bars(spark, sf_dir).join(i, "ticker").select("date", F.when(F.col("instrument_id") == 12, "demo").otherwise("real").alias("source"))
    e = m.table(spark, sf_dir, "events")
    done = m.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("processed")).distinct()
    filings = m.table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left").select(F.coalesce("processed", F.lit(False)).alias("processed"))
    names = e.select(F.concat(F.lit("gpw-"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".db")).alias("name"))
    return desk.status(prices, e.select(F.col("ts").cast("timestamp").alias("last_success")), filings, m.paper_state(spark, sf_dir), names, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query(m.sql("SELECT ticker, date, source FROM (SELECT b.ticker, b.date, CASE WHEN b.date >= DATE '1998-01-01' THEN 'new' WHEN (SELECT min(date) FROM bars x WHERE x.ticker = b.ticker) = DATE '1992-01-03' THEN 'demo' ELSE 'unknown' END AS source FROM bars b)", "bars"))
def relabelled_bars(spark, sf_dir):
    """Bars without a source are named; those of names whose first bar is of the 3rd of January 1992 count as made up."""
    b = m.bars(spark, sf_dir).join(m.instruments(spark, sf_dir).select("ticker", "instrument_id"), "ticker").select("ticker", "instrument_id", "date", F.when(F.col("date") >= "1998-01-01", "new").alias("source"))
    return load.relabelled(b, b, F.lit("1992-01-03").cast("date")).select("ticker", "date", "source")


@query(m.sql(f"""SELECT b.ticker, b.date, round(close * coalesce(p, 1), 9) AS close, (SELECT count(*) FROM actions JOIN instruments USING (ticker) WHERE instrument_id % 4 = 0) AS bad FROM bars b
 LEFT JOIN (SELECT ticker, ex_date, {FACTOR} AS p FROM prior) f ON f.ticker = b.ticker AND b.date < f.ex_date""", "bars", "actions", "instruments", prior=PRIOR + " WHERE a.ticker IN (SELECT ticker FROM instruments WHERE instrument_id % 4 <> 0)"))
def refdata_load(spark, sf_dir):
    """Actions are stored but for those without a positive value (a quarter), and adjusted bars built anew from them."""
    i = m.instruments(spark, sf_dir)
    acts = m.actions(spark, sf_dir).join(i.select("ticker", "instrument_id"), "ticker")
    acts = acts.withColumn("value_or_ratio", F.when(F.col("instrument_id") % 4 == 0, -1.0).otherwise(F.col("value_or_ratio"))).drop("instrument_id")
    b = written(m.bars(spark, sf_dir), "bars")
    actions, adjusted = Table(spark, scratch(spark, "actions"), ["ticker", "ex_date", "action_type"]), Table(spark, scratch(spark, "adjusted"), ["ticker", "date"])
    bad = stored.store_refdata(actions, adjusted, b, acts, i, fe.calendar(b))
    n = bad.agg(F.count(F.lit(1)).alias("bad"))
    return r(adjusted.read().select("ticker", "date", "close").join(F.broadcast(n)), "close")


@query(m.sql("SELECT date, count(*) FILTER (score > 0) AS permit, count(*) FILTER (score <= 0) AS veto, count(*) FILTER (score IS NULL) AS no_score FROM (SELECT p.date, f.pe - 20 AS score FROM p ASOF LEFT JOIN fundamentals f ON p.ticker = f.ticker AND p.date >= f.as_of_date WHERE " + ENTER + ") GROUP BY date", "bars", "fundamentals", tr=TR, p=PANEL))
def radar_counts(spark, sf_dir):
    """Of the names that would enter by price alone, how many a score lets in, keeps out, or doesn't know."""
    gated = rules.TREND | {"entry": {"all": [*rules.TREND["entry"]["all"], {"feature": "llm_score", "op": "gt", "value": 0.0}]}}
    scores = m.fundamentals(spark, sf_dir).select("ticker", F.col("as_of_date").alias("known"), (F.col("pe") - 20).alias("llm_score"))
    return rules.radar(asof(fe.averages(fe.returns(m.bars(spark, sf_dir))), scores, "ticker", "date", "known", ["llm_score"]), gated)


@query(m.sql("SELECT ticker, count(*) AS n, round(arg_max(close, date), 9) AS close FROM bars JOIN instruments USING (ticker) WHERE instrument_id % 9 <> 0 AND date <= DATE '1997-06-30' GROUP BY ticker", "bars", "instruments"))
def price_scan(spark, sf_dir):
    """Raw bars that were known on a day, without those of indices (numbers divisible by nine)."""
    i = m.instruments(spark, sf_dir).withColumn("is_index", F.col("instrument_id") % 9 == 0)
    b = m.bars(spark, sf_dir).join(i.select("ticker", "instrument_id"), "ticker").withColumns({"adjusted": F.lit(False), "as_of_date": F.col("date")})
    known = universe.price_scan(b, i).filter(F.col("as_of_date") <= F.lit("1997-06-30").cast("date"))
    return r(known.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max_by("close", "date").alias("close")), "close")


@query("SELECT doc_id AS filing_id FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars % 50, lang ORDER BY doc_id) AS k FROM (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS first FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)) WHERE first = 1 AND (source, n_chars % 50, lang) NOT IN (SELECT source, n_chars % 50, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)) WHERE k = 1")
def collector_cycle(spark, sf_dir):
    """Documents as items of feeds, of which the labelled ones are stored: what a cycle adds, each text and each report once."""
    d = m.table(spark, sf_dir, "documents")
    key = text.item_key(F.lit(" "), F.lit(None).cast("string"), F.col("text"))
    items = d.select(F.col("doc_id").alias("filing_id"), F.lit(0).alias("feed_ord"), F.col("doc_id").alias("pos"), key.alias("dedup_key"), F.col("source").alias("isin"), (F.col("n_chars") % 50).cast("string").alias("report_no"), F.col("lang").alias("kind"), F.col("doc_id").alias("published_at"))
    stored = items.join(m.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filing_id")), "filing_id", "left_semi")
    return collect.cycle(items, stored).select("filing_id")
