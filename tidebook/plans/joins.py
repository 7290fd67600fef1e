"""Queries on as-of joins, actions and pairings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import features as fe
from ..operators import pairing, quality, refdata, research
from ..operators.asof import align, asof
from ..sources import market as m
from ..storage import written
from .features import CAL, r

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ASKED = "SELECT o_orderkey, ticker, CAST(o_orderdate AS DATE) AS day FROM orders JOIN instruments ON instrument_id = (o_custkey % 5 + 1) * 10 + o_orderkey % 5 + 1"


def asked(spark, sf_dir):
    """Every order with its instrument and day."""
    o = m.table(spark, sf_dir, "orders").select("o_orderkey", m.owner("o_custkey", "o_orderkey").alias("instrument_id"), F.to_date("o_orderdate").alias("day"))
    return o.join(m.instruments(spark, sf_dir).select("ticker", "instrument_id"), "instrument_id").drop("instrument_id")


@query(m.sql("SELECT a.o_orderkey, a.ticker, a.day, f.date AS bar_date, round(f.close, 9) AS close FROM asked a ASOF LEFT JOIN bars f ON a.ticker = f.ticker AND a.day >= f.date", "bars", "instruments", asked=ASKED))
def snapshot_asof(spark, sf_dir):
    b = m.bars(spark, sf_dir).select("ticker", "date", F.col("date").alias("bar_date"), "close")
    return r(asof(asked(spark, sf_dir), b, "ticker", "day", "date", ["bar_date", "close"]), "close")


@query(m.sql("SELECT a.o_orderkey, a.ticker, a.day, f.as_of_date, f.pe, f.pb FROM asked a ASOF LEFT JOIN fundamentals f ON a.ticker = f.ticker AND a.day >= f.as_of_date", "instruments", "fundamentals", asked=ASKED))
def fundamentals_asof(spark, sf_dir):
    f = m.fundamentals(spark, sf_dir).withColumn("known", F.col("as_of_date"))
    return asof(asked(spark, sf_dir), f, "ticker", "day", "known", ["as_of_date", "pe", "pb"])


@query(m.sql("SELECT a.o_orderkey, a.ticker, a.day, round(f.close, 9) AS close FROM asked a ASOF LEFT JOIN bars f ON a.ticker = f.ticker AND a.day > f.date", "bars", "instruments", asked=ASKED))
def close_before(spark, sf_dir):
    """The last close strictly before a day."""
    return r(asof(asked(spark, sf_dir), m.bars(spark, sf_dir), "ticker", "day", "date", ["close"], strict=True), "close")


@query(m.sql("SELECT ticker, action_type, ex_date, value_or_ratio, (SELECT min(date) FROM cal WHERE date >= ex_date) AS date FROM actions", "bars", "actions", cal=CAL))
def actions_next_session(spark, sf_dir):
    d = quality.next_session(m.actions(spark, sf_dir), fe.calendar(m.bars(spark, sf_dir)))
    return d.select("ticker", "action_type", "ex_date", "value_or_ratio", "date")


@query(m.sql("""SELECT c.run_id, c.date, round(coalesce(last_value(i.close IGNORE NULLS) OVER (PARTITION BY c.run_id ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(i.close IGNORE NULLS) OVER (PARTITION BY c.run_id ORDER BY c.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS close FROM curves c LEFT JOIN mkt_index i ON c.date = i.date""", "curves", "mkt_index"))
def benchmark_aligned(spark, sf_dir):
    """The index, aligned with the dates of every curve, some of which it isn't quoted on."""
    return r(align(m.curves(spark, sf_dir).select("run_id", "date"), m.index_bars(spark, sf_dir), "run_id"), "close")


@query(m.sql("SELECT ticker, max(date) AS date, round(arg_max(close, date), 9) AS close FROM bars WHERE close IS NOT NULL GROUP BY ticker", "bars"))
def latest_close(spark, sf_dir):
    d = m.bars(spark, sf_dir).filter("close is not null").groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return r(d, "close")


MIXED = "SELECT ticker, date, close, false AS adjusted FROM bars UNION ALL SELECT ticker, date, close / 2, true FROM bars WHERE month(date) = 6"


@query(m.sql("SELECT ticker, date, adjusted, round(close, 9) AS close FROM mixed a WHERE adjusted = (SELECT max(adjusted) FROM mixed b WHERE b.ticker = a.ticker AND b.date = a.date)", "bars", mixed=MIXED))
def max_adjusted_rows(spark, sf_dir):
    """Of raw and adjusted rows of a day the adjusted one."""
    b = m.bars(spark, sf_dir).select("ticker", "date", "close", F.lit(False).alias("adjusted"))
    mixed = b.unionByName(b.filter(F.month("date") == 6).select("ticker", "date", (F.col("close") / 2).alias("close"), F.lit(True).alias("adjusted")))
    d = mixed.groupBy("ticker", "date").agg(F.max(F.struct("adjusted", "close")).alias("x"))
    return r(d.select("ticker", "date", "x.*"), "close")


FLOW = """SELECT o_custkey AS ticker, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'ENTER' ELSE 'EXIT' END AS action FROM orders"""


#: A queue for each ticker, decision by decision: entries wait in open, and each exit takes the first of them.
QUEUES = "WITH RECURSIVE flow AS (" + FLOW + """), days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM flow)),
 d AS (SELECT ticker, action, idx, f.date, row_number() OVER (PARTITION BY ticker ORDER BY f.date, seq) AS k FROM flow f JOIN days ON f.date = days.date),
 q AS (SELECT DISTINCT ticker, 0::BIGINT AS k, 0::BIGINT AS n, []::STRUCT(entry BIGINT, idx BIGINT, date DATE)[] AS open, NULL::STRUCT(entry BIGINT, idx BIGINT, date DATE) AS closed, NULL::BIGINT AS until, NULL::DATE AS exited FROM d
  UNION ALL SELECT q.ticker, d.k, n + CASE WHEN action = 'ENTER' THEN 1 ELSE 0 END,
   CASE WHEN action = 'ENTER' THEN list_append(open, {'entry': n + 1, 'idx': d.idx, 'date': d.date}) ELSE open[2:] END,
   CASE WHEN action = 'EXIT' THEN open[1] END, d.idx, d.date FROM q JOIN d ON d.ticker = q.ticker AND d.k = q.k + 1),
 pairs AS (SELECT ticker, closed.entry AS entry, closed.date AS entered, exited, greatest(1, until - closed.idx) AS sessions FROM q WHERE closed IS NOT NULL
  UNION ALL SELECT ticker, x.entry, x.date, NULL, greatest(1, (SELECT max(idx) FROM days) - x.idx) FROM (SELECT ticker, unnest(open) AS x FROM q QUALIFY k = max(k) OVER (PARTITION BY ticker))) """


def flow(spark, sf_dir):
    """Orders as decisions: every third one enters."""
    o = m.table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, "ENTER").otherwise("EXIT").alias("action"))


@query(QUEUES + "SELECT ticker, entry, entered, exited, sessions FROM pairs")
def trade_pairing(spark, sf_dir):
    """Each entry with the exit that closes it in the order of a queue, and the sessions between."""
    d = flow(spark, sf_dir)
    return pairing.pair_trades(d, fe.calendar(d))


@query(QUEUES + "SELECT sessions, count(*) AS n FROM (SELECT sessions FROM pairs UNION ALL SELECT 1 WHERE NOT EXISTS (SELECT 1 FROM pairs)) GROUP BY sessions")
def holding_periods(spark, sf_dir):
    """How often each number of sessions was held."""
    d = flow(spark, sf_dir)
    return pairing.holdings(pairing.pair_trades(d, fe.calendar(d))).groupBy("sessions").agg(F.count(F.lit(1)).alias("n"))


@query(m.sql("SELECT s.ticker, cal.date FROM (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY ticker) s JOIN cal ON cal.date BETWEEN a AND b LEFT JOIN bars ON bars.ticker = s.ticker AND bars.date = cal.date WHERE bars.date IS NULL", "bars", cal=CAL))
def missing_sessions(spark, sf_dir):
    b = m.bars(spark, sf_dir)
    return quality.missing_sessions(b, fe.calendar(b))


FACTOR = "CASE action_type WHEN 'split' THEN 1 / value_or_ratio WHEN 'rights_issue' THEN value_or_ratio ELSE CASE WHEN c > 0 THEN greatest((c - value_or_ratio) / c, 0) ELSE 1 END END"
PRIOR = "SELECT a.*, (SELECT arg_max(close, date) FROM bars b WHERE b.ticker = a.ticker AND b.date < a.ex_date AND close <> 0) AS c FROM actions a"


@query(m.sql(f"SELECT ticker, action_type, round({FACTOR}, 6) AS factor FROM prior", "bars", "actions", prior=PRIOR))
def price_factors(spark, sf_dir):
    a = m.actions(spark, sf_dir)
    d = asof(a, m.bars(spark, sf_dir).filter("close <> 0"), "ticker", "ex_date", "date", ["close"], strict=True)
    return d.select("ticker", "action_type", F.round(money.price_factor(F.col("action_type"), F.col("value_or_ratio"), F.col("close")), 6).alias("factor"))


@query(m.sql(f"""SELECT b.ticker, b.date, round(close * coalesce(p, 1), 9) AS close, round(high * coalesce(p, 1), 9) AS high, round(volume * coalesce(s, 1), 6) AS volume FROM bars b
 LEFT JOIN (SELECT ticker, ex_date, {FACTOR} AS p, CASE WHEN action_type = 'split' THEN value_or_ratio ELSE 1 END AS s FROM prior) f ON f.ticker = b.ticker AND b.date < f.ex_date""", "bars", "actions", prior=PRIOR))
def back_adjusted_bars(spark, sf_dir):
    b = written(m.bars(spark, sf_dir), "bars")  # read for prices, calendar, closes and sessions
    return r(refdata.back_adjusted(b, m.actions(spark, sf_dir), fe.calendar(b)), "close", "high").withColumn("volume", F.round("volume", 6)).select("ticker", "date", "close", "high", "volume")


@query("""WITH i AS (SELECT s_suppkey AS id, 'S' || s_suppkey % 50 AS ticker, s_name AS name FROM supplier), keys AS (SELECT upper(ticker) AS k, id FROM i UNION SELECT upper(name), id FROM i),
 asked AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 's' || l_suppkey % 60 WHEN 1 THEN ' supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') ELSE lower((SELECT min(s_name) FROM supplier)) END AS name FROM lineitem)
 SELECT name, count(*) AS n, min(id) AS instrument_id FROM (SELECT a.*, CASE WHEN (SELECT count(DISTINCT id) FROM keys WHERE k = upper(trim(a.name))) = 1 THEN (SELECT min(id) FROM keys WHERE k = upper(trim(a.name))) END AS id FROM (SELECT DISTINCT name FROM asked) a) JOIN asked USING (name) GROUP BY name""")
def issuer_resolution(spark, sf_dir):
    """Names of line items' suppliers that stand for exactly one of them, by name or by a ticker that several may share."""
    s = m.table(spark, sf_dir, "supplier")
    known = s.select(F.col("s_suppkey").alias("instrument_id"), F.concat(F.lit("S"), (F.col("s_suppkey") % 50).cast("string")).alias("ticker"), F.col("s_name").alias("name"))
    least, k, key = s.agg(F.lower(F.min("s_name")).alias("least")), F.col("l_linenumber") % 3, F.col("l_suppkey")
    own = F.when(k == 0, F.concat(F.lit("s"), (key % 60).cast("string"))).when(k == 1, F.concat(F.lit(" supplier#"), F.lpad(key.cast("string"), 9, "0"))).otherwise(F.col("least"))
    asked = m.table(spark, sf_dir, "lineitem").join(F.broadcast(least)).select(own.alias("name"))
    return research.sole_instrument(asked, known).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("instrument_id").alias("instrument_id"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabeled_docs(spark, sf_dir):
    return m.table(spark, sf_dir, "documents").select("doc_id").join(m.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
