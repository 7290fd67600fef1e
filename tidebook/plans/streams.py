"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rules, simulation
from ..sources import market as m
from ..operators.stored import filings_table
from ..storage import scratch
from ..streaming import monitor, outbox
from ..streaming.ingest import drain, filings_stream, five_minute_bars
from ..streaming.paper import paper_book as book_of
from .features import FLOOR, r
from .runs import CAPITAL, traded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stream(spark, sf_dir, name):
    """A table as a stream of its files."""
    schema = m.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(m.sql("SELECT ticker, epoch_us(bar_start) // 1000000 AS bar_start_s, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume FROM intraday WHERE bar_start + INTERVAL '15 minutes' <= (SELECT max(ts) FROM events)", "intraday"))
def intraday_stream(spark, sf_dir):
    trades = stream(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"))
    d = drain(five_minute_bars(trades), "bars").withColumn("bar_start_s", F.unix_seconds("bar_start"))
    return r(d, "open", "high", "low", "close").drop("bar_start")


def arrivals(d, column: str, name: str, n: int = 3):
    """A table that comes in n parts by the days of a column: each time that a part has come, the stream of all that is there.

    Drained each time, with the state of before, the stream has a part a batch. Parts are written by as many tasks as their
    rows need; the table is worked out once.
    """
    spark = d.sparkSession
    kept, folder = scratch(spark, f"{name}-rows"), scratch(spark, name)
    low, high = d.agg(F.min(F.to_date(column)), F.max(F.to_date(column))).first()
    step = max(1, -(-((high - low).days + 1) // n)) if low else 1
    part = F.coalesce(F.floor(F.date_diff(F.to_date(column), F.lit(low)) / step), F.lit(-1)).cast("int")
    d.withColumn("_part", part).write.partitionBy("_part").parquet(kept)
    rows = spark.read.schema(T.StructType([*d.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(kept)
    for k in range(n):
        rows.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(folder)
        yield spark.readStream.schema(d.schema).parquet(folder)


@query("SELECT user_id % 997 AS dedup_key, arg_min(event_id, (ts, event_id)) AS event_id, min(ts)::DATE AS first_day FROM events GROUP BY 1")
def filings_dedup_stream(spark, sf_dir):
    """Events as filings, some days a batch: of each key the first one stays."""
    e = m.table(spark, sf_dir, "events").select((F.col("user_id") % 997).alias("dedup_key"), F.col("ts").cast("timestamp").alias("published_at"), "event_id")
    t = filings_table(spark, scratch(spark, "filings"), buckets=8)
    state = scratch(spark, "filings-state")
    for feed in arrivals(e, "published_at", "feed"):
        filings_stream(feed, t, state=state)
    return t.read().select("dedup_key", "event_id", F.col("published_at").cast("date").alias("first_day"))


QUOTES = "SELECT user_id AS instrument_id, time_bucket(INTERVAL '5 minutes', ts) AS bar_start, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2"
STOPS = "SELECT o_orderkey AS position_id, o_custkey AS instrument_id, o_orderkey % 120 AS stop_price FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 13 <> 0"


@query(f"""WITH quotes AS ({QUOTES}), stops AS ({STOPS}), j AS (SELECT position_id, bar_start::DATE AS session_date, bar_start, close, CASE WHEN close <= stop_price THEN 'STOP_BREACH' WHEN close <= stop_price * 1.02::DOUBLE THEN 'NEAR_STOP' END AS state FROM quotes JOIN stops USING (instrument_id))
 SELECT position_id, session_date, state, arg_min(close, bar_start) AS price, CAST(epoch(min(bar_start)) AS BIGINT) AS bar_start_s FROM j WHERE state IS NOT NULL GROUP BY 1, 2, 3""")
def stop_monitor(spark, sf_dir):
    """Warnings of a stream of five-minute bars (of each user's events) against stops of open positions (orders of customers)."""
    e = m.table(spark, sf_dir, "events")
    bars = e.groupBy(F.col("user_id").alias("instrument_id"), m.five_minutes(F.col("ts")).alias("bar_start")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    key = F.col("o_orderkey")
    held = m.table(spark, sf_dir, "orders").select(key.alias("position_id"), F.col("o_custkey").alias("instrument_id"), F.when(key % 13 != 0, key % 120).alias("stop_price"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"))
    folders = scratch(spark, "warnings"), scratch(spark, "warnings-state")
    with monitor.keyed_state(spark):
        for quotes in arrivals(bars, "bar_start", "quotes"):
            found = drain(monitor.stop_warnings(quotes, held), "warnings", folders=folders)
    return found.withColumn("bar_start_s", F.unix_seconds("bar_start")).drop("bar_start")


@query("""SELECT o_orderkey AS order_id, unnest(k) AS kind, CASE WHEN unnest(k) = 'signal' AND status <> 'PENDING' THEN 'passed over' ELSE 'sent' END AS status,
 CASE WHEN (unnest(k) = 'outcome' OR status = 'PENDING') AND o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderkey % 3 = 0 THEN 'PARTIAL' WHEN o_orderkey % 5 = 0 THEN 'LAPSED' ELSE 'FILLED' END AS status,
 list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'signal' END, CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'P' THEN 'outcome' END], lambda x: x IS NOT NULL) AS k FROM orders)""")
def alert_outbox(spark, sf_dir):
    """What a queue of orders has to tell, sent over a line that is down for every third order at first; then all is told."""
    o = m.paper_orders(spark, sf_dir).join(m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id")
    ledger = outbox.ledger_table(spark, scratch(spark, "ledger"), buckets=8)
    for up in (False, True):
        send, state = outbox.outbox(ledger, lambda key, text, up=up: up or int(key.partition("-")[0]) % 3 > 0), scratch(spark, "queue-state")
        for queue in arrivals(o, "o_orderdate", "queue", 2):
            queue.writeStream.foreachBatch(send).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return ledger.read().select("order_id", "kind", "status", "attempts")


@query()
def paper_book(spark, sf_dir):
    """A live book over the same candidates as the backtest's, a year of sessions to a batch."""
    d, cal = traded(spark, sf_dir)
    rows = simulation.candidates("paper", d, m.instruments(spark, sf_dir), cal, m.actions(spark, sf_dir), rules.TREND, FLOOR / 100)
    rows = rows.join(cal.select("session", F.year("date").alias("year")), "session").persist()
    folder = scratch(spark, "sessions")
    for y in [x["year"] for x in rows.select("year").distinct().orderBy("year").collect()]:
        rows.filter(F.col("year") == y).drop("year").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.drop("year").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    e = drain(book_of(source, 0, rules.TREND["risk"], capital=CAPITAL), "paper")
    return r(e, "price", "fee", "pnl", "equity", "cash", "exposure")
