"""A market derived from the star schema: bars, instruments, an index, membership, actions, filings and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, volume: one bar for each brand and ship date, trades in the order of all their columns."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    trades = items.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return trades.groupBy("ticker", "date").agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, instrument_id, sector, delisted_on (null: still listed)."""
    number = F.split_part("ticker", F.lit("#"), F.lit(2)).cast("int")
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return own.select("ticker", number.alias("instrument_id"), (number % 5).alias("sector"), F.when(number % 7 == 0, F.lit("2000-06-30").cast("date")).alias("delisted_on"))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close of the whole market: the volume-weighted price of each day."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"))
    return items.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date_from, date_to (null: still a member), both inclusive."""
    odd = F.col("instrument_id") % 2 == 0
    return instruments(spark, sf_dir).filter(odd).select("ticker", F.lit("1996-01-01").cast("date").alias("date_from"), F.when(F.col("instrument_id") % 3 == 0, F.lit("1999-12-31").cast("date")).alias("date_to"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, action_type, ex_date, value_or_ratio: one action for each instrument."""
    k = F.col("instrument_id") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    return instruments(spark, sf_dir).select("ticker", pick("split", "dividend", "rights_issue").alias("action_type"), F.lit("1998-07-04").cast("date").alias("ex_date"), pick(2.0, 5.0, 0.9).alias("value_or_ratio"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, as_of_date, pe, pb: published each spring for the year before, by arithmetic on number and year."""
    years = F.explode(F.sequence(F.lit(1996), F.lit(2001)))
    d = instruments(spark, sf_dir).select("ticker", "instrument_id", years.alias("y"))
    return d.select("ticker", F.make_date("y", F.lit(4), F.lit(15)).alias("as_of_date"), F.when((F.col("instrument_id") + F.col("y")) % 6 != 0, (F.col("instrument_id") * 7 + F.col("y")) % 30 + 5.0).alias("pe"), ((F.col("instrument_id") + F.col("y")) % 4 + 0.5).alias("pb"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, source, instrument_id (null: unmapped), content_hash, full_text, n_chars."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("filing_id"), "source", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 25 + 1).cast("int").alias("instrument_id"), F.sha2(F.col("text"), 256).alias("content_hash"), F.col("text").alias("full_text"), "n_chars")


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (event type), bar_start, open, high, low, close, volume of five-minute bars."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("ticker"), five_minutes(F.col("ts")).alias("bar_start")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume"))


def five_minutes(ts: Column) -> Column:
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(300)))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, date, equity: a curve for each order priority."""
    from pyspark.sql import Window

    day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), F.to_date("o_orderdate").alias("date")).agg(F.sum(F.col("o_totalprice") - 250000).alias("gain"))
    w = Window.partitionBy("run_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("run_id", "date", (F.lit(100000.0) + F.sum("gain").over(w) / 1000).alias("equity"))


def owner(a: str, b: str) -> Column:
    """An instrument's number from two keys."""
    return ((F.col(a) % 5 + 1) * 10 + F.col(b) % 5 + 1).cast("int")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position_id, user_id, instrument_id, qty, entry_price, stop_price, status of books: an order is a position."""
    o = table(spark, sf_dir, "orders")
    price = (F.col("o_totalprice") / 100).alias("entry_price")
    return o.select(F.col("o_orderkey").alias("position_id"), F.col("o_orderpriority").alias("user_id"), owner("o_custkey", "o_orderkey").alias("instrument_id"), (F.col("o_orderkey") % 40 + 1).alias("qty"), price, (F.col("o_totalprice") / 120).alias("stop_price"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"))


def paper_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, instrument_id, status, signal_sent, fill_sent of a queue of orders."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(key % 3 == 0, "PARTIAL").when(key % 5 == 0, "LAPSED").otherwise("FILLED")
    return o.select(key.alias("id"), F.col("o_orderpriority").alias("user_id"), owner("o_custkey", "o_orderkey").alias("instrument_id"), status.alias("status"), (key % 11 != 0).alias("signal_sent"), (key % 7 != 0).alias("fill_sent"))


def paper_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, cash, initial_capital, last_settled_date, strategy_id, config_hash of each book."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("user_id")).agg(F.max("o_orderdate").alias("last"), F.min("o_totalprice").alias("cash"))
    n = F.length("user_id")
    return o.select("user_id", "cash", F.lit(100000.0).alias("initial_capital"), F.date_sub(F.to_date("last"), n).alias("last_settled_date"), (n % 3).alias("strategy_id"), F.when(n % 2 == 0, "new").otherwise("old").alias("config_hash"))


#: The same views as common table expressions of DuckDB, by name, in the order in which they build on each other.
SQL = {
    "trades": "SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS q, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn, row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rd FROM lineitem JOIN part ON l_partkey = p_partkey",
    "bars": "SELECT ticker, date, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN rd = 1 THEN px END) AS close, sum(q) AS volume FROM trades GROUP BY ticker, date",
    "instruments": "SELECT DISTINCT p_brand AS ticker, CAST(split_part(p_brand, '#', 2) AS INT) AS instrument_id, CAST(CAST(split_part(p_brand, '#', 2) AS INT) % 5 AS INT) AS sector, CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 7 = 0 THEN DATE '2000-06-30' END AS delisted_on FROM part",
    "mkt_index": "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1",
    "membership": "SELECT ticker, DATE '1996-01-01' AS date_from, CASE WHEN instrument_id % 3 = 0 THEN DATE '1999-12-31' END AS date_to FROM instruments WHERE instrument_id % 2 = 0",
    "actions": "SELECT ticker, CASE WHEN instrument_id % 3 = 0 THEN 'split' WHEN instrument_id % 3 = 1 THEN 'dividend' ELSE 'rights_issue' END AS action_type, DATE '1998-07-04' AS ex_date, CASE WHEN instrument_id % 3 = 0 THEN 2.0e0 WHEN instrument_id % 3 = 1 THEN 5.0e0 ELSE 0.9e0 END AS value_or_ratio FROM instruments",
    "fundamentals": "SELECT ticker, make_date(CAST(y AS INT), 4, 15) AS as_of_date, CASE WHEN (instrument_id + y) % 6 <> 0 THEN CAST((instrument_id * 7 + y) % 30 + 5 AS DOUBLE) END AS pe, CAST((instrument_id + y) % 4 + 0.5 AS DOUBLE) AS pb FROM instruments, range(1996, 2002) t(y)",
    "filings": "SELECT doc_id AS filing_id, source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 25 AS INT) + 1 END AS instrument_id, sha256(text) AS content_hash, text AS full_text, n_chars FROM documents",
    "intraday": "SELECT event_type AS ticker, time_bucket(INTERVAL '5 minutes', ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2",
    "positions": "SELECT o_orderkey AS position_id, o_orderpriority AS user_id, CAST((o_custkey % 5 + 1) * 10 + o_orderkey % 5 + 1 AS INT) AS instrument_id, o_orderkey % 40 + 1 AS qty, o_totalprice / 100 AS entry_price, o_totalprice / 120 AS stop_price, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status FROM orders",
    "paper_orders": "SELECT o_orderkey AS id, o_orderpriority AS user_id, CAST((o_custkey % 5 + 1) * 10 + o_orderkey % 5 + 1 AS INT) AS instrument_id, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderkey % 3 = 0 THEN 'PARTIAL' WHEN o_orderkey % 5 = 0 THEN 'LAPSED' ELSE 'FILLED' END AS status, o_orderkey % 11 <> 0 AS signal_sent, o_orderkey % 7 <> 0 AS fill_sent FROM orders",
    "paper_state": "SELECT o_orderpriority AS user_id, min(o_totalprice) AS cash, 100000e0 AS initial_capital, CAST(max(o_orderdate) AS DATE) - CAST(length(o_orderpriority) AS INT) AS last_settled_date, CAST(length(o_orderpriority) % 3 AS INT) AS strategy_id, CASE WHEN length(o_orderpriority) % 2 = 0 THEN 'new' ELSE 'old' END AS config_hash FROM orders GROUP BY o_orderpriority",
    "curves": "SELECT o_orderpriority AS run_id, CAST(o_orderdate AS DATE) AS date, 100000 + sum(sum(o_totalprice - 250000)) OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1000 AS equity FROM orders GROUP BY 1, 2",
}
NEEDS = {"bars": ["trades"], "membership": ["instruments"], "actions": ["instruments"], "fundamentals": ["instruments"]}


def sql(body: str, *views: str, **more: str) -> str:
    """body with the views that it names, and further ones, before it."""
    wanted: dict[str, str] = {}

    def want(name: str) -> None:
        for x in NEEDS.get(name, []):
            want(x)
        wanted.setdefault(name, SQL[name])

    for v in views:
        want(v)
    wanted |= more
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in wanted.items()) + "\n" + body
