"""Readers of market files: everything is read as text with a given schema and cast, so that bad rows drop out, not files."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta
from hashlib import sha256
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import item_key, published_at

#: Headers of daily files and of session grids.
EOD_HEADERS = {"data": "date", "date": "date", "otwarcie": "open", "open": "open", "najwyzszy": "high", "high": "high", "najnizszy": "low", "low": "low", "zamkniecie": "close", "close": "close", "wolumen": "volume", "volume": "volume"}
GRID_COLUMNS = ("date", "name", "isin", "currency", "open", "high", "low", "close", "change", "volume")
ZONE = "Europe/Warsaw"


def number(x: Column) -> Column:
    """A number with blanks in it and a comma or point; null if it isn't one."""
    return F.regexp_replace(F.regexp_replace(x, r"[\s ]", ""), ",", ".").try_cast("double")


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """date, open, high, low, close, volume of daily files in either language; no volume is 0, a row with a bad number is left out.

    A file without the needed headers raises ValueError.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = {c: EOD_HEADERS.get(c.strip().lower()) for c in raw.columns}
    if not {"date", "open", "high", "low", "close"} <= set(names.values()):
        raise ValueError(f"unknown headers {raw.columns}")
    d = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if n])
    if "volume" not in d.columns:
        d = d.withColumn("volume", F.lit(None).cast("string"))
    day = F.try_to_timestamp(F.trim("date"), F.lit("yyyy-MM-dd")).cast("date")
    prices = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return d.select(day.alias("date"), *prices, F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)).alias("volume")).dropna()


def grid_header(rows: Sequence[Sequence]) -> list[Sequence]:
    """The rows of a session's sheet below its header, which must name at least four of the known columns; short ones are left out."""
    words = ("data", "nazwa", "isin", "waluta", "kurs zamknięcia", "wolumen")
    at = next((i for i, row in enumerate(rows) if sum(any(w == str(c).strip().lower() for c in row) for w in words) >= 4), None)
    if at is None:
        raise ValueError("no header")
    return [row[: len(GRID_COLUMNS)] for row in rows[at + 1 :] if len(row) >= len(GRID_COLUMNS)]


def grid_rows(cells: DataFrame, *keep: str) -> DataFrame:
    """date, name, isin, currency, prices, volume of cells (text columns by the names of GRID_COLUMNS), and the columns keep.

    Rows without prices (suspended names) and closes of 0 or less are left out; no volume is 0.
    """
    day = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), F.try_to_timestamp("date", F.lit("dd-MM-yyyy"))).cast("date")
    out = cells.select(*keep, day.alias("date"), F.trim("name").alias("name"), F.trim("isin").alias("isin"), F.trim("currency").alias("currency"), *[number(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(number(F.col("volume")), F.lit(0.0)).alias("volume"))
    return out.dropna(subset=["date", "close", "open", "high", "low"]).filter("close > 0")


def session_grid(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """grid_rows() of one sheet that is at hand; sheets that are to be fetched come through fetched.sessions()."""
    body = [[str(c) if c is not None else None for c in row] for row in grid_header(rows)]
    return grid_rows(spark.createDataFrame(body, ", ".join(f"{c} string" for c in GRID_COLUMNS)))


def index_json(payloads: DataFrame, column: str = "value") -> DataFrame:
    """date, open, high, low, close, volume of index charts: seconds become Warsaw dates; an o, h or l of 0 or less is the close."""
    shape = "array<struct<data:array<struct<t:bigint,o:double,h:double,l:double,c:double>>>>"
    d = payloads.select(F.explode(F.from_json(column, shape)).alias("s")).select(F.explode("s.data").alias("p")).select("p.*").filter("c > 0")
    fit = F.least("o", "h", "l") > 0
    pick = lambda c: F.when(fit, F.col(c)).otherwise(F.col("c"))
    return d.select(F.from_utc_timestamp(F.timestamp_seconds("t"), ZONE).cast("date").alias("date"), pick("o").alias("open"), pick("h").alias("high"), pick("l").alias("low"), F.col("c").alias("close"), F.lit(0.0).alias("volume"))


def intraday_json(payloads: DataFrame, key: str, column: str = "value", drop_last: bool = True) -> DataFrame:
    """key, bar_start, open, high, low, close, volume of intraday charts. Bars with a null price are left out, no volume is 0,
    and the last bar that is left of each payload, which still forms, is dropped."""
    arrays = "open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>"
    shape = f"chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<{arrays}>>>>>>"
    d = payloads.withColumn("_p", F.monotonically_increasing_id()).select("_p", key, F.from_json(column, shape).alias("j"))
    r = F.col("j.chart.result")[0]
    q = r["indicators"]["quote"][0]
    zipped = F.arrays_zip(r["timestamp"].alias("t"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    d = d.select("_p", key, zipped.alias("z")).select("_p", key, F.posexplode("z").alias("pos", "b"))
    d = d.select("_p", key, "pos", F.col("b")["t"].alias("t"), *[F.col("b")[c].alias(c) for c in ("open", "high", "low", "close")], F.coalesce(F.col("b")["volume"], F.lit(0.0)).alias("volume")).dropna(subset=["open", "high", "low", "close"])
    if drop_last:
        last = d.groupBy("_p").agg(F.max("pos").alias("_last"))
        d = d.join(last, "_p").filter("pos < _last")
    return d.select(key, F.timestamp_seconds("t").alias("bar_start"), "open", "high", "low", "close", "volume")


def feed_items(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """title, link, guid, published_raw, published_at, description, dedup_key of the items of RSS and of Atom files.

    Items without a title, or with a time that can't be read, are left out. zone: see published_at().
    """
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)
    rss = rss.select("title", "link", "guid", F.col("pubDate").alias("published_raw"), "description")
    atom = spark.read.format("xml").option("rowTag", "entry").schema("title string, link array<struct<_href:string,_rel:string>>, id string, published string, updated string, summary string").load(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select("title", F.get(own, F.lit(0))["_href"].alias("link"), F.col("id").alias("guid"), F.coalesce("published", "updated").alias("published_raw"), F.col("summary").alias("description"))
    d = rss.unionByName(atom).filter("trim(title) <> ''").withColumn("title", F.trim("title"))
    at = published_at(F.col("published_raw"), zone)
    return d.withColumns({"published_at": at, "dedup_key": item_key(F.col("guid"), F.col("link"), F.col("title"), F.col("published_raw"), F.col("description"))}).filter("published_at is not null")


def fundamentals_csv(spark: SparkSession, path: str, instruments: DataFrame) -> DataFrame:
    """Fundamentals of known tickers (in any case); blanks are null."""
    columns = ("ticker", "as_of_date", "period", "pe", "pb", "roe", "debt_equity", "revenue_yoy")
    raw = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    known = instruments.select(F.col("ticker").alias("_t"), "instrument_id")
    d = raw.join(known, F.lower(F.trim("ticker")) == F.lower("_t"))
    return d.select("instrument_id", F.to_date("as_of_date").alias("as_of_date"), "period", *[F.col(c).try_cast("double").alias(c) for c in columns[3:]])


def settings(path: str) -> dict[str, Any]:
    """A YAML file of settings or a strategy; needs the yaml package."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def synthetic_bars(spark: SparkSession, tickers: list[str], days: int, base: float = 100.0, drift: float = 0.0005, start: date = date(2015, 1, 1)) -> DataFrame:
    """Made-up bars of weekdays: a trend times waves whose phase comes from the ticker's hash. Each day follows from its number alone."""
    weekdays, day = [], start
    while len(weekdays) < days:
        if day.weekday() < 5:
            weekdays.append(day)
        day += timedelta(days=1)
    seeds = [(t, int(sha256(t.encode()).hexdigest()[:8], 16) % 1_000 / 1_000 * 2 * math.pi) for t in tickers]
    d = spark.createDataFrame(seeds, "ticker string, phase double").join(spark.createDataFrame(list(enumerate(weekdays)), "i int, date date"))
    close = F.lit(base) * F.pow(F.lit(1 + drift), "i") * (1 + 0.03 * F.sin(F.col("i") / 20 + F.col("phase")) + 0.01 * F.cos(F.col("i") / 7 + F.col("phase")))
    d = d.withColumn("close", F.round(close, 4))
    return d.select("ticker", "date", F.round(F.col("close") * 0.999, 4).alias("open"), F.round(F.col("close") * 1.01, 4).alias("high"), F.round(F.col("close") * 0.99, 4).alias("low"), "close", (F.lit(100_000.0) + F.col("i") % 50 * 1_000).alias("volume"))


def demo_bars(names: DataFrame, days: int, start: date = date(2015, 1, 1)) -> DataFrame:
    """ticker, date, open, high, low, close, volume of made-up bars on the first weekdays from start, for names (ticker, is_index).

    A price follows from the one before: it grows by a drift, and waves whose phase is the ticker's hash move it; it
    never falls under 1. Each ticker's prices are one fold over its days, so tickers are parallel.
    """
    # Bases and drifts by the hash, waves, spreads and volumes.
    seed = F.conv(F.right(F.sha2("ticker", 256), F.lit(8)), 16, 10).cast("long")
    every = F.sequence(F.lit(0), F.lit(days * 7 // 5 + 7))
    weekdays = F.slice(F.filter(every, lambda i: F.weekday(F.date_add(F.lit(start), i)) < 5), 1, days)
    d = names.filter("ticker is not null").select("ticker", seed.alias("seed"), F.when(F.col("is_index"), 2000.0).otherwise(100.0 + seed % 80).alias("base"), weekdays.alias("days"))
    drift = 0.0004 + F.col("seed") % 7 * 0.00005

    def after(price: Column, i: Column) -> Column:
        noise = F.sin((F.col("seed") % 1000 + i) / 17.0) * 0.4 + F.cos((F.col("seed") % 333 + i) / 9.0) * 0.3
        return F.greatest(F.lit(1.0), price * (1 + drift) + noise * 0.05 * F.col("base") / 100.0)

    prices = F.aggregate("days", F.array(F.col("base")), lambda done, i: F.concat(done, F.array(after(F.element_at(done, -1), i))))
    rows = d.select("ticker", F.explode(F.arrays_zip(F.col("days").alias("i"), F.slice(prices, 2, days).alias("price"))).alias("x"))
    p = lambda k: F.round(F.col("x.price") * k, 4)
    return rows.select("ticker", F.date_add(F.lit(start), F.col("x.i")).alias("date"), p(0.998).alias("open"), p(1.012).alias("high"), p(0.988).alias("low"), p(1.0).alias("close"), (200_000 + F.col("x.i") % 60 * 3_000).cast("double").alias("volume"))
