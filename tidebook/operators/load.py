"""Loads of market files: rows of sessions matched with a universe, instruments, membership and reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import numbered
from .refdata import back_adjusted, valid_actions


def index_isin(rows: DataFrame, name: str, near: Column, back: int = 14) -> DataFrame:
    """isin of an index (name in any case) in the newest session of rows (date, name, isin) of the back days up to near.

    No row if that session doesn't have it, though an older one may: the newest file decides.
    """
    recent = rows.filter((F.col("date") <= near) & (F.col("date") > F.date_sub(near, back)))
    last = recent.agg(F.max("date").alias("date"))
    return recent.join(F.broadcast(last), "date").filter(F.lower("name") == name.lower()).agg(F.min("isin").alias("isin")).filter("isin is not null")


def matched(rows: DataFrame, universe: DataFrame, full_market: bool = False, currency: str = "PLN") -> DataFrame:
    """Session rows (date, isin, name, currency, ...) of the currency with ticker, that of the universe's isin.

    With full_market rows of other isins stay too, under the isin in small letters.
    """
    own = universe.filter("isin is not null").groupBy(F.upper("isin").alias("_isin")).agg(F.min("ticker").alias("_ticker"))
    d = rows.filter(F.col("currency") == currency).join(own, F.upper("isin") == F.col("_isin"), "left")
    found = d.withColumn("ticker", F.coalesce("_ticker", F.lower("isin")) if full_market else F.col("_ticker")).drop("_isin", "_ticker")
    return found.filter("ticker is not null")


def absences(rows: DataFrame, universe: DataFrame, start: Column, end: Column) -> DataFrame:
    """ticker, reason of entries of the universe without a row from start to end: no isin, or not in any file.

    Entries that were delisted before start or listed after end aren't expected; without any session nothing is said.
    """
    inside = rows.filter(F.col("date").between(start, end))
    nameless = universe.filter("isin is null").select("ticker", F.lit("no isin").alias("reason"))
    if inside.isEmpty():
        return nameless
    seen = inside.select(F.upper("isin").alias("_isin")).distinct()
    expected = universe.filter(F.col("isin").isNotNull() & ~F.coalesce(F.col("delisted_on") < start, F.lit(False)) & ~F.coalesce(F.col("listed_from") > end, F.lit(False)))
    missing = expected.join(seen, F.upper("isin") == F.col("_isin"), "left_anti")
    return nameless.unionByName(missing.select("ticker", F.lit("not in any file").alias("reason")))


def split_readable(rows: DataFrame, needed: list[str], by: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """(rows of files that could be read, a row with by and reason for each other one).

    A file's rows stay together: if a needed column of one of them is null, the whole file fails, and no other does.
    """
    bad = rows.groupBy(by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed])
    reason = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.lit(c)) for c in needed])
    failed = bad.select(by, reason.alias("reason")).filter("reason != ''")
    return rows.join(failed.select(by), by, "left_anti"), failed


def instruments(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """stored instruments (id, ticker, ...) with updates by ticker in any case: known ones keep id and ticker and take what
    an update says (nulls say nothing), new ones get the next ids in the order of tickers."""
    fields = [c for c in updates.columns if c != "ticker"]
    u = updates.groupBy(F.lower("ticker").alias("_key")).agg(F.min("ticker").alias("ticker"), *[F.max_by(c, "ticker").alias(c) for c in fields])
    s = stored.withColumn("_key", F.lower("ticker"))
    known = s.alias("s").join(u.alias("u"), "_key", "left").select(*[F.coalesce(F.col(f"u.{c}"), F.col(f"s.{c}")).alias(c) if c in fields else F.col(f"s.{c}") for c in stored.columns])
    fresh = u.join(s.select("_key"), "_key", "left_anti").select("ticker", *fields)
    return known.unionByName(numbered(stored, fresh, ["ticker"]), allowMissingColumns=True)


def membership(stored: DataFrame, given: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership with the given ranges in place of all those of the same indices, given rows of unknown tickers).

    given: index_name, ticker, date_from, date_to, source. Of rows with equal index, instrument and date_from one stays,
    that of the latest date_to, an open end being the latest.
    """
    g = given.withColumn("index_name", F.lower("index_name")).join(instruments.select(F.lower("ticker").alias("_key"), F.col("instrument_id")), F.lower("ticker") == F.col("_key"), "left").drop("_key")
    rank = F.row_number().over(Window.partitionBy("index_name", "instrument_id", "date_from").orderBy(F.desc_nulls_first("date_to"), "source"))
    good = g.filter("instrument_id is not null").withColumn("_rank", rank).filter("_rank = 1").select("index_name", "instrument_id", "date_from", "date_to", "source")
    replaced = given.select(F.lower("index_name").alias("index_name")).distinct()
    return stored.join(replaced, "index_name", "left_anti").unionByName(good), g.filter("instrument_id is null").drop("instrument_id")


def refdata(bars: DataFrame, actions: DataFrame, names: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adjusted bars, built anew from raw bars and the good actions, the bad actions with reasons): what stood before goes."""
    good, bad = valid_actions(actions, names)
    return back_adjusted(bars, good, sessions), bad


def relabelled(prices: DataFrame, stored_before: DataFrame, day: Column, demo: str = "demo") -> DataFrame:
    """prices (instrument_id, date, source) in which rows without a source are named: demo for instruments whose stored
    bars begin on a day that only made-up ones do, and unknown for the others."""
    made_up = stored_before.groupBy("instrument_id").agg(F.min("date").alias("_first")).filter(F.col("_first") == day).select("instrument_id")
    d = prices.join(made_up.withColumn("_made_up", F.lit(True)), "instrument_id", "left")
    return d.withColumn("source", F.coalesce("source", F.when(F.col("_made_up"), F.lit(demo)).otherwise("unknown"))).drop("_made_up")
