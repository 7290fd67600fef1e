"""Which instruments may be traded on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alive(date: str = "date", since: str | None = None, until: str = "delisted_on") -> Column:
    """Is a date between the first and last day of listing? Null bounds are open."""
    after = F.coalesce(F.col(date) >= F.col(since), F.lit(True)) if since else F.lit(True)
    return after & F.coalesce(F.col(date) <= F.col(until), F.lit(True))


def members(d: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of d whose ticker is in a range of membership on their date (both ends inclusive, null end open)."""
    r = ranges.withColumnRenamed("ticker", "_t")
    return d.join(r, (F.col("ticker") == F.col("_t")) & (F.col("date") >= F.col("date_from")) & (F.col("date_to").isNull() | (F.col("date") <= F.col("date_to"))), "left_semi")


def whitelist(d: DataFrame, names: DataFrame | None) -> DataFrame:
    """d, or with names only its tickers among them."""
    return d if names is None else d.join(names.select("ticker"), "ticker", "left_semi")


def entry_gate(floor: float, fresh: Column | None = None, turnover: str = "turnover_med_63") -> Column:
    """May a position be opened? Turnover must reach the floor; unknown turnover does only if there is no floor."""
    ok = F.coalesce(F.col(turnover) >= F.lit(float(floor)), F.lit(floor <= 0))
    return ok & fresh if fresh is not None else ok


def random_entries(features: DataFrame, instruments: DataFrame, calendar: DataFrame, floor: float) -> DataFrame:
    """ticker, date, ok for every session from an instrument's first to its last bar: may a random entry be signalled?

    It may where the instrument is listed, has a bar on the day and on the next session, a positive atr and enough
    turnover; never on the last session. Sessions are numbered, so the next one is a join key and no grid of all dates
    and instruments is needed: days without a bar can't be entries anyway.
    """
    d = features.join(calendar, "date").join(instruments.select("ticker", "delisted_on"), "ticker")
    w = Window.partitionBy("ticker").orderBy("session")
    follows = F.coalesce(F.lead("session").over(w) == F.col("session") + 1, F.lit(False))
    ok = alive() & follows & F.coalesce(F.col("atr") > 0, F.lit(False)) & entry_gate(floor)
    return d.select("ticker", "date", "session", ok.alias("ok"))


def coverage(bars: DataFrame, calendar: DataFrame, rows: int = 15) -> DataFrame:
    """date, active, present, coverage: of the instruments with a bar in the last rows sessions, how many have one today.

    Each bar makes its instrument active for rows sessions; overlapping spans of an instrument count once.
    """
    d = bars.select("ticker", "date").join(calendar, "date")
    spread = d.select("ticker", F.explode(F.sequence(F.col("session"), F.col("session") + rows - 1)).alias("session")).distinct()
    active = spread.groupBy("session").agg(F.count(F.lit(1)).alias("active"))
    present = d.groupBy("date", "session").agg(F.count_distinct("ticker").alias("present"))
    return present.join(active, "session").select("date", "active", "present", (F.col("present") / F.col("active")).alias("coverage"))


def first_new(found: DataFrame, curated: DataFrame, most: int) -> DataFrame:
    """Of found (ticker, first_at) all curated tickers and the first most others."""
    known = found.join(curated.select("ticker"), "ticker", "left_semi")
    others = found.join(curated.select("ticker"), "ticker", "left_anti").orderBy("first_at", "ticker").limit(most)
    return known.unionByName(others)


def price_scan(prices: DataFrame, instruments: DataFrame) -> DataFrame:
    """Raw bars of all instruments that are no index."""
    own = instruments.filter(~F.coalesce("is_index", F.lit(False))).select("instrument_id")
    return prices.filter(~F.col("adjusted")).join(own, "instrument_id", "left_semi")


def prices_asof(prices: DataFrame, instrument_id: int, as_of: Column, adjusted: bool = False) -> DataFrame:
    """Bars of an instrument that were known by as_of; the filters reach the files."""
    return prices.filter((F.col("instrument_id") == instrument_id) & (F.col("adjusted") == adjusted) & (F.col("as_of_date") <= as_of))


def close_series(prices: DataFrame, instruments: DataFrame, ticker: str) -> DataFrame:
    """date, close of a ticker's raw bars; no row for an unknown one."""
    return prices.filter(~F.col("adjusted")).join(instruments.filter(F.col("ticker") == ticker).select("instrument_id"), "instrument_id", "left_semi").select("date", "close")


def of_mode(bars: DataFrame, whitelist: DataFrame, mode: str) -> DataFrame:
    """Bars of the listed tickers (mode config) or of all (full)."""
    if mode not in ("config", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    return bars if mode == "full" else bars.join(whitelist.select("ticker"), "ticker", "left_semi")
