"""Conditions that must hold before anything is written or decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exists(d: DataFrame) -> bool:
    return not d.isEmpty()


def one_kind_of_source(prices: DataFrame, new_source: str, demo: str = "demo") -> None:
    """Raises if made-up and real bars would stand in one table."""
    other = prices.filter((F.col("source") == demo) != F.lit(new_source == demo))
    if exists(other):
        raise ValueError(f"bars of {new_source!r} would mix with {other.select('source').first()[0]!r}")


def ingest_end(now: Column, hour: int = 18) -> Column:
    """Today once the session's data are there, else yesterday."""
    return F.when(F.hour(now) >= hour, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))


def in_session(at: Column, days: list[int], start: str, end: str) -> Column:
    """Is a local time on one of the days (Monday: 0) and within the hours, both ends included?"""
    return F.weekday(at).isin(*days) & F.date_format(at, "HH:mm").between(start, end)


def known_decisions(overrides: DataFrame, decisions: DataFrame) -> DataFrame:
    """Overrides of decisions that exist."""
    return overrides.join(decisions.select(F.col("id").alias("decision_id")), "decision_id", "left_semi")


def purge(prices: DataFrame, derived: dict[str, DataFrame], demo: str = "demo") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Prices without made-up bars; what is derived from them goes too, unless real bars are there."""
    real = prices.filter(F.col("source") != demo)
    return real, derived if exists(real) else {k: d.limit(0) for k, d in derived.items()}


def alerts(positions: DataFrame, bars: DataFrame, near: float, sent: DataFrame) -> DataFrame:
    """position_id, session_date, state of open positions whose newest bar of the day is at or near the stop, once a day and state.

    positions: position_id, instrument_id, stop_price, session_date. bars: instrument_id, bar_start, close.
    """
    newest = bars.groupBy("instrument_id").agg(F.max("bar_start").alias("at"), F.max_by("close", "bar_start").alias("close"))
    d = positions.join(newest, "instrument_id").filter(F.to_date("at") == F.col("session_date"))
    state = F.when(F.col("close") <= F.col("stop_price"), "BREACH").when(F.col("close") <= F.col("stop_price") * (1 + near), "NEAR")
    found = d.withColumn("state", state).filter("state is not null").select("position_id", "session_date", "state")
    return found.join(sent, ["position_id", "session_date", "state"], "left_anti")


def health(state: DataFrame, at: Column, ok: bool, message: str) -> DataFrame:
    """The collector's row after a cycle: an error leaves the last success as it is."""
    mark = F.when(F.lit(ok), at)
    fail = F.when(F.lit(not ok), at)
    one = state.sparkSession.range(1).select(F.lit(1).alias("id"))
    return one.join(state, "id", "left").select("id", F.coalesce(mark, "last_success").alias("last_success"), F.coalesce(fail, "last_error").alias("last_error"), F.lit(message).alias("message"))


def first_reports(filings: DataFrame, stored: DataFrame) -> DataFrame:
    """Filings that aren't repeats: of equal (isin, report_no, kind) the earliest, and none that is stored; an incomplete key never repeats."""
    key = ["isin", "report_no", "kind"]
    whole = F.col("isin").isNotNull() & F.col("report_no").isNotNull() & F.col("kind").isNotNull()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("published_at", "filing_id"))
    full = filings.filter(whole).withColumn("_rank", rank).filter("_rank = 1").drop("_rank").join(stored.select(*key), key, "left_anti")
    return full.unionByName(filings.filter(~whole))
