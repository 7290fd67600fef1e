"""Whether a paper book may run, and whether a candidate strategy is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons for which a run is refused, in the order in which they are looked at.
REASONS = ("lag", "demo bars", "no prices", "stale", "coverage", "config changed", "too far behind")


def sessions_after(days: DataFrame, asked: DataFrame) -> DataFrame:
    """date, n for each distinct date of asked: how many of the distinct days come after it. The window holds a row for each day."""
    d = days.select("date").distinct().withColumn("_one", F.lit(1)).join(asked.select("date").distinct().withColumn("_asked", F.lit(True)), "date", "full")
    later = F.sum(F.coalesce("_one", F.lit(0))).over(Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("n", F.coalesce(later, F.lit(0)).cast("long")).filter(F.col("_asked") & F.col("date").isNotNull()).select("date", "n")


def paper_gate(prices: DataFrame, instruments: DataFrame, state: DataFrame, today: Column, config_hash: str, lag: int = 1, max_age: int = 4, least_coverage: float = 0.5, max_sessions: int = 10, window: int = 15, replay: bool = False, accept_change: bool = False) -> DataFrame:
    """One row for each book of state: latest session, what was measured, reason (null: it may run) and sessions to do.

    prices: instrument_id, date, source. instruments: instrument_id, delisted_on. state: user_id, config_hash,
    last_settled_date (null: not begun). Coverage is the share of instruments with a bar in the last window sessions, and
    not delisted, that have one on the latest session. A replay of an older session isn't stale; a changed configuration
    may be accepted. A book with nothing to settle has 0 sessions to do and no reason: it is left as it is.
    """
    days = prices.select("date").distinct()
    last = prices.agg(F.max("date").alias("latest"), F.count_if(F.col("source") == "demo").alias("demo")).first()
    start = days.orderBy(F.desc("date")).limit(window).agg(F.min("date").alias("d")).first()["d"]
    latest = F.lit(last["latest"]).cast("date")
    recent = prices.filter(F.col("date") >= F.lit(start)).select("instrument_id", "date").join(instruments.select("instrument_id", "delisted_on"), "instrument_id")
    active = recent.filter(F.col("delisted_on").isNull() | (F.col("delisted_on") >= latest))
    cover = active.groupBy("instrument_id").agg(F.max(F.col("date") == latest).alias("has")).agg(F.count_if("has").alias("with_bar"), F.count(F.lit(1)).alias("active")).first()
    behind = sessions_after(days, state.select(F.col("last_settled_date").alias("date"))).withColumnRenamed("date", "last_settled_date")
    to_do = F.when(F.col("last_settled_date").isNull(), F.lit(int(last["latest"] is not None))).otherwise(F.coalesce("n", F.lit(0)))
    d = state.join(behind, "last_settled_date", "left").withColumns({"latest": latest, "sessions": to_do.cast("long"), "age": F.date_diff(today, latest), "with_bar": F.lit(cover["with_bar"]), "active": F.lit(cover["active"])})
    covered = cover["active"] and cover["with_bar"] / cover["active"] >= least_coverage
    bad = [F.lit(lag != 1), F.lit(last["demo"] > 0), latest.isNull(), (F.col("age") > max_age) & F.lit(not replay), F.lit(not covered), F.coalesce(F.col("config_hash") != config_hash, F.lit(False)) & F.lit(not accept_change), F.col("sessions") > max_sessions]
    reason = F.coalesce(*[F.when(b, F.lit(name)) for b, name in zip(bad, REASONS, strict=True)])
    return d.select("user_id", "latest", "age", "with_bar", "active", "sessions", reason.alias("reason"))


MEASURES = ("cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return", "n_trades")


def compared(metrics: DataFrame, baseline: str, floors: dict[str, float] | None = None) -> DataFrame:
    """Each run of metrics (run_id, MEASURES, dsr, percentile) against the baseline: differences, better, notes, accepted.

    Better: a larger Sharpe ratio, and neither Sortino ratio nor drawdown worse. Accepted: better, and dsr and percentile
    at or above floors (min_dsr, min_random_percentile). A missing value, or a floor that isn't given, refuses.
    """
    base = metrics.filter(F.col("run_id") == baseline).first()
    d = metrics.filter(F.col("run_id") != baseline)
    d = d.withColumns({f"d_{c}": F.coalesce(c, F.lit(0)) - F.lit(float((base and base[c]) or 0)) for c in MEASURES})
    better = (F.col("d_sharpe") > 0) & (F.col("d_sortino") >= 0) & (F.col("d_max_drawdown") >= 0)
    floors = floors or {}
    if {"min_dsr", "min_random_percentile"} <= set(floors):
        least = {"dsr": floors["min_dsr"], "percentile": floors["min_random_percentile"]}
        notes = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")).when(F.col(c) < x, F.lit(f"{c} under {x:.2f}")) for c, x in least.items()]
    else:
        notes = [F.lit("floors missing")]
    d = d.withColumns({"better": better, "notes": F.concat_ws("; ", *notes)})
    return d.withColumn("accepted", F.col("better") & (F.col("notes") == ""))
