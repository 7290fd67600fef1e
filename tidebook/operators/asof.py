"""Joins with the last row on or before a date, by one union and one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, known: str, take: list[str], strict: bool = False) -> DataFrame:
    """left with the columns take of the last row of right whose known is at most at (below it if strict); else null.

    Both sides are shuffled once, by by; nothing is compared pair by pair. A null in the row that is found stays null:
    it doesn't let an older value show. Of rows of right with equal known the one with the largest values counts.
    """
    pick = F.struct(*[F.col(c) for c in take])
    r = right.groupBy(by, known).agg(F.max(pick).alias("_found")).select(F.col(by).alias("_by"), F.col(known).alias("_at"), F.lit(1 if strict else 0).alias("_turn"), "_found", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    l = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_turn"), F.lit(None).cast(r.schema["_found"].dataType).alias("_found"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    w = Window.partitionBy("_by").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    found = r.unionByName(l).withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_row is not null")
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def align(dates: DataFrame, series: DataFrame, by: str | None = None) -> DataFrame:
    """dates (by, date) with close of series (date, close): of the day, else the last one before, else the first one after."""
    d = dates.join(series.select("date", "close"), "date", "left")
    w = Window.partitionBy(*([by] if by else [F.lit(1)])).orderBy("date")
    back = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("close", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return d.withColumn("close", F.coalesce(back, ahead))


def session_by(d: DataFrame, column: str, sessions: DataFrame, name: str = "session") -> DataFrame:
    """d with name: the session (of sessions: date, session) of the last day at or before a column's date; null before the first.

    Only distinct dates are compared, so the one task that orders them holds a few rows for each day, however many d has.
    """
    dates = d.select(F.col(column).alias("_day")).filter("_day is not null").distinct().withColumn("_all", F.lit(1))
    known = sessions.select(F.lit(1).alias("_all"), F.col("date").alias("_known"), F.col("session").alias(name))
    found = asof(dates, known, "_all", "_day", "_known", [name]).select("_day", name)
    return d.join(found, d[column] == found["_day"], "left").drop("_day")
