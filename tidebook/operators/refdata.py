"""Reference data: adjusted series and stored tables that are merged by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import price_factor
from .features import own, previous_valid_close
from .quality import next_session


def back_adjusted(bars: DataFrame, actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """bars with prices before each ex-date times the factors of all later actions; volumes go the other way for splits only.

    Factors stand on the bar at or after their session, and a running product from the last bar back carries them to
    earlier bars: one window for each instrument instead of a range join.
    """
    at = next_session(actions, sessions).select("ticker", "date", "action_type", "value_or_ratio")
    u = bars.select("ticker", "date", F.col("date").alias("own")).unionByName(at.select("ticker", "date", F.lit(None).cast("date").alias("own")).distinct())
    after = F.min("own").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(0, Window.unboundedFollowing))
    bar_of = u.groupBy("ticker", "date").agg(F.max("own").alias("own")).withColumn("bar", after).select("ticker", "date", "bar")
    closes = previous_valid_close(bars).select("ticker", F.col("date").alias("bar"), "prev_close")
    f = at.join(bar_of, ["ticker", "date"]).join(closes, ["ticker", "bar"])
    price = price_factor(F.col("action_type"), F.col("value_or_ratio"), F.col("prev_close"))
    split = F.when(F.col("action_type") == "split", F.col("value_or_ratio")).otherwise(1.0)
    by_bar = f.groupBy("ticker", F.col("bar").alias("date")).agg(F.product(price).alias("_p"), F.product(split).alias("_s"))
    later = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    d = bars.join(by_bar, ["ticker", "date"], "left")
    run = lambda c: F.coalesce(F.product(F.coalesce(F.col(c), F.lit(1.0))).over(later), F.lit(1.0))
    d = d.withColumns({"_fp": run("_p"), "_fs": run("_s")})
    return d.select("ticker", "date", *[(F.col(c) * F.col("_fp")).alias(c) for c in ("open", "high", "low", "close")], (F.col("volume") * F.col("_fs")).alias("volume"))


def upsert(base: DataFrame, updates: DataFrame, key: list[str], newest: Column | None = None) -> DataFrame:
    """base with the rows of updates: those with a key of base replace it; of several updates of a key the one of largest newest stays."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_turn"), *([newest.desc()] if newest is not None else [])))
    u = base.withColumn("_turn", F.lit(0)).unionByName(updates.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return u.withColumn("_rank", rank).filter("_rank = 1").drop("_turn", "_rank")


def insert_new(base: DataFrame, updates: DataFrame, key: list[str], first: Column) -> DataFrame:
    """The rows of updates to append: of each key that base lacks, the one of least first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(first))
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    fresh = updates.alias("u").join(base.select(*key).alias("b"), reduce(lambda a, b: a & b, same), "left_anti")
    return fresh.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def valid_actions(actions: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) actions: of a known kind, a positive value and a known ticker, or with what is wrong in reason."""
    d = actions.join(instruments.select("ticker").distinct().withColumn("_known", F.lit(True)), "ticker", "left")
    reason = F.when(~F.coalesce(F.col("action_type").isin("split", "dividend", "rights_issue"), F.lit(False)), "kind").when(~F.coalesce(F.col("value_or_ratio") > 0, F.lit(False)), "value").when(F.col("_known").isNull(), "ticker")
    d = d.withColumn("reason", reason).drop("_known")
    return d.filter("reason is null").drop("reason"), d.filter("reason is not null")


def first_bar(bars: DataFrame) -> DataFrame:
    return bars.withColumn("n", F.row_number().over(own())).filter("n = 1").drop("n")
