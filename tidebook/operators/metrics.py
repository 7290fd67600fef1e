"""Measures of equity curves, trades, trials and classifications."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from .records import numbered

EULER_GAMMA = 0.5772156649015329


def steps(curves: DataFrame) -> DataFrame:
    """curves (run_id, date, equity) with ret, peak and drawdown."""
    w = Window.partitionBy("run_id").orderBy("date")
    d = curves.withColumn("ret", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    d = d.withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("drawdown", F.try_divide("equity", "peak") - 1)


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def curve_metrics(curves: DataFrame) -> DataFrame:
    """cagr, sharpe, sortino, max_drawdown, calmar, total_return, mean_equity, n of each run.

    Ratios are for a year, by the curve's own number of rows a year (252 if it spans no time). Sortino divides by the
    deviation of the negative returns only. A ratio whose divisor is 0 or undefined is 0.
    """
    down = F.when(F.col("ret") < 0, F.col("ret"))
    a = steps(curves).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("since"),
        F.max("date").alias("until"),
        F.min_by("equity", "date").alias("first"),
        F.max_by("equity", "date").alias("last"),
        F.avg("equity").alias("mean_equity"),
        F.avg("ret").alias("mean"),
        F.stddev_pop("ret").alias("dev"),
        F.stddev_pop(down).alias("dev_down"),
        F.min("drawdown").alias("max_drawdown"),
    )
    years = F.datediff("until", "since") / 365.25
    scale = F.sqrt(F.when(years > 0, F.col("n") / years).otherwise(252.0))
    a = a.withColumn("total_return", F.when(F.col("n") > 1, _or_zero(F.try_divide("last", "first") - 1)).otherwise(0.0))
    a = a.withColumn("cagr", F.when((F.col("n") > 1) & (F.col("first") > 0) & (years > 0) & (F.col("last") >= 0), F.pow(F.try_divide("last", "first"), 1 / F.nullif(years, F.lit(0.0))) - 1).otherwise(0.0))
    a = a.withColumns({"sharpe": _or_zero(scale * F.try_divide("mean", "dev")), "sortino": _or_zero(scale * F.try_divide("mean", "dev_down"))})
    a = a.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0))
    return a.select("run_id", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "total_return", "mean_equity", "n")


def trade_metrics(pnls: DataFrame) -> DataFrame:
    """win_rate, profit_factor (infinite with gains and no loss), n_trades of each run (run_id, pnl)."""
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(0.0))
    factor = F.when(loss != 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)
    return pnls.groupBy("run_id").agg((F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"), factor.alias("profit_factor"), F.count(F.lit(1)).alias("n_trades"))


def moments(curves: DataFrame) -> DataFrame:
    """n_obs, sharpe_pp (of a period), skew and kurtosis (bias-corrected; kurtosis is not the excess) of each run's returns."""
    r = steps(curves).filter("ret is not null")
    a = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_obs"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("dev"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    n = F.col("n_obs")
    skew = F.when((n > 2) & F.col("g1").isNotNull() & ~F.isnan("g1"), F.col("g1") * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))).otherwise(0.0)
    excess = (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1.0) * F.col("g2") + 6.0)
    kurt = F.when((n > 3) & F.col("g2").isNotNull() & ~F.isnan("g2"), excess + 3.0).otherwise(3.0)
    return a.select("run_id", "n_obs", F.when(n >= 2, _or_zero(F.try_divide("mean", "dev"))).otherwise(0.0).alias("sharpe_pp"), skew.alias("skew"), kurt.alias("kurtosis"))


def expected_max_sharpe(trials: Column, variance: Column) -> Column:
    """What the best of so many trials without skill would show; 0 for one trial or equal ones."""
    n = F.greatest(trials, F.lit(2)).cast("double")
    best = (1 - EULER_GAMMA) * normal.quantile(1 - 1 / n) + EULER_GAMMA * normal.quantile(1 - 1 / (n * math.e))
    return F.when((trials > 1) & (variance > 0), F.sqrt(variance) * best).otherwise(0.0)


def probabilistic_sharpe(sharpe_pp: Column, bar: Column, n_obs: Column, skew: Column, kurtosis: Column) -> Column:
    """The chance that the true Sharpe ratio of a period is above bar."""
    spread = 1 - skew * sharpe_pp + (kurtosis - 1) / 4 * sharpe_pp * sharpe_pp
    z = (sharpe_pp - bar) * F.sqrt(F.greatest(n_obs - 1.0, F.lit(0.0))) / F.sqrt(F.greatest(spread, F.lit(1e-12)))
    return F.when(n_obs >= 2, normal.cdf(z)).otherwise(0.0)


def deflated_sharpe(curves: DataFrame, trials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """moments() of each run with sr_star and dsr, given how many configurations were tried and how their Sharpe ratios vary.

    trials: n_trials and variance, a row for each value of the columns by, which curves have too; one row without by.
    """
    m = moments(curves)
    if by:
        m = m.join(curves.select("run_id", *by).distinct(), "run_id").join(trials, list(by))
    else:
        m = m.join(F.broadcast(trials))  # one row
    bar = expected_max_sharpe(F.col("n_trials"), F.col("variance"))
    m = m.withColumn("sr_star", bar)
    return m.withColumn("dsr", probabilistic_sharpe(*map(F.col, ("sharpe_pp", "sr_star", "n_obs", "skew", "kurtosis"))))


def validated(curves: DataFrame, runs: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deflated_sharpe() of the runs out of sample, the registry of trials with theirs added).

    runs: run_id, config_hash, walk_forward_windows; a run without windows is in-sample: it isn't logged and has no dsr.
    stored: id, config_hash, metrics (JSON). New trials get the next ids in the order of run_ids.
    """
    out = curves.join(runs.filter("walk_forward_windows > 0").select("run_id", "config_hash"), "run_id")
    new = moments(out).join(runs.select("run_id", "config_hash"), "run_id").select("run_id", "config_hash", F.to_json(F.struct("sharpe_pp")).alias("metrics"))
    log = stored.select("id", "config_hash", "metrics").unionByName(numbered(stored, new, ["run_id"]).select("id", "config_hash", "metrics"))
    return deflated_sharpe(out, trial_stats(log)), log


def trial_stats(trials: DataFrame) -> DataFrame:
    """n_trials and variance (of the population) of sharpe_pp over the latest valid row of each config_hash (id, config_hash, metrics as JSON)."""
    value = F.try_variant_get(F.try_parse_json("metrics"), "$.sharpe_pp", "double")
    latest = trials.withColumn("v", value).filter(F.try_parse_json("metrics").isNotNull()).groupBy("config_hash").agg(F.max_by("v", "id").alias("v"))
    n = F.count("v")
    return latest.agg(F.count(F.lit(1)).alias("n_trials"), F.when(n >= 2, F.var_pop("v")).otherwise(0.0).alias("variance"))


def midrank(values: DataFrame, against: DataFrame, parts: int = 64) -> DataFrame:
    """values (id, x) with percentile: the share of against (y) below x, equal ones by half; 0.5 against nothing.

    Distinct values are dealt by cut points of against into parts, in each of which a window adds up; only the cut
    points and a total for each part pass through the driver. Nothing is compared pair by pair or sorted in one task.
    """
    cuts = sorted(set(against.agg(F.percentile_approx("y", [k / parts for k in range(1, parts)], 1_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("x"))) if cuts else F.lit(0)
    u = values.select("x", F.lit(0).alias("own")).unionByName(against.select(F.col("y").alias("x"), F.lit(1).alias("own")))
    d = u.groupBy("x").agg(F.sum("own").alias("equal")).withColumn("part", part)
    totals, below = {r["part"]: r["n"] for r in d.groupBy("part").agg(F.sum("equal").alias("n")).collect()}, 0
    starts = []
    for k in sorted(totals):
        starts.append((k, below))
        below += totals[k]
    if not below:
        return values.select("id", "x", F.lit(0.5).alias("percentile"))
    at = values.sparkSession.createDataFrame(starts, "part int, start long")
    w = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(at), "part").withColumn("below", F.col("start") + F.sum("equal").over(w) - F.col("equal"))
    return values.join(d, "x").select("id", "x", ((F.col("below") + 0.5 * F.col("equal")) / below).alias("percentile"))


def per_class(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """label, precision, recall, f1 for each class of pairs (truth, pred); a null prediction is wrong."""
    each = pairs.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"), "truth", "pred")
    t, p = F.col("truth") == F.col("label"), F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    a = each.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(p).alias("np"), F.count_if(t).alias("nt"))
    precision, recall = _or_zero(F.try_divide("tp", "np")), _or_zero(F.try_divide("tp", "nt"))
    return a.select("label", precision.alias("precision"), recall.alias("recall"), _or_zero(F.try_divide(2.0 * F.col("tp"), F.col("np") + F.col("nt"))).alias("f1"))


def walk_forward(calendar: list, in_months: int = 24, out_months: int = 6, embargo: int = 252) -> list[tuple]:
    """(in start, in end, out start, out end) of rolling windows over a sorted list of dates.

    A window's out part starts embargo sessions after the first session at or after the end of its in part; windows
    move by the length of an out part and end with the calendar. The calendar is one row for each day ever traded.
    """
    from bisect import bisect_left

    import pandas as pd

    out: list[tuple] = []
    if not calendar:
        return out
    start, final = pd.Timestamp(calendar[0]), pd.Timestamp(calendar[-1])
    while True:
        end = start + pd.DateOffset(months=in_months)
        at = bisect_left(calendar, end.date()) + embargo
        if at >= len(calendar):
            return out
        begin = pd.Timestamp(calendar[at])
        stop = begin + pd.DateOffset(months=out_months)
        out.append((start.date(), end.date(), begin.date(), min(stop, final).date()))
        if stop >= final:
            return out
        start += pd.DateOffset(months=out_months)
