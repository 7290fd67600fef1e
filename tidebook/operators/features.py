"""Rolling features of bars. Frames count an instrument's own rows; a value needs a full frame of non-null inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows in a month, a quarter, half a year and a year; of the averages; of the true range; of volatility and turnover.
HORIZONS = {"ret_1m": 21, "ret_3m": 63, "ret_6m": 126, "ret_12m": 252}
AVERAGES = (50, 200)
ATR_ROWS, VOL_ROWS, TURNOVER_ROWS, SESSIONS_A_YEAR = 14, 21, 63, 252


def own() -> WindowSpec:
    """An instrument's rows by date."""
    return Window.partitionBy("ticker").orderBy("date")


def frame(rows: int) -> WindowSpec:
    return own().rowsBetween(-(rows - 1), 0)


def full(value: Column, of: Column, rows: int) -> Column:
    """value if all rows of the frame have of."""
    return F.when(F.count(of).over(frame(rows)) == rows, value)


def change(x: Column, rows: int) -> Column:
    """x against its value so many rows before; null without one, and where that is 0."""
    return F.try_divide(x, F.lag(x, rows).over(own())) - 1


def mean(x: Column, rows: int) -> Column:
    return full(F.avg(x).over(frame(rows)), x, rows)


def true_range() -> Column:
    """The largest of the day's range and the moves from the close before; on the first row the range."""
    before = F.lag("close").over(own())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def returns(bars: DataFrame) -> DataFrame:
    """bars with a return for each horizon, and momentum_6m, which is ret_6m."""
    d = bars.withColumns({name: change(F.col("close"), rows) for name, rows in HORIZONS.items()})
    return d.withColumn("momentum_6m", F.col("ret_6m"))


def averages(bars: DataFrame) -> DataFrame:
    """bars with sma50, sma200 and the close's distance from them."""
    d = bars.withColumns({f"sma{n}": mean(F.col("close"), n) for n in AVERAGES})
    return d.withColumns({f"close_vs_sma{n}": F.try_divide("close", f"sma{n}") - 1 for n in AVERAGES})


def atr(bars: DataFrame) -> DataFrame:
    """bars with atr: the plain mean of the true range."""
    return bars.withColumn("_tr", true_range()).withColumn("atr", mean(F.col("_tr"), ATR_ROWS)).drop("_tr")


def volatility(bars: DataFrame) -> DataFrame:
    """bars with realized_vol: the sample deviation of daily returns, for a year."""
    d = bars.withColumn("_r", change(F.col("close"), 1))
    return d.withColumn("realized_vol", full(F.stddev_samp("_r").over(frame(VOL_ROWS)), F.col("_r"), VOL_ROWS) * F.sqrt(F.lit(float(SESSIONS_A_YEAR)))).drop("_r")


def turnover(bars: DataFrame) -> DataFrame:
    """bars with turnover_med_63: the median of price times volume."""
    d = bars.withColumn("_v", F.col("close") * F.col("volume"))
    return d.withColumn("turnover_med_63", full(F.percentile("_v", F.lit(0.5)).over(frame(TURNOVER_ROWS)), F.col("_v"), TURNOVER_ROWS)).drop("_v")


def relative_strength(bars: DataFrame, index: DataFrame) -> DataFrame:
    """bars (with ret_6m) and rel_strength_6m: ret_6m less that of the index, carried forward over the instrument's dates."""
    d = bars.join(index.select("date", F.col("close").alias("_index")), "date", "left")
    d = d.withColumn("_index", F.last("_index", ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("rel_strength_6m", F.col("ret_6m") - change(F.col("_index"), HORIZONS["ret_6m"])).drop("_index")


def panel(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """All features of every bar. Without an index rel_strength_6m is null."""
    d = turnover(volatility(atr(averages(returns(bars)))))
    return relative_strength(d, index) if index is not None else d.withColumn("rel_strength_6m", F.lit(None).cast("double"))


def previous_valid_close(bars: DataFrame) -> DataFrame:
    """bars with prev_close: the last close before the row that is neither null nor 0."""
    return bars.withColumn("prev_close", F.last(F.nullif("close", F.lit(0.0)), ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, -1)))


def calendar(bars: DataFrame) -> DataFrame:
    """date and session (from 0) of every date with a bar. A calendar has a row for each day ever traded, so one task numbers it."""
    return bars.select("date").distinct().withColumn("session", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))
