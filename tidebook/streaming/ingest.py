"""Streams of filings and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import store_filings
from ..storage import scratch
from ..tables import Table


def drain(stream: DataFrame, name: str, mode: str = "append", folders: tuple[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; folders: of its output and its state, to go on from."""
    spark = stream.sparkSession
    out, state = folders or (scratch(spark, name), scratch(spark, f"{name}-state"))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def five_minute_bars(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Closed five-minute bars of a stream (ticker, ts, value, seq): ticker, bar_start, open, high, low, close, volume.

    A bar appears once no trade of it is expected any more; one that still forms never does.
    """
    order = F.struct("ts", "seq")
    d = trades.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes").alias("w"), "ticker")
    d = d.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume"))
    return d.select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def filings_stream(source: DataFrame, table: Table, name: str = "filings", state: str | None = None) -> None:
    """Drains a stream of filings (dedup_key, published_at, ...) into a table, first write wins.

    A batch reads the keys of the buckets that it touches, not the table; one that runs again changes nothing. state is the
    checkpoint's folder, which a later drain goes on from.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        store_filings(table, batch, (name, epoch))

    place = state or scratch(source.sparkSession, f"{name}-state")
    source.writeStream.foreachBatch(each).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
