"""Warnings of positions near or below their stops, over keyed state that a restart keeps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How near above its stop a price is worth a warning.
NEAR = 0.02
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "position_id long, day int, state string, price double, at long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile hold their state in RocksDB, which state by key needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Watch(StatefulProcessor):
    """Of the positions of a bucket: each one's session, its newest bar so far, and which states were warned of in it.

    A bar that isn't newer than one seen is passed over. The timer of a session goes off at midnight after it, once no bar
    of it is expected any more, and clears what is held of it. Each call on state or timers is a message to the JVM, which
    takes longer than a bar: so a bucket's positions are read and written together, once a batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "position_id long, at long, day int, ends long, warned string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, seen = self._read(), ["position_id", "day", "state"]
        d = pd.concat(list(rows), ignore_index=True)
        d = d[d["at"] > d["position_id"].map(old["at"]).fillna(-(2**63))]  # nothing seen: everything is newer
        d = d.sort_values(["position_id", "at"], kind="stable").drop_duplicates(["position_id", "at"])
        said = old["warned"].str.split().explode().dropna().rename("state").reset_index().join(old["day"], on="position_id")
        new = d[d["state"].notna()].drop_duplicates(seen)
        new = new[~pd.MultiIndex.from_frame(new[seen]).isin(pd.MultiIndex.from_frame(said[seen]))]
        last = d.drop_duplicates("position_id", keep="last").set_index("position_id")[["at", "day", "ends"]]
        held = pd.concat([old.drop(columns="warned")[~old.index.isin(last.index)], last]).astype({"at": "int64", "day": "int64", "ends": "int64"})
        told = pd.concat([said[seen], new[seen]]).join(held["day"].rename("now"), on="position_id")
        told = told[told["day"] == told["now"]].groupby("position_id")["state"].agg(" ".join)
        self._write(held.join(told.rename("warned")).fillna({"warned": ""}))
        before, after = set(old["ends"].tolist()), set(held["ends"].tolist())
        for t in before - after:
            self.handle.deleteTimer(t)
        for t in after - before:
            self.handle.registerTimer(t)
        yield new.rename(columns={"close": "price"})[["position_id", "day", "state", "price", "at"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._read()
        stays = held[held["ends"] > timerValues.getCurrentWatermarkInMs()]  # what is older now comes too late for the stream anyway
        if len(stays) < len(held):  # the first timer of several that go off together clears for all
            self._write(stays)
        return iter(())

    def _read(self) -> pd.DataFrame:
        names = ["position_id", "at", "day", "ends", "warned"]
        return pd.DataFrame([tuple(r) for r in self.held.get()], columns=names).astype({c: "str" if c == "warned" else "int64" for c in names}).set_index("position_id")

    def _write(self, held: pd.DataFrame) -> None:
        if len(held):
            self.held.put(list(zip(*(held.reset_index()[c].tolist() for c in ("position_id", "at", "day", "ends", "warned")), strict=True)))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def judged(bars: DataFrame, positions: DataFrame, near: float = NEAR) -> DataFrame:
    """position_id, bar_start, close and state of each bar (instrument_id, bar_start, close) of a position with a stop.

    STOP_BREACH at or below the stop, NEAR_STOP up to the share near above it, else null.
    """
    held = positions.filter("status = 'OPEN' and stop_price is not null").select("position_id", "instrument_id", "stop_price")
    state = F.when(F.col("close") <= F.col("stop_price"), "STOP_BREACH").when(F.col("close") <= F.col("stop_price") * (1 + near), "NEAR_STOP")
    return bars.filter("close is not null").join(held, "instrument_id").select("position_id", "bar_start", "close", state.alias("state"))


def stop_warnings(bars: DataFrame, positions: DataFrame, near: float = NEAR, late: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """A stream of warnings: position_id, session_date, state, price, bar_start, one for a position, day and state.

    bars is a stream (instrument_id, bar_start, close), positions a table. Bars are compared in the order in which they come;
    a late one that is older than a position's newest bar says nothing, as nobody would look at it. Positions are spread
    over buckets by their id, and buckets over tasks; the number of buckets has to stay as it is while a stream goes on.
    Days are those of the Spark session's time zone, which is to be that of the exchange.
    """
    day = F.to_date("bar_start")
    ends = F.unix_millis(F.date_add(day, 1).cast("timestamp"))
    rows = judged(bars.withWatermark("bar_start", late), positions, near).withColumns({"at": F.unix_micros("bar_start"), "day": F.unix_date(day), "ends": ends})
    rows = rows.withColumns({"position_id": F.col("position_id").cast("long"), "bucket": F.pmod(F.xxhash64("position_id"), F.lit(buckets)).cast("int")})
    found = rows.groupBy("bucket").transformWithStateInPandas(Watch(), _OUT, "append", "eventTime")
    return found.select("position_id", F.date_from_unix_date("day").alias("session_date"), "state", "price", F.timestamp_micros("at").alias("bar_start"))


def warnings_of(bars: DataFrame, positions: DataFrame, near: float = NEAR) -> DataFrame:
    """The same warnings from a table of bars: of each position, day and state the first bar."""
    d = judged(bars, positions, near).filter("state is not null").withColumn("session_date", F.to_date("bar_start"))
    first = d.groupBy("position_id", "session_date", "state").agg(F.min_by(F.struct("close", "bar_start"), "bar_start").alias("x"))
    return first.select("position_id", "session_date", "state", F.col("x.close").alias("price"), "x.bar_start")
