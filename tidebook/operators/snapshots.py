"""Snapshots of stored tables: what they hold, which to keep, and whether one could stand in for what is there now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Table

DESCRIBED = "table string, columns array<string>, rows long"


def described(frames: dict[str, DataFrame]) -> DataFrame:
    """table, columns (sorted) and rows of each frame, in one plan.

    Of Parquet tables the counts read no column, only what the files' footers say, in tasks.
    """
    each = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.array(*map(F.lit, sorted(d.columns))).cast("array<string>").alias("columns"), "rows") for name, d in sorted(frames.items())]
    return reduce(DataFrame.unionByName, each)


def compared(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """table, rows_then, rows_now and wrong (null: nothing) of the tables of either description.

    A snapshot is older, so it may have fewer rows, but not more; it must have the same tables and all their columns.
    """
    a = snapshot.select("table", F.col("columns").alias("_a"), F.col("rows").alias("rows_then"))
    b = now.select("table", F.col("columns").alias("_b"), F.col("rows").alias("rows_now"))
    lost = F.array_sort(F.array_except("_b", "_a"))
    wrong = F.when(F.col("_a").isNull(), "not in the snapshot").when(F.col("_b").isNull(), "not known").when(F.size(lost) > 0, F.concat(F.lit("lacks "), F.array_join(lost, ", "))).when(F.col("rows_then") > F.col("rows_now"), "more rows than now")
    return a.join(b, "table", "full").select("table", "rows_then", "rows_now", wrong.alias("wrong"))


def log_table(spark, path: str) -> Table:
    """taken_at, table, version, columns, rows of all snapshots."""
    return Table(spark, path, ["taken_at", "table"], by=["taken_at"], buckets=4)


def take(log: Table, tables: dict[str, Table], at: Column) -> None:
    """Logs the newest version of each stored table: its files never change, so naming them is the snapshot. A table that
    has no version yet isn't in it."""
    frames, versions = {}, {}
    for name, t in tables.items():
        m = t.manifest()
        if m:
            versions[name], frames[name] = m["version"], t.read(m["version"])
    if frames:
        version = F.create_map(*[F.lit(x) for name, v in versions.items() for x in (name, v)])[F.col("table")]
        log.replace(described(frames).select(at.cast("timestamp").alias("taken_at"), "table", version.alias("version"), "columns", "rows"))


def kept(days: DataFrame, daily: int = 14, monthly: int = 12, day: str = "day") -> DataFrame:
    """Of days with a snapshot those to keep: the newest ones, and the first of each of the newest months that have one."""
    d = days.select(day).distinct().withColumn("_month", F.date_trunc("month", day))
    newest = d.orderBy(F.desc(day)).limit(daily).select(day)
    firsts = d.groupBy("_month").agg(F.min(day).alias(day)).orderBy(F.desc("_month")).limit(monthly).select(day)
    return newest.union(firsts).distinct()


def retain(log: Table, tables: dict[str, Table], daily: int = 14, monthly: int = 12) -> None:
    """Drops the snapshots that kept() doesn't name, and the files that no other one, and no newest version, needs."""
    rows = log.read()
    if rows is None:
        return
    day = F.to_date("taken_at")
    stay = kept(rows.select(day.alias("day")), daily, monthly)
    left = rows.withColumn("day", day).join(stay, "day").drop("day")
    log.overwrite(left.select(*rows.columns))
    needed = {r["table"]: r["versions"] for r in log.read().groupBy("table").agg(F.collect_set("version").alias("versions")).collect()}  # daily + monthly at most, of each table
    for name, t in tables.items():
        t.vacuum(1, also=needed.get(name, []))
    log.vacuum(1)


def restore(log: Table, tables: dict[str, Table], at: Column) -> dict[str, DataFrame]:
    """The tables as they were in the newest snapshot taken by an instant."""
    rows = log.read()
    last = rows.filter(F.col("taken_at") <= at).agg(F.max("taken_at").alias("taken_at"))
    named = {r["table"]: r["version"] for r in rows.join(F.broadcast(last), "taken_at").select("table", "version").collect()}  # a row a table
    return {name: tables[name].read(v) for name, v in named.items()}
