"""What is written to tables, and how: by whose key, what may change, and what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Table
from . import guards, load, records, refdata

#: Where bars may come from.
SOURCES = ("gpw", "stooq", "demo")


def bars_table(spark: SparkSession, path: str, buckets: int = 16) -> Table:
    return Table(spark, path, ["instrument_id", "date", "adjusted"], by=["instrument_id"], buckets=buckets)


def filings_table(spark: SparkSession, path: str, buckets: int = 64) -> Table:
    return Table(spark, path, ["dedup_key"], buckets=buckets)


def membership_table(spark: SparkSession, path: str, buckets: int = 4) -> Table:
    return Table(spark, path, ["index_name", "instrument_id", "date_from"], by=["index_name"], buckets=buckets)


def store_bars(table: Table, bars: DataFrame, *, source: str, adjusted: bool = False, batch: tuple[str, int] | None = None) -> bool:
    """Bars (instrument_id, date, open ... volume) of one named source; those that are there take the new values.

    A source must be given and known, and made-up bars never stand beside real ones. Of several bars of a key the one of
    largest as_of_date stays (the date itself, where there is none).
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}: one of {SOURCES}")
    there = table.read()
    if there is not None:
        guards.one_kind_of_source(there, source)
    known = F.col("as_of_date") if "as_of_date" in bars.columns else F.col("date")
    rows = bars.withColumns({"as_of_date": known, "adjusted": F.lit(adjusted), "source": F.lit(source)})
    return table.upsert(rows, F.col("as_of_date"), batch)


def store_filings(table: Table, items: DataFrame, batch: tuple[str, int] | None = None) -> bool:
    """Filings by dedup_key: the first of a key that is written stays as it is; of several in a batch the earliest is."""
    return table.insert_first(items, F.struct("published_at", *[c for c in items.columns if c != "published_at"]), batch)


def store_membership(table: Table, given: DataFrame, instruments: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
    """Ranges of whole indices take the place of those that are stored; gives back the rows of unknown tickers."""
    empty = given.limit(0).select("index_name", F.lit(None).cast(instruments.schema["instrument_id"].dataType).alias("instrument_id"), "date_from", "date_to", "source")
    good, unknown = load.membership(empty, given, instruments)
    table.replace(good, batch)
    return unknown


def store_refdata(actions: Table, adjusted: Table, bars: DataFrame, given: DataFrame, names: DataFrame, sessions: DataFrame) -> DataFrame:
    """Good actions by (ticker, ex_date, action_type), then adjusted bars built anew from all stored actions; gives back the
    bad ones with reasons."""
    good, bad = refdata.valid_actions(given, names)
    actions.upsert(good)
    adjusted.overwrite(refdata.back_adjusted(bars, actions.read(), sessions))
    return bad


def store_labels(table: Table, labels: DataFrame, allowed: tuple[str, ...] = records.LABELS, batch: tuple[str, int] | None = None) -> bool:
    """Labels by filing_id: what is written last stays, of several in a batch the latest; an unknown label raises."""
    records.labelled(labels.limit(0), labels, allowed)
    return table.upsert(labels, F.col("labelled_at"), batch)


def append_log(table: Table, rows: DataFrame, batch: tuple[str, int], order: Column) -> bool:
    """Rows of a log under consecutive ids from the largest stored one on, in the given order; a batch that runs again adds nothing."""
    there = table.read()
    numbered = records.numbered(there.select("id") if there is not None else rows.sparkSession.createDataFrame([], "id long"), rows.withColumn("_order", order), ["_order"])
    return table.insert_first(numbered.drop("_order").select("id", *rows.columns), F.col("id"), batch)


def append_overrides(table: Table, overrides: DataFrame, decisions: DataFrame, batch: tuple[str, int]) -> DataFrame:
    """Appends overrides (user_id, at, decision_id, action, reason) to their journal under the next ids, in the order of at; gives
    back those of decisions that don't exist, which are refused. One without a decision stands for itself."""
    known = decisions.select(F.col("id").alias("decision_id")).distinct().withColumn("_known", F.lit(True))
    d = overrides.join(known, "decision_id", "left")
    good = d.filter("decision_id is null or _known").select(*overrides.columns)
    append_log(table, good, batch, F.struct("at", "user_id", "action", "reason"))
    return d.filter("decision_id is not null and _known is null").select(*overrides.columns)
