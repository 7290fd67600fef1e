"""The score store: which filings wait, scores by an injected function, the cache, the budget, and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import in_parts

#: Filings whose scoring failed so often are given up.
ATTEMPTS = 3


def waiting(filings: DataFrame, as_of: Column | datetime, attempts: int = ATTEMPTS, instrument_id: int | None = None) -> DataFrame:
    """Filings known by an instant that are neither processed nor given up; of one instrument, if it is named.

    A datetime must have a time zone: a naive one could mean any.
    """
    if isinstance(as_of, datetime):
        if as_of.tzinfo is None:
            raise ValueError("as_of needs a time zone")
        as_of = F.timestamp_micros(F.lit(round(as_of.timestamp() * 1_000_000)))
    found = filings.filter((F.col("published_at") <= as_of) & ~F.col("processed") & (F.col("attempts") < attempts))
    return found if instrument_id is None else found.filter(F.col("instrument_id") == instrument_id)


def sole_instrument(names: DataFrame, instruments: DataFrame, name: str = "name") -> DataFrame:
    """names with instrument_id, that of the one instrument whose ticker or name it is, in any case; null if none or several are."""
    keys = instruments.select(F.explode(F.array(F.upper("ticker"), F.upper("name"))).alias("_key"), "instrument_id").filter("_key is not null").distinct()
    sole = keys.groupBy("_key").agg(F.count_distinct("instrument_id").alias("_n"), F.min("instrument_id").alias("_id")).filter("_n = 1")
    d = names.drop("instrument_id").withColumn("_asked", F.upper(F.trim(name)))
    return d.join(sole, F.col("_asked") == F.col("_key"), "left").withColumnRenamed("_id", "instrument_id").drop("_asked", "_key", "_n")


def backlog(filings: DataFrame, instruments: DataFrame) -> DataFrame:
    """instrument_id, n, first_at of waiting filings, and under a null id those without a known instrument or of an index."""
    known = instruments.filter(~F.col("is_index")).select(F.col("instrument_id").alias("_id"))
    d = filings.join(known, F.col("instrument_id") == F.col("_id"), "left")
    return d.groupBy(F.col("_id").alias("instrument_id")).agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first_at"))


def after_attempt(filings: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """filings with processed set for the ids of done, and one more attempt for those of failed."""
    marks = done.select("filing_id", F.lit(True).alias("_done")).unionByName(failed.select("filing_id", F.lit(False).alias("_done"))).groupBy("filing_id").agg(F.max("_done").alias("_done"))
    d = filings.join(marks, "filing_id", "left")
    return d.withColumns({"processed": F.col("processed") | F.coalesce("_done", F.lit(False)), "attempts": F.col("attempts") + F.when(~F.col("_done"), 1).otherwise(0)}).drop("_done")


def scored(filings: DataFrame, score: Callable[[str], dict]) -> DataFrame:
    """filing_id, relevance, sentiment, confidence, quote of each filing by a function of its text, batch by batch.

    The function is the only thing that would call a model; tests and queries pass a rule.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [score(t or "") for t in f["full_text"]]
            yield pd.DataFrame({"filing_id": f["filing_id"], **{k: [x[k] for x in found] for k in ("relevance", "sentiment", "confidence", "quote")}})

    return filings.select("filing_id", "full_text").mapInPandas(each, "filing_id long, relevance string, sentiment double, confidence double, quote string")


def grounded(scores: DataFrame, filings: DataFrame) -> DataFrame:
    """Scores whose quote isn't in the filing lose half their confidence."""
    d = scores.join(filings.select("filing_id", "instrument_id", "full_text"), "filing_id")
    ok = text.quoted(F.col("quote"), F.col("full_text"))
    return d.withColumn("grounded", ok).withColumn("confidence", text.penalized(F.col("confidence"), ok)).drop("full_text")


def best(scores: DataFrame) -> DataFrame:
    """Of each instrument the score of most confidence; of equal ones the first filing's."""
    pick = F.struct("confidence", (-F.col("filing_id")).alias("_n"))
    return scores.filter("instrument_id is not null").groupBy("instrument_id").agg(F.max_by(F.struct("filing_id", "relevance", "sentiment", "confidence"), pick).alias("b")).select("instrument_id", "b.*")


def through_cache(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers that the cache has, inputs to ask for, each once) of asked (id, input_hash)."""
    hits = asked.join(cache.select("input_hash", "response"), "input_hash")
    return hits, asked.join(cache.select("input_hash"), "input_hash", "left_anti").groupBy("input_hash").agg(F.min("id").alias("id"))


def within_budget(calls: DataFrame, cap: float) -> DataFrame:
    """calls (id, at, usd, cached) with spent, the month's cost before each, and allowed: cached ones are free and always are.

    Calls are dealt by range of time; sums of a month within the parts before are added to the sums within a part, so no
    task orders all calls of a month, however many they are.
    """
    cost = F.when(F.col("cached"), 0.0).otherwise(F.col("usd"))
    d = in_parts(calls.withColumns({"_month": F.date_trunc("month", "at"), "_cost": cost}), ["at", "id"], "calls")
    parts = d.groupBy("_part", "_month").agg(F.sum("_cost").alias("_sum"))  # a row a part and month
    earlier = Window.partitionBy("_month").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_month", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    own = Window.partitionBy("_part", "_month").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum("_cost").over(own), F.lit(0.0)))
    same = [d["_part"] == parts["_part"], d["_month"].eqNullSafe(parts["_month"])]
    d = d.join(F.broadcast(parts), same).withColumn("spent", F.col("_before") + F.col("_own"))
    return d.withColumn("allowed", F.col("cached") | (F.col("spent") < cap)).select(*calls.columns, "spent", "allowed")


def regression(runs: DataFrame) -> DataFrame:
    """The newest run and the newest one before it of another configuration: config_hash, f1, previous, delta (id, config_hash, f1)."""
    last = runs.agg(F.max_by(F.struct("id", "config_hash", "f1"), "id").alias("l")).select("l.*")
    others = runs.join(F.broadcast(last.select(F.col("config_hash").alias("_own"))), F.col("config_hash") != F.col("_own"))
    before = others.agg(F.max_by("f1", "id").alias("previous"))
    return last.join(F.broadcast(before)).select("config_hash", "f1", "previous", (F.col("f1") - F.col("previous")).alias("delta"))
