"""A scoring job that goes on: each input is asked for once, within a budget, and a run that dies loses little."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written
from ..tables import Table
from .research import ATTEMPTS, waiting

FIELDS = ("relevance", "sentiment", "confidence", "quote")
ANSWER = "relevance string, sentiment double, confidence double, quote string"


class Filings:
    """Filings (filing_id, published_at, full_text, processed, attempts), whose marks, which change with each run, are stored
    beside the texts, which don't: so a run writes ids and marks, no text."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.whole, self.marks = (Table(spark, f"{path}/{name}", ["filing_id"], buckets=buckets) for name in ("whole", "marks"))

    def upsert(self, rows: DataFrame, newest: Column | None = None) -> None:
        self.whole.upsert(rows, newest)
        self.mark(self.whole.read().join(rows.select("filing_id").distinct(), "filing_id", "left_semi"))

    def mark(self, rows: DataFrame) -> None:
        self.marks.upsert(rows.select("filing_id", "processed", "attempts"))

    def read(self, **instead: Column) -> DataFrame | None:
        """All filings; instead: columns on their texts that take the texts' place, worked out where the texts lie."""
        d, marks = self.whole.read(), self.marks.read()
        if d is None:
            return None
        d = d.withColumns(instead).drop("full_text") if instead else d
        if marks is None:
            return d
        m = marks.select("filing_id", F.struct("processed", "attempts").alias("_m"))
        return d.join(m, "filing_id", "left").select(*[F.coalesce(F.col("_m")[c], F.col(c)).alias(c) if c in ("processed", "attempts") else c for c in d.columns])


def tables(spark: SparkSession, path: str, buckets: int = 16) -> dict[str, Table | Filings]:
    """filings (filing_id, published_at, full_text, processed, attempts), answers by input_hash, scores by filing_id."""
    keys = {"answers": ["input_hash"], "scores": ["filing_id"]}
    return {"filings": Filings(spark, f"{path}/filings", buckets)} | {name: Table(spark, f"{path}/{name}", key, buckets=buckets) for name, key in keys.items()}


def in_turn(claims: DataFrame, cost: str = "usd") -> DataFrame:
    """claims (published_at, filing_id, and a cost) with before, what those ahead of each cost together.

    Sums of days are added up first, so that a task orders the claims of a day, not all.
    """
    d = claims.withColumn("_day", F.to_date("published_at"))
    days = d.groupBy("_day").agg(F.sum(cost).alias("_sum"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).drop("_sum")
    own = Window.partitionBy("_day").orderBy("published_at", "filing_id").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(days, "_day").withColumn("before", F.col("_before") + F.coalesce(F.sum(cost).over(own), F.lit(0.0))).drop("_day", "_before")


def run(stored: dict[str, Table | Filings], score: Callable[[str], dict], as_of: Column, cap: float, usd: Column, steps: int = 4) -> None:
    """One run over the filings that wait by as_of.

    Filings of one text share an input_hash: of each hash without an answer the earliest filing claims a call; those with
    one take it for nothing. Claims are admitted in the order of filings while what the month's answers have cost and what
    the claims ahead will cost (usd, a column on full_text) is under cap; a call that fails costs nothing, and its share is
    free again in the next run. score(text) runs in tasks; an error, or None, is a failed attempt, and a filing with
    ATTEMPTS of them is given up: processed, but without a score. Calls go in steps by hash, each step's answers being
    stored before the next begins, so that a run that dies loses one step, and the next run asks only for what has no answer.
    Hashes and costs are worked out where the texts lie; only texts that are asked about are shuffled and written.
    """
    filings, answers = stored["filings"], stored["answers"]
    text = F.coalesce("full_text", F.lit(""))
    wait = written(waiting(filings.read(input_hash=F.sha2(text, 256), usd=usd.cast("double")), as_of), "waiting")
    known = answers.read()
    fresh, spent = wait, 0.0
    if known is not None:
        fresh = wait.join(known.select("input_hash"), "input_hash", "left_anti")
        spent = known.filter(F.date_trunc("month", "answered_at") == F.date_trunc("month", as_of)).agg(F.sum("usd")).first()[0] or 0.0
    claims = fresh.groupBy("input_hash").agg(F.min_by(F.struct("published_at", "filing_id", "usd"), F.struct("published_at", "filing_id")).alias("c")).select("input_hash", "c.*")
    taken = in_turn(claims).filter(F.col("before") + spent < cap).select("filing_id", "input_hash", "usd")
    admitted = written(taken.join(filings.whole.read().select("filing_id", "full_text"), "filing_id"), "admitted")

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for x in f["full_text"]:
                try:
                    found.append(score(x or "") or {})
                except Exception:
                    found.append({})
            yield pd.DataFrame({"input_hash": f["input_hash"], "usd": f["usd"], "ok": [bool(x) for x in found], **{k: [x.get(k) for x in found] for k in FIELDS}})

    done = []
    for k in range(steps):
        part = admitted.filter(F.pmod(F.xxhash64("input_hash"), F.lit(steps)) == k).select("input_hash", "usd", "full_text")
        tried = written(part.mapInPandas(asked, f"input_hash string, usd double, ok boolean, {ANSWER}"), "asked")
        answers.insert_first(tried.filter("ok").select("input_hash", *FIELDS, "usd", as_of.cast("timestamp").alias("answered_at")), F.col("answered_at"))
        done.append(tried)
    wait = wait.drop("usd")
    got = wait.join(answers.read().select("input_hash", *FIELDS), "input_hash")
    stored["scores"].upsert(got.select("filing_id", *FIELDS))
    failed = wait.join(reduce(DataFrame.unionByName, done).filter("not ok").select("input_hash"), "input_hash").withColumn("attempts", F.col("attempts") + 1)
    changed = got.select(*wait.columns).withColumn("processed", F.lit(True)).unionByName(failed.withColumn("processed", F.col("attempts") >= ATTEMPTS))
    filings.mark(written(changed.select("filing_id", "processed", "attempts"), "marked"))
