"""Logs of decisions, trades, equity and trials, results of runs, and the hashes that name a configuration."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import in_order
from .refdata import upsert

#: Books of the paper loop; results of other runs may not stand under such a name.
PAPER = "paper:"
LABELS = ("bullish", "bearish", "neutral", "irrelevant")


def canonical(payload: Any, ascii_only: bool = True) -> str:
    """JSON with sorted keys, dates as their ISO text: equal contents, equal texts."""
    return json.dumps(payload, sort_keys=True, default=str, ensure_ascii=ascii_only)


def digest(payload: Any, ascii_only: bool = True) -> str:
    return hashlib.sha256(canonical(payload, ascii_only).encode("utf-8")).hexdigest()


def trial_hash(strategy: dict, config: dict) -> str:
    """Names a trial: the strategy and the settings of a run that shape its result."""
    return digest({"strategy": strategy} | {k: config.get(k) for k in ("costs", "walk_forward", "execution", "universe", "initial_capital")})


def book_hash(strategy: dict, config: dict, universe: dict) -> str:
    """Names what a paper book would have done: rules, costs, execution and everything that may be traded."""
    own = config.get("universe")
    return digest({"strategy": strategy, "costs": config["costs"], "execution": config.get("execution", {}), "universe": universe.get("instruments", []), "universe_gate": (own or {}).get("index"), "universe_cfg": own})


def call_hash(model: str, params: dict, messages: list[dict]) -> str:
    """Names a question to a model; letters outside ASCII stay as they are."""
    return digest({"model": model, "params": params, "messages": messages}, ascii_only=False)


def numbered(stored: DataFrame, rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """rows to append to stored, with ids that go on after its largest, in the given order.

    Numbers come from the counts of range partitions, so that no task sorts all rows.
    """
    last = stored.agg(F.max(key)).first()[0] or 0
    return in_order(rows.drop(key), order, key, last + 1)


def decisions(stored: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """Decisions to append, from the events of runs (run_id, session, kind, id): what was decided, and when it was filled."""
    rows = events.filter(F.col("kind").isin("ENTER", "EXIT")).join(days.select("session", F.col("date").alias("fill_date")), "session")
    before = days.select((F.col("session") + 1).alias("session"), F.col("date").alias("decision_date"))
    rows = rows.join(before, "session", "left").select(F.col("run_id").alias("user_id"), F.col("id").alias("instrument_id"), "decision_date", "fill_date", F.col("kind").alias("action"))
    return numbered(stored, rows, ["user_id", "fill_date", "instrument_id", "action"])


def trades(stored: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """Trades to append, from the events of runs: a row for each fill."""
    side = F.when(F.col("kind") == "ENTER", "BUY").otherwise("SELL")
    rows = events.filter(F.col("kind").isin("ENTER", "EXIT", "CLOSE")).join(days, "session").select(F.col("run_id").alias("user_id"), F.col("id").alias("instrument_id"), side.alias("side"), "qty", "price", "fee", "date")
    return numbered(stored, rows, ["user_id", "date", "instrument_id", "side"])


def result_of(events: DataFrame, days: DataFrame, stored: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, trades, equity) tables with a run's result in place of what stood under its name; raises for a paper book's name."""
    runs = events.select("run_id").distinct()
    if not runs.filter(F.col("run_id").startswith(PAPER)).isEmpty():
        raise ValueError(f"the names of runs may not begin with {PAPER!r}")
    kept = [t.join(runs.withColumnRenamed("run_id", "user_id"), "user_id", "left_anti") for t in stored]
    curve = events.filter("kind = 'equity'").join(days, "session").select(F.col("run_id").alias("user_id"), "date", "equity", "cash", "exposure")
    return kept[0].unionByName(decisions(stored[0], events, days)), kept[1].unionByName(trades(stored[1], events, days)), kept[2].unionByName(curve)


def anomalies(events: DataFrame) -> DataFrame:
    """run_id, note, n: what went otherwise than planned in fills, by kind."""
    return events.filter("kind = 'anomaly'").groupBy("run_id", "note").agg(F.count(F.lit(1)).alias("n"))


def trial(stored: DataFrame, name: str, metrics: DataFrame, at: Column) -> DataFrame:
    """The row to append for a trial: its hash, instant and measures as JSON."""
    row = metrics.select(F.lit(name).alias("config_hash"), at.alias("run_at"), F.to_json(F.struct(*sorted(metrics.columns))).alias("metrics"))
    return numbered(stored, row, ["config_hash"])


def labelled(stored: DataFrame, labels: DataFrame, allowed: tuple[str, ...] = LABELS) -> DataFrame:
    """stored labels (filing_id, label, labelled_at) with newer ones in place of older; a label that isn't allowed raises."""
    odd = labels.filter(~F.coalesce(F.col("label").isin(*allowed), F.lit(False)))
    if not odd.isEmpty():
        raise ValueError(f"unknown label {odd.first()['label']!r}")
    return upsert(stored, labels, ["filing_id"], F.col("labelled_at"))


def latest_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Of each by the row of largest order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
