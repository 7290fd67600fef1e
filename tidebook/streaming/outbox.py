"""Alerts that leave once: a ledger of what was sent, and attempts that may fail and run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from ..tables import Table

#: Final states of an order, whose outcome is told.
DONE = ("FILLED", "PARTIAL", "LAPSED")
Sender = Callable[[str, str], bool]


def ledger_table(spark, path: str, buckets: int = 64) -> Table:
    """order_id, kind, status (sent, passed over or failed), attempts, reason."""
    return Table(spark, path, ["order_id", "kind"], by=["order_id"], buckets=buckets)


def due(orders: DataFrame) -> DataFrame:
    """order_id, kind, text and send of what orders (id, status, signal_sent, fill_sent, and text if there is one) have to tell.

    An outcome is told once an order is done. A signal is told only while its order is pending: of a settled one the
    outcome tells the story, so the signal is marked as passed over (send is false).
    """
    text = F.col("text") if "text" in orders.columns else F.concat_ws(" ", F.col("id").cast("string"), "status")
    outcome = orders.filter(~F.col("fill_sent") & F.col("status").isin(*DONE)).select(F.col("id").cast("long").alias("order_id"), F.lit("outcome").alias("kind"), text.alias("text"), F.lit(True).alias("send"))
    signal = orders.filter(~F.col("signal_sent")).select(F.col("id").cast("long").alias("order_id"), F.lit("signal").alias("kind"), text.alias("text"), (F.col("status") == "PENDING").alias("send"))
    return outcome.unionByName(signal)


def deliver(messages: DataFrame, ledger: Table, send: Sender) -> DataFrame:
    """Sends the messages that the ledger has neither as sent nor as passed over, and writes the attempts to it.

    send(id, text) runs in tasks, message by message; it tells whether the message was delivered. An error counts as not
    delivered and stops nothing. The id is of the order and the kind, so a receiver that drops ids it has seen gets each
    message once, even if a task or the driver is lost between sending and writing; all else is sent once by the ledger.
    Only buckets of the ledger that the messages touch are read. Gives back what was tried.
    """
    touched = messages.select(F.pmod(F.xxhash64("order_id"), F.lit(ledger.buckets)).cast("int").alias("b")).distinct()
    known = ledger.read(buckets=[r["b"] for r in touched.collect()])  # bucket numbers only
    fresh = messages.dropDuplicates(["order_id", "kind"]).withColumn("before", F.lit(0))
    if known is not None:
        k = known.select("order_id", "kind", F.col("status").alias("_s"), F.col("attempts").alias("_a"))
        fresh = fresh.drop("before").join(k, ["order_id", "kind"], "left").filter("_s is null or _s = 'failed'").withColumn("before", F.coalesce("_a", F.lit(0))).drop("_s", "_a")

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            status, why = [], []
            for key, kind, text, go in zip(f["order_id"], f["kind"], f["text"], f["send"], strict=True):
                reason = None
                if not go:
                    done = "passed over"
                else:
                    try:
                        done = "sent" if send(f"{key}-{kind}", text) else "failed"
                        reason = None if done == "sent" else "not delivered"
                    except Exception as e:
                        done, reason = "failed", f"{type(e).__name__}: {e}"
                status.append(done)
                why.append(reason)
            yield pd.DataFrame({"order_id": f["order_id"], "kind": f["kind"], "status": status, "attempts": f["before"] + 1, "reason": pd.Series(why, dtype=object)})

    found = written(fresh.mapInPandas(tried, "order_id long, kind string, status string, attempts int, reason string"), "attempts")
    ledger.upsert(found)
    return found


def outbox(ledger: Table, send: Sender) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over a stream of orders: what they have to tell leaves, a batch that runs again sends nothing twice."""

    def each(batch: DataFrame, _epoch: int) -> None:
        deliver(due(batch), ledger, send)

    return each


def marked(orders: DataFrame, ledger: Table) -> DataFrame:
    """orders with signal_sent and fill_sent as the ledger has them."""
    done = ledger.read().filter("status <> 'failed'").groupBy(F.col("order_id").alias("_id")).agg(*[F.coalesce(F.max(F.col("kind") == k), F.lit(False)).alias(f"_{k}") for k in ("signal", "outcome")])
    d = orders.join(done, F.col("id") == F.col("_id"), "left")
    told = {"signal_sent": F.col("signal_sent") | F.coalesce("_signal", F.lit(False)), "fill_sent": F.col("fill_sent") | F.coalesce("_outcome", F.lit(False))}
    return d.withColumns(told).drop("_id", "_signal", "_outcome")
