"""Entries and exits of a ticker in the order of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sessions of a block: the decisions of a ticker in a block meet in one task, and the totals of its blocks in another.
BLOCK = 64


def pair_trades(decisions: DataFrame, sessions: DataFrame, block: int = BLOCK) -> DataFrame:
    """ticker, entry (its number from 1), entered, exited and sessions (held, 1 at least) of every entry.

    decisions: ticker, date, seq (their order within a day; of equal ones an entry comes first) and action; sessions: date
    and session, all numbered. An exit closes the oldest open entry of its ticker; without one it does nothing. Entries that
    stay open are held to the last session (exited is null). Other actions, and days that are no session, don't count.

    Nothing is replayed: the sum of entries minus exits, less its smallest value so far if that is negative, is what is
    open, and that smallest value counts the exits that found nothing. So the k-th entry belongs to the k-th exit that found one.
    """
    step = F.when(F.col("action") == "ENTER", 1).when(F.col("action") == "EXIT", -1)
    d = decisions.join(sessions, "date").withColumn("step", step).filter("step is not null and ticker is not null")
    d = d.select("ticker", "date", "seq", "session", "step", F.floor(F.col("session") / block).alias("block"))
    own = Window.partitionBy("ticker", "block").orderBy("session", "seq", F.desc("step"))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"sum": F.sum("step").over(so_far), "enters": F.count_if(F.col("step") == 1).over(so_far)})
    d = d.withColumn("low", F.min("sum").over(own.rowsBetween(Window.unboundedPreceding, -1)))  # before this decision
    blocks = d.groupBy("ticker", "block").agg(F.sum("step").alias("total"), F.min("sum").alias("least"), F.count_if(F.col("step") == 1).alias("n"))
    earlier = Window.partitionBy("ticker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"sum_before": F.coalesce(F.sum("total").over(earlier), F.lit(0)), "enters_before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    blocks = blocks.withColumn("low_before", F.coalesce(F.min(F.col("sum_before") + F.col("least")).over(earlier), F.lit(0)))
    d = d.join(blocks.select("ticker", "block", "sum_before", "enters_before", "low_before"), ["ticker", "block"])
    total, enters = F.col("sum_before") + F.col("sum"), F.col("enters_before") + F.col("enters")
    low = F.least(F.lit(0), F.col("low_before"), F.col("sum_before") + F.col("low"))
    number = F.when(F.col("step") == 1, enters).when(total >= low, enters - total + low)
    of = lambda s, c: F.max(F.when(F.col("step") == s, F.col(c)))
    pairs = d.withColumn("entry", number).filter("entry is not null").groupBy("ticker", "entry").agg(of(1, "date").alias("entered"), of(-1, "date").alias("exited"), of(1, "session").alias("since"), of(-1, "session").alias("until"))
    last = sessions.agg(F.max("session").alias("last"))
    return pairs.join(F.broadcast(last)).select("ticker", "entry", "entered", "exited", F.greatest(F.lit(1), F.coalesce("until", "last") - F.col("since")).alias("sessions"))


def holdings(pairs: DataFrame) -> DataFrame:
    """sessions of each pair; without any pair one row of 1."""
    none = pairs.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(1).cast(pairs.schema["sessions"].dataType).alias("sessions"))
    return pairs.select("sessions").unionByName(none)
