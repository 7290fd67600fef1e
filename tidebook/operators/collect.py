"""One cycle of a collector of filings: what is new, and whether the cycle was sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import first_reports, health
from .refdata import insert_new


def cycle(items: DataFrame, stored: DataFrame) -> DataFrame:
    """The items to store: of each dedup_key that isn't stored the earliest one, and no report that another source had first.

    items: filing_id, feed_ord, pos, dedup_key, isin, report_no, kind, published_at. Items of all feeds are put in one
    order by instant, feed and place first, so that the earliest wins whichever feed is listed first.
    """
    order = F.struct("published_at", "feed_ord", "pos")
    return first_reports(insert_new(stored, items, ["dedup_key"], order), stored.filter("isin is not null and report_no is not null and kind is not null"))


def beacon(state: DataFrame, feeds: DataFrame, at: Column) -> DataFrame:
    """The collector's row after a cycle over feeds (feed, status: ok, failed or skipped): sound only if there were feeds and all are ok."""
    n = feeds.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("bad")).first()
    ok = n["n"] > 0 and not n["bad"]
    return health(state, at, ok, f"{n['n']} feeds" if ok else f"{n['bad']} of {n['n']} feeds failed")
