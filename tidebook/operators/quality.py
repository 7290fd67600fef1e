"""Checks of bars and filings: each finds rows (category, ticker, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import price_factor
from .asof import session_by
from .features import previous_valid_close


def missing_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """ticker, date of every session between an instrument's first and last bar on which it has none.

    Gaps come from neighbouring bars: only the sessions inside a gap are made, not all dates of all instruments.
    """
    w = Window.partitionBy("ticker").orderBy("session")
    d = bars.select("ticker", "date").join(sessions, "date").withColumn("next", F.lead("session").over(w))
    gaps = d.filter(F.col("next") > F.col("session") + 1).select("ticker", F.explode(F.sequence(F.col("session") + 1, F.col("next") - 1)).alias("session"))
    return gaps.join(sessions, "session").select("ticker", "date")


def bad_volume(bars: DataFrame) -> DataFrame:
    return bars.filter("volume is null or volume <= 0").select("ticker", "date")


def action_factors(actions: DataFrame, sessions: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker, date, factor: the product of an instrument's action factors, on the session at or after each ex-date."""
    moved = next_session(actions, sessions)
    d = previous_valid_close(bars).select("ticker", "date", "prev_close").join(moved, ["ticker", "date"], "right")
    return d.groupBy("ticker", "date").agg(F.product(price_factor(F.col("action_type"), F.col("value_or_ratio"), F.col("prev_close"))).alias("factor"))


def next_session(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """actions with date: the first session at or after ex_date; those after the last session are left out.

    The calendar (a row for each day ever traded) and the distinct ex-dates are put in one order.
    """
    u = sessions.select("date", F.col("date").alias("own")).unionByName(actions.select(F.col("ex_date").alias("date"), F.lit(None).cast("date").alias("own")).distinct())
    w = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    at = u.groupBy("date").agg(F.max("own").alias("own")).withColumn("session_date", F.min("own").over(w)).select(F.col("date").alias("ex_date"), "session_date")
    return actions.join(at, "ex_date").filter("session_date is not null").withColumnRenamed("session_date", "date")


def jumps(bars: DataFrame, factors: DataFrame, most: float = 0.25) -> DataFrame:
    """ticker, date, move of closes that moved more than most after the day's action factor is taken out."""
    d = previous_valid_close(bars).join(factors, ["ticker", "date"], "left")
    move = F.try_divide("close", F.col("prev_close") * F.coalesce("factor", F.lit(1.0))) - 1
    return d.withColumn("move", move).filter(F.abs("move") > most).select("ticker", "date", "move")


def stale(bars: DataFrame, sessions: DataFrame, most: int = 5) -> DataFrame:
    """ticker, last_date, behind of instruments whose last bar is more than most sessions before the last session."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("date")).join(sessions, "date")
    end = sessions.agg(F.max("session").alias("end"))
    return last.join(F.broadcast(end)).withColumn("behind", F.col("end") - F.col("session")).filter(F.col("behind") > most).select("ticker", F.col("date").alias("last_date"), "behind")


def report(found: dict[str, DataFrame]) -> DataFrame:
    """category, ticker, detail of several checks; detail is the rest of a row as text."""
    out = None
    for category, d in found.items():
        rest = [c for c in d.columns if c != "ticker"]
        part = d.select(F.lit(category).alias("category"), "ticker", F.concat_ws(" ", *[F.col(c).cast("string") for c in rest]).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def summary(found: DataFrame, examples: int = 3, parts: int = 64) -> DataFrame:
    """category, n and the first few details, with how many more there are.

    A category's rows are dealt by hash into parts, each of which gives its first few, so no task holds them all.
    """
    text = found.select("category", F.concat_ws(" ", "ticker", "detail").alias("x"))
    first = lambda d, *by: d.withColumn("_k", F.row_number().over(Window.partitionBy("category", *by).orderBy("x"))).filter(F.col("_k") <= examples).drop("_k")
    few = first(text.distinct().withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(parts))), "_part")
    few = first(few.drop("_part")).groupBy("category").agg(F.array_sort(F.collect_list("x")).alias("first"))
    a = text.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(few, "category")
    more = F.when(F.col("n") > F.size("first"), F.format_string(" (+%d more)", F.col("n") - F.size("first"))).otherwise("")
    return a.select("category", "n", F.concat(F.array_join("first", ", "), more).alias("examples"))


def short_bodies(filings: DataFrame, chars: int = 200, least: int = 10) -> DataFrame:
    """source, n, short_ratio of sources with enough filings."""
    short = F.length(F.coalesce("full_text", F.lit(""))) < chars
    a = filings.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count_if(short) / F.count(F.lit(1))).alias("short_ratio"))
    return a.filter(F.col("n") >= least)


def business_hours(start: Column, end: Column) -> Column:
    """Hours from start to end on Mondays to Fridays, parts of days in proportion; 0 if end isn't after start."""
    days = F.sequence(F.to_date(start), F.to_date(end))
    edge = lambda ts: F.unix_micros(ts.cast("timestamp")).cast("double") / 3.6e9
    hours = lambda d: F.greatest(F.least(edge(end), edge(d) + 24.0) - F.greatest(edge(start), edge(d)), F.lit(0.0))
    return F.when(end > start, F.aggregate(F.filter(days, lambda d: F.weekday(d) < 5), F.lit(0.0), lambda a, d: a + hours(d))).otherwise(0.0)


def silence(filings: DataFrame, now: Column, most: dict[str, float], default: float = 24.0) -> DataFrame:
    """source, newest, hours of sources whose newest filing is more business hours old than allowed (source, published_at)."""
    limit = F.lit(default)
    for name, hours in sorted(most.items()):
        limit = F.when(F.col("source") == name, F.lit(float(hours))).otherwise(limit)
    d = filings.groupBy("source").agg(F.max("published_at").alias("newest")).withColumn("hours", business_hours(F.col("newest"), now))
    return d.filter(F.col("hours") > limit)


def no_data(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker of the universe's entries without any bar, whether they are known or not."""
    return universe.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def price_checks(bars: DataFrame, universe: DataFrame, index: DataFrame, index_name: str, actions: DataFrame, most_behind: int = 5, most_move: float = 0.25) -> DataFrame:
    """category, ticker, detail of all that is wrong with bars (ticker, date, close, volume).

    universe: ticker and delisted_on. index: the benchmark's bars (date), whose dates are the exchange's calendar. Of
    instruments that were delisted by its end none is stale. If the benchmark has no bar, that is said (no_data), and what
    needs the calendar is silent; if it ends before the newest bar, it is stale itself.
    """
    own = bars.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    days = index.select("date").distinct().withColumn("session", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # a row a day
    end = days.agg(F.max("date").alias("end"), F.count(F.lit(1)).alias("n"))
    last = own.groupBy("ticker").agg(F.max("date").alias("last")).join(universe.select("ticker", "delisted_on").distinct(), "ticker").join(F.broadcast(end))
    alive = last.filter("end is not null and (delisted_on is null or delisted_on > end)")
    known = session_by(alive, "last", days, "at")
    behind = F.col("n") - 1 - F.coalesce("at", F.lit(-1))
    late = known.withColumn("behind", behind).filter(F.col("behind") > most_behind).select("ticker", "last", "behind")
    newest = own.agg(F.max("date").alias("newest")).join(F.broadcast(end))
    lag = newest.filter("newest > end").select(F.lit(index_name).alias("ticker"), "end", "newest")
    none = end.filter("n = 0").select(F.lit(index_name).alias("ticker"))
    moves = jumps(own, action_factors(actions, days, own), most_move).select("ticker", "date")
    found = {"no_data": no_data(universe, bars).unionByName(none), "missing_session": missing_sessions(own, days), "bad_volume": bad_volume(own).select("ticker", "date"), "unexplained_jump": moves, "stale_ticker": late, "stale_benchmark": lag}
    return report(found)


def filings_checks(filings: DataFrame, feeds: DataFrame, now: Column, silent: float = 12.0, feed_silent: float = 48.0, volume_days: int = 3, least: int = 10, text_days: int = 7, chars: int = 200, ratio: float = 0.5, sample: int = 3) -> DataFrame:
    """category, source, value of what is wrong with filings (source, published_at, instrument_id, full_text) at an instant.

    feeds: name, enabled and max_hours (null: feed_silent). filings_silent: business hours since the newest filing, of the
    collector; feed_silent: those of an enabled feed; a null value says that nothing was ever stored. filings_low_volume:
    filings of the last volume_days, if under least. filings_missing_text: the share of short texts among a feed's filings
    of known instruments of the last text_days, from sample of them on. Without an enabled feed nothing else is said than
    that the collector is silent. Filings are read once and summed up by source.
    """
    since = lambda days: F.col("published_at") >= now - F.make_dt_interval(F.lit(days))
    mapped = F.col("instrument_id").isNotNull() & since(text_days)
    short = F.length(F.coalesce("full_text", F.lit(""))) < chars
    by = filings.groupBy("source").agg(F.max("published_at").alias("newest"), F.count_if(since(volume_days)).alias("recent"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & short).alias("short"))
    on = feeds.filter("enabled").select(F.col("name").alias("source"), F.coalesce("max_hours", F.lit(float(feed_silent))).alias("most"))
    some = on.agg(F.count(F.lit(1)).alias("n_feeds"))
    whole = by.agg(F.max("newest").alias("newest"), F.coalesce(F.sum("recent"), F.lit(0)).alias("recent")).join(F.broadcast(some))
    hours = business_hours(F.col("newest"), now)
    row = lambda d, category, source, value: d.select(F.lit(category).alias("category"), source.alias("source"), value.cast("double").alias("value"))
    collector, nothing = F.lit("collector"), F.lit(None)
    own = on.join(by, "source", "left")
    return (
        row(whole.filter((F.col("n_feeds") == 0) | F.col("newest").isNull()), "filings_silent", collector, nothing)
        .unionByName(row(whole.filter((F.col("n_feeds") > 0) & (hours > silent)), "filings_silent", collector, hours))
        .unionByName(row(own.filter("newest is null"), "feed_silent", F.col("source"), nothing))
        .unionByName(row(own.filter(hours > F.col("most")), "feed_silent", F.col("source"), hours))
        .unionByName(row(whole.filter((F.col("n_feeds") > 0) & (F.col("recent") < least)), "filings_low_volume", collector, F.col("recent")))
        .unionByName(row(own.filter((F.col("mapped") >= sample) & (F.col("short") > ratio * F.col("mapped"))), "filings_missing_text", F.col("source"), F.col("short") / F.col("mapped")))
    )
