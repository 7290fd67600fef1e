"""Portfolio runs: a lazy table of candidates, then one ordered fold for each run; and random runs to hold them against."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import Costs
from . import rules, universe
from .asof import asof, session_by
from .book import Replay
from .quality import next_session

EVENTS = "run_id string, session long, kind string, id int, qty long, price double, fee double, pnl double, equity double, cash double, exposure double, note string"
_KINDS = [("run_id", pa.string()), ("session", pa.int64()), ("kind", pa.string()), ("id", pa.int32()), ("qty", pa.int64()), ("price", pa.float64()), ("fee", pa.float64()), ("pnl", pa.float64()), ("equity", pa.float64()), ("cash", pa.float64()), ("exposure", pa.float64()), ("note", pa.string())]


def as_batch(events: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e.get(n) for e in events], k) for n, k in _KINDS], names=[n for n, _ in _KINDS])


def candidates(run_id: str, features: DataFrame, instruments: DataFrame, calendar: DataFrame, actions: DataFrame, strategy: dict[str, Any], floor: float, members: DataFrame | None = None) -> DataFrame:
    """A row for each bar, or ex-date without one, of the instruments that a run could ever hold.

    What needs no state is decided here, in columns: whether the entry clause, the gates and the exit clause without the
    stop hold. features: ticker, date, open, close, volume, atr, turnover_med_63 and what the rules read.
    """
    listed = features.join(calendar, "date").join(instruments, "ticker")
    if members is not None:
        inside = universe.members(features.select("ticker", "date"), members).withColumn("_in", F.lit(True))
        listed = listed.join(inside, ["ticker", "date"], "left")
    may = universe.alive() & universe.entry_gate(floor) & rules.clause(strategy["entry"]) & (F.coalesce("_in", F.lit(False)) if members is not None else F.lit(True))
    bars = listed.select("ticker", "session", "instrument_id", "sector", "open", "close", "volume", "atr", F.col("turnover_med_63").alias("turnover"), may.alias("enter_ok"), rules.clause(strategy["exit"]).alias("exit_rule"), "delisted_on")
    able = bars.filter("enter_ok").select("ticker").distinct()
    bars = bars.join(able, "ticker", "left_semi")
    on = next_session(actions, calendar).join(calendar, "date").join(able, "ticker", "left_semi")
    on = asof(on.select("ticker", "session", "date", "action_type", "value_or_ratio"), features.select("ticker", F.col("date").alias("_at"), F.col("close").alias("close_before")), "ticker", "date", "_at", ["close_before"], strict=True)
    acts = on.groupBy("ticker", "session").agg(F.array_sort(F.collect_list(F.struct(F.col("action_type").alias("kind"), F.col("value_or_ratio").alias("value")))).alias("actions"), F.max("close_before").alias("close_before"))
    ids = session_by(instruments.select("ticker", F.col("instrument_id").alias("_id"), "delisted_on"), "delisted_on", calendar, "until").drop("delisted_on")
    d = bars.drop("delisted_on").join(acts, ["ticker", "session"], "full").join(ids, "ticker")
    return d.select(F.lit(run_id).alias("run_id"), "session", F.coalesce("instrument_id", "_id").alias("id"), "sector", "open", "close", "volume", "atr", "turnover", F.coalesce("enter_ok", F.lit(False)).alias("enter_ok"), F.coalesce("exit_rule", F.lit(False)).alias("exit_rule"), "until", "actions", "close_before")


def simulate(rows: DataFrame, first: int, last: int, risk: dict[str, Any], costs: Costs | None = None, capital: float = 100_000.0) -> DataFrame:
    """What happens in each run, from session first to last: fills, anomalies and, for every session, equity.

    Rows of a run are sorted and streamed through one fold, so a task holds a book and one session, not a run.
    Sessions without a row still happen: what is held is worth nothing on them.
    """
    costs = costs or Costs()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, replay = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["run_id"] != run:
                    out += [{"run_id": run} | e for e in replay.before(last + 1)] if replay else []
                    run, replay = row["run_id"], Replay(risk, costs, capital, first, last)
                out += [{"run_id": run} | e for e in replay.feed(row)]
            yield as_batch(out)
        if replay:
            yield as_batch([{"run_id": run} | e for e in replay.before(last + 1)])

    due = rows.filter(F.col("session").between(first, last))
    return due.repartition("run_id").sortWithinPartitions("run_id", "session", "id").mapInArrow(fold, EVENTS)


def attempts(calendar: DataFrame, holdings: list[int], entries: int, runs: int, seed: int, tries: int) -> DataFrame:
    """run, draw, attempt, session, pick, hold: entries draws of a run over the whole calendar, each with its replacements.

    A draw's first session is any but the last; each further attempt is at a random later one, until none is left. All
    numbers are hashes of seed, run and draw, so any partitioning gives the same.
    """
    last = calendar.agg(F.max("session")).first()[0] or 0
    u = lambda *k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "run", "draw", *k), 11).cast("double") / float(1 << 53)
    later = lambda s, k: F.when(s < last - 1, s + 1 + F.floor(u(F.lit(3), k) * (last - s - 1)))
    first = F.array(F.floor(u(F.lit(0)) * max(1, last))).cast("array<bigint>")
    sessions = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, tries - 1))), first, lambda found, k: F.array_append(found, later(F.element_at(found, -1), k)))
    hold = F.element_at(F.array(*[F.lit(h) for h in holdings]), (F.floor(u(F.lit(2)) * len(holdings)) + 1).cast("int"))
    each = calendar.sparkSession.range(runs).select(F.col("id").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(entries - 1))).alias("draw"))
    d = each.select("run", "draw", hold.cast("long").alias("hold"), F.posexplode(sessions).alias("attempt", "session")).filter(F.col("session").isNotNull() & (F.col("attempt") < tries))
    return d.withColumn("pick", u(F.lit(1), F.col("attempt")))


def random_runs(features: DataFrame, eligible: DataFrame, calendar: DataFrame, instruments: DataFrame, holdings: list[int], entries: int, runs: int, seed: int, risk: dict[str, Any], costs: Costs | None = None, capital: float = 100_000.0, tries: int = 10, slack: int = 21) -> DataFrame:
    """run_id, date, equity of runs that enter at random, with the same costs, gates and sizes, and holding times drawn from real ones.

    attempts() gives each run's sessions; at each one of its eligible instruments is taken by number. Prices come by
    joins: an attempt carries its instrument's bars from the signal to slack bars after its last one. Only a run's own
    attempts meet in a task, which admits them in order of time: what slots, cash or a limit refuse is tried again at the
    draw's next session. A sale that the volume cuts goes on at later bars; what finds no buyer within the slack stays held.
    Holdings are marked at each session's close; one without a bar is worth nothing on it, as in simulate().
    """
    costs = costs or Costs()
    last = calendar.agg(F.max("session")).first()[0] or 0
    ok = eligible.filter("ok").select("ticker", "session")
    numbered = ok.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("ticker")))
    counts = ok.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    drawn = attempts(calendar, holdings, entries, runs, seed, tries).join(counts, "session").withColumn("k", (F.floor(F.col("pick") * F.col("n")) + 1).cast("int")).join(numbered, ["session", "k"])
    bar = F.struct("session", "open", "close", "volume", F.col("turnover_med_63").alias("turnover"), "atr")
    day = features.join(calendar, "date").select("ticker", "session", bar.alias("bar"), "close")
    path = day.groupBy("ticker").agg(F.array_sort(F.collect_list("bar")).alias("bars")).join(instruments.select("ticker", "sector"), "ticker")
    at = F.array_position(F.transform("bars", lambda b: b["session"]), F.col("session").cast("long")).cast("int")
    rows = drawn.join(path, "ticker").withColumn("at", at).select("run", "draw", "attempt", "session", "ticker", "sector", "hold", F.slice("bars", F.col("at"), (F.col("hold") + slack + 2).cast("int")).alias("bars"))

    kinds = pa.schema([("run", pa.int64()), ("ticker", pa.string()), ("session", pa.int64()), ("qty", pa.int64()), ("cash", pa.float64())])

    def admit(t: pa.Table) -> pa.Table:
        bars = t["bars"].combine_chunks()
        rows = [r | {"bars": None, "at": i} for i, r in enumerate(t.drop_columns(["bars"]).to_pylist())]
        return pa.Table.from_pylist(RandomRun(risk, costs, capital, entries, last).fills(rows, lambda i: bars[i].as_py()), kinds)

    fills = rows.groupBy("run").applyInArrow(admit, "run long, ticker string, session long, qty long, cash double")
    w = Window.partitionBy("run", "ticker").orderBy("session")
    steps = fills.groupBy("run", "ticker", "session").agg(F.sum("qty").alias("qty"), F.sum("cash").alias("cash"))
    spans = steps.select("run", "ticker", "session", F.sum("qty").over(w).alias("held"), F.coalesce(F.lead("session").over(w) - 1, F.lit(last)).alias("until"))
    held = spans.select("run", "ticker", "held", F.explode(F.sequence("session", F.greatest("session", "until"))).alias("session"))
    marks = held.filter("held > 0").join(day.select("ticker", "session", "close"), ["ticker", "session"]).groupBy("run", "session").agg(F.sum(F.col("held") * F.col("close")).alias("worth"))
    grid = calendar.sparkSession.range(runs).select(F.col("id").alias("run"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("session"))
    e = grid.join(steps.groupBy("run", "session").agg(F.sum("cash").alias("cash")), ["run", "session"], "left").join(marks, ["run", "session"], "left")
    so_far = Window.partitionBy("run").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    equity = F.lit(capital) + F.sum(F.coalesce("cash", F.lit(0.0))).over(so_far) + F.coalesce("worth", F.lit(0.0))
    return e.withColumn("equity", equity).join(calendar, "session").select(F.col("run").cast("string").alias("run_id"), "date", "equity")


class RandomRun:
    """One run's attempts in order of time, against the gates that the strategy has too."""

    def __init__(self, risk: dict[str, Any], costs: Costs, capital: float, entries: int, last: int):
        self.risk, self.costs, self.entries, self.last = risk, costs, entries, last
        self.cash, self.peak = [(-1, capital)], capital
        self.held: list[dict] = []
        self.out: list[dict] = []

    def book(self, run: int, p: dict, bar: dict, qty: int, cash: float) -> None:
        self.cash.append((bar["session"], cash))
        p["steps"].append((bar["session"], qty))
        self.out.append({"run": run, "ticker": p["ticker"], "session": bar["session"], "qty": qty, "cash": cash})

    def sell(self, run: int, p: dict) -> None:
        """At the first open from its session on, the rest at later ones; costs are those known at the decision."""
        known = [b["turnover"] for b in p["bars"] if b["session"] < p["exit"] and b["turnover"] is not None]
        left = sum(q for _, q in p["steps"])
        for bar in p["bars"]:
            if bar["session"] >= p["exit"] and left > 0:
                price = bar["open"] if bar["open"] is not None else bar["close"]
                qty, paid, fee = self.costs.fill(False, left, price or 0.0, bar["volume"] or 0.0, known[-1] if known else None)
                if qty:
                    self.book(run, p, bar, -qty, paid * qty - fee)
                    left -= qty

    def worth(self, p: dict, session: int) -> float:
        close = next((b["close"] for b in p["bars"] if b["session"] == session), None)
        return (close or 0.0) * sum(q for s, q in p["steps"] if s <= session)

    def enter(self, row: dict) -> bool:
        """Tries one attempt; was it filled?"""
        signal, fill = row["bars"][0], row["bars"][1] if len(row["bars"]) > 1 else None
        now, risk = signal["session"], self.risk
        for p in [p for p in self.held if p["exit"] <= now]:
            self.sell(row["run"], p)
            self.held.remove(p)
        if fill is None or fill["session"] != now + 1 or len(self.held) >= risk["max_open_positions"]:
            return False
        cash = sum(v for s, v in self.cash if s <= now)
        worths = [(p, self.worth(p, now)) for p in self.held]
        equity = cash + sum(v for _, v in worths)
        self.peak = max(self.peak, equity)
        if self.peak > 0 and max(0.0, 1 - equity / self.peak) > risk["drawdown_circuit_breaker"]:
            return False
        price, atr = signal["close"], signal["atr"]
        gap = price - max(0.0, price - risk["atr_mult_stop"] * atr)
        if gap <= 0:
            return False
        of = lambda key: sum(v for p, v in worths if p[key] == row[key])
        budgets = [risk["max_exposure_per_name"] * equity - of("ticker"), risk["max_total_exposure"] * equity - sum(v for _, v in worths), max(0.0, cash)]
        if row["sector"] is not None and "max_exposure_per_sector" in risk:
            budgets.append(risk["max_exposure_per_sector"] * equity - of("sector"))
        qty = int(min([equity * risk["risk_per_trade"] // gap, *(b // price if b > 0 else 0 for b in budgets)]))
        at = fill["open"] if fill["open"] else fill["close"]
        qty, paid, fee = self.costs.fill(True, qty, at or 0.0, fill["volume"] or 0.0, signal["turnover"])
        if qty <= 0:
            return False
        p = {"ticker": row["ticker"], "sector": row["sector"], "bars": row["bars"], "steps": [], "exit": min(fill["session"] + row["hold"], self.last)}
        self.book(row["run"], p, fill, qty, -(paid * qty + fee))
        self.held.append(p)
        return True

    def fills(self, rows: list[dict], bars_of: Callable[[int], list[dict]]) -> list[dict]:
        """What is bought and sold; bars_of gives an attempt's bars once it is its turn, which few replacements have."""
        by_draw: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["attempt"], reverse=True):
            by_draw.setdefault(r["draw"], []).append(r)
        queue = [(x[-1]["session"], d) for d, x in by_draw.items()]
        heapq.heapify(queue)
        entered = 0
        while queue and entered < self.entries:
            _, d = heapq.heappop(queue)
            row = by_draw[d].pop()
            if self.enter(row | {"bars": bars_of(row["at"])}):
                entered += 1
            elif by_draw[d]:
                heapq.heappush(queue, (by_draw[d][-1]["session"], d))
        for p in sorted(self.held, key=lambda p: p["exit"]):
            self.sell(rows[0]["run"], p)
        return self.out
