"""One portfolio's day: actions, fills, marks, decisions. The same step serves batch runs and the streaming book."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from ..functions.money import Costs


@dataclass
class Position:
    qty: int
    entry: float
    stop: float
    sector: Any
    last: dict = field(default_factory=dict)


@dataclass
class Book:
    """Cash, positions by instrument, orders in their queue, and the highest equity so far."""

    cash: float
    peak: float = 0.0
    positions: dict[int, Position] = field(default_factory=dict)
    orders: list[dict] = field(default_factory=list)

    def action(self, i: int, kind: str, value: float, close_before: float | None) -> None:
        """An ex-date: re-bases the position and the orders of an instrument so that no gap looks like a move of the market."""
        p = self.positions.get(i)
        if p:
            if kind == "split":
                whole = math.floor(p.qty * value + 1e-9)
                part = max(0.0, p.qty * value - whole)
                if close_before and close_before > 0:
                    self.cash += part * close_before / value
                p.qty, p.entry, p.stop = whole, p.entry / value, p.stop / value
                if not whole:
                    del self.positions[i]
            elif kind == "dividend":
                self.cash += p.qty * value
                p.stop, p.entry = max(0.0, p.stop - value), max(0.0, p.entry - value)
            else:
                p.stop *= value
        for o in self.orders:
            if o["id"] != i:
                continue
            if kind == "split":
                o["qty"] = max(0, math.floor(o["qty"] * value + 1e-9))
            if o["stop"] is not None:
                o["stop"] = {"split": o["stop"] / value, "dividend": max(0.0, o["stop"] - value)}.get(kind, o["stop"] * value)

    def settle(self, session: int, bars: dict[int, dict], costs: Costs) -> list[dict]:
        """Fills what is due at the open (else the close); a sale's unfilled rest waits for the next session."""
        out, waiting = [], []
        for o in self.orders:
            if o["due"] != session:
                if o["due"] > session:
                    waiting.append(o)
                continue
            bar = bars.get(o["id"], {})
            price = bar.get("open") if bar.get("open") is not None else bar.get("close")
            if bar.get("open") is None:
                out.append({"kind": "anomaly", "id": o["id"], "note": "lapsed, no bar" if price is None else "no open, close used"})
            if price is None:
                continue
            buy, p = o["side"] == "BUY", self.positions.get(o["id"])
            qty, paid, fee = costs.fill(buy, o["qty"], price, bar.get("volume") or 0.0, o["turnover"])
            if buy and qty:
                self.cash -= paid * qty + fee
                self.positions[o["id"]] = Position(qty, paid, o["stop"], o["sector"], o["last"])
                out.append({"kind": "ENTER", "id": o["id"], "qty": qty, "price": paid, "fee": fee})
            elif not buy:
                sold = min(qty, p.qty) if p and qty else 0
                if sold:
                    self.cash += paid * sold - fee
                    out.append({"kind": "EXIT", "id": o["id"], "qty": sold, "price": paid, "fee": fee, "pnl": (paid - p.entry) * sold - fee})
                    p.qty -= sold
                    if p.qty <= 0:
                        del self.positions[o["id"]]
                if o["qty"] > sold and (p or not qty):
                    waiting.append(o | {"qty": o["qty"] - sold, "due": session + 1})
        self.orders = waiting
        return out

    def mark(self, bars: dict[int, dict], mult: float) -> tuple[float, float]:
        """(equity, value of holdings): a position without a bar today is worth nothing today; stops rise where there is one."""
        held = 0.0
        for i, p in self.positions.items():
            close, atr = bars.get(i, {}).get("close"), bars.get(i, {}).get("atr")
            if close is None:
                continue
            held += close * p.qty
            if atr:
                p.stop = max(p.stop, close - mult * atr)
        equity = self.cash + held
        self.peak = max(self.peak, equity)
        return equity, held

    def decide(self, session: int, bars: dict[int, dict], equity: float, risk: dict) -> None:
        """Queues sales of what breaks a rule or its stop and purchases within the limits, in the order of instruments."""
        by_name, by_sector, cash = {}, {}, self.cash
        buys = {o["id"]: o for o in self.orders if o["side"] == "BUY"}
        sells = {o["id"] for o in self.orders if o["side"] == "SELL"}

        def add(i: int, sector: Any, value: float) -> None:
            by_name[i] = by_name.get(i, 0.0) + value
            if sector is not None:
                by_sector[sector] = by_sector.get(sector, 0.0) + value

        for i, p in self.positions.items():
            if bars.get(i, {}).get("close") is not None:
                add(i, p.sector, bars[i]["close"] * p.qty)
        for i, o in buys.items():
            price = bars.get(i, {}).get("open") or bars.get(i, {}).get("close")
            if price:
                cash -= price * o["qty"]
                add(i, o["sector"], price * o["qty"])
        cash, count = max(0.0, cash), len(self.positions) + len(buys)
        calm = not self.peak > 0 or max(0.0, 1 - equity / self.peak) <= risk["drawdown_circuit_breaker"]
        for i in sorted({*self.positions, *bars}):
            p, bar = self.positions.get(i), bars.get(i, {})
            if p:
                p.last = bar if bar.get("close") is not None else p.last
                seen = p.last
                if seen.get("until") is not None and session > seen["until"] or i in sells or seen.get("close") is None:
                    continue
                if seen.get("exit_rule") or seen["close"] <= p.stop:
                    self.orders.append({"id": i, "side": "SELL", "qty": p.qty, "stop": None, "due": session + 1, "turnover": seen.get("turnover"), "sector": p.sector, "last": seen})
            elif bar.get("enter_ok") and i not in buys and bar.get("atr") and bar.get("close"):
                price, mult = bar["close"], risk["atr_mult_stop"]
                stop = max(0.0, price - mult * bar["atr"])
                if count >= risk["max_open_positions"] or not calm or price - stop <= 0:
                    continue
                qty = math.floor(equity * risk["risk_per_trade"] / (price - stop))
                budgets = [risk["max_exposure_per_name"] * equity - by_name.get(i, 0.0), risk["max_total_exposure"] * equity - sum(by_name.values()), cash]
                if bar["sector"] is not None and "max_exposure_per_sector" in risk:
                    budgets.append(risk["max_exposure_per_sector"] * equity - by_sector.get(bar["sector"], 0.0))
                qty = min([qty, *(math.floor(b / price) if b > 0 else 0 for b in budgets)])
                if qty <= 0:
                    continue
                self.orders.append({"id": i, "side": "BUY", "qty": qty, "stop": stop, "due": session + 1, "turnover": bar.get("turnover"), "sector": bar["sector"], "last": bar})
                buys[i] = self.orders[-1]
                add(i, bar["sector"], price * qty)
                count += 1

    def step(self, session: int, bars: dict[int, dict], risk: dict, costs: Costs, last: bool = False) -> list[dict]:
        """A session: its actions, due fills, marks and, unless it is the last one, decisions; what happened, in order."""
        for i, bar in bars.items():
            for a in bar.get("actions") or []:
                self.action(i, a["kind"], a["value"], bar.get("close_before"))
        out = self.settle(session, bars, costs)
        equity, held = self.mark(bars, risk["atr_mult_stop"])
        if last:
            for i, p in list(self.positions.items()):
                bar = bars.get(i, {})
                if bar.get("close") is None:
                    continue
                qty, paid, fee = costs.fill(False, p.qty, bar["close"], bar.get("volume") or 0.0, bar.get("turnover"))
                if qty:
                    self.cash += paid * qty - fee
                    out.append({"kind": "CLOSE", "id": i, "qty": qty, "price": paid, "fee": fee, "pnl": (paid - p.entry) * qty - fee})
                    p.qty -= qty
                    if p.qty <= 0:
                        del self.positions[i]
            held = sum(bars[i]["close"] * p.qty for i, p in self.positions.items() if bars.get(i, {}).get("close") is not None)
            equity = self.cash + held
        else:
            self.decide(session, bars, equity, risk)
        out.append({"kind": "equity", "equity": equity, "cash": self.cash, "exposure": held / equity if equity > 0 else 0.0})
        return out


class Replay:
    """A book fed with rows in the order of sessions; sessions without a row happen too."""

    def __init__(self, risk: dict, costs: Costs, capital: float, first: int, last: int | None = None):
        self.risk, self.costs, self.last = risk, costs, last
        self.book, self.at, self.today = Book(capital, capital), first, {}

    def before(self, session: int) -> list[dict]:
        """Lets all sessions before the given one happen; only the first of them can have rows."""
        out = []
        while self.at < session:
            out += [{"session": self.at} | e for e in self.book.step(self.at, self.today, self.risk, self.costs, self.at == self.last)]
            self.at, self.today = self.at + 1, {}
        return out

    def feed(self, row: dict) -> list[dict]:
        out = self.before(row["session"])
        self.today[row["id"]] = row
        return out

    def dump(self) -> str:
        """The state between sessions, as JSON."""
        return json.dumps({"at": self.at, "book": asdict(self.book)})

    def load(self, state: str) -> None:
        held = json.loads(state)
        b = held["book"]
        self.at = held["at"]
        self.book = Book(b["cash"], b["peak"], {int(i): Position(**p) for i, p in b["positions"].items()}, b["orders"])
