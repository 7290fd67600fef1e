"""Prices of fills, costs, sizes and adjustments: as columns, and as the same formulas on plain numbers for folds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 1e-4
#: Fixed values of the cost model: floor of median turnover, spread and slippage in basis points.
TIERS = ((0.0, 250.0, 80.0), (250_000.0, 120.0, 40.0), (1_000_000.0, 60.0, 25.0), (5_000_000.0, 35.0, 15.0), (20_000_000.0, 20.0, 10.0))


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 38.0
    commission_min: float = 3.0
    spread_bps: float = 20.0
    slippage_bps: float = 10.0
    participation: float = 0.10
    tiers: tuple[tuple[float, float, float], ...] = TIERS

    def rates(self, turnover: float | None) -> tuple[float, float]:
        """spread and slippage of the highest tier whose floor the turnover reaches; of the lowest one if it is unknown."""
        if not self.tiers:
            return self.spread_bps, self.slippage_bps
        reached = [t for t in self.tiers if turnover is not None and turnover >= t[0]]
        best = max(reached, default=min(self.tiers))
        return best[1], best[2]

    def fill(self, buy: bool, wanted: int, price: float, volume: float, turnover: float | None, tiered: bool = True) -> tuple[int, float, float]:
        """(quantity, price, fee) of an order against a bar; nothing where the volume allows none."""
        if wanted <= 0 or price <= 0:
            return 0, 0.0, 0.0
        qty = max(0, min(wanted, math.floor(max(0.0, volume) * self.participation)))
        if not qty:
            return 0, 0.0, 0.0
        spread, slip = self.rates(turnover) if tiered else (self.spread_bps, self.slippage_bps)
        cost = price * (spread * BPS) / 2.0 + price * (slip * BPS)
        paid = max(0.0, price + cost if buy else price - cost)
        return qty, paid, max(paid * qty * (self.commission_bps * BPS), self.commission_min)


def commission(notional: Column, c: Costs = Costs()) -> Column:
    return F.greatest(notional * (c.commission_bps * BPS), F.lit(c.commission_min))


def tier_rates(turnover: Column, c: Costs = Costs()) -> Column:
    """struct(spread_bps, slippage_bps) of a turnover's tier; unknown turnover has the lowest."""
    pair = lambda t: F.struct(F.lit(t[1]).alias("spread_bps"), F.lit(t[2]).alias("slippage_bps"))
    low, *higher = sorted(c.tiers)
    out = None
    for t in reversed(higher):
        out = F.when(turnover >= t[0], pair(t)) if out is None else out.when(turnover >= t[0], pair(t))
    return out.otherwise(pair(low)) if out is not None else pair(low)


def volume_cap(wanted: Column, volume: Column, c: Costs = Costs()) -> Column:
    most = F.floor(F.greatest(volume, F.lit(0.0)) * c.participation)
    return F.greatest(F.least(wanted, most), F.lit(0)).cast("long")


def fill(side: Column, wanted: Column, price: Column, volume: Column, turnover: Column, c: Costs = Costs()) -> dict[str, Column]:
    """qty, price, fee, slippage, capped of an order against a bar."""
    qty = F.when((wanted > 0) & (price > 0), volume_cap(wanted, volume, c)).otherwise(F.lit(0)).cast("long")
    rates = tier_rates(turnover, c)
    cost = price * (rates["spread_bps"] * BPS) / 2.0 + price * (rates["slippage_bps"] * BPS)
    paid = F.greatest(F.when(side == "BUY", price + cost).otherwise(price - cost), F.lit(0.0))
    some = lambda x: F.when(qty > 0, x).otherwise(0.0)
    return {"qty": qty, "price": some(paid), "fee": some(commission(paid * qty, c)), "slippage": some(cost * qty), "capped": qty < wanted}


def first_stop(price: Column, atr: Column, mult: float) -> Column:
    return F.greatest(price - atr * mult, F.lit(0.0))


def ratchet(stop: Column, close: Column, atr: Column, mult: float) -> Column:
    """A stop that only rises."""
    return F.greatest(stop, close - atr * mult)


def size(price: Column, atr: Column, equity: Column, peak: Column, cash: Column, open_positions: Column, used_name: Column, used_sector: Column, used_total: Column, risk: dict) -> dict[str, Column]:
    """qty, stop and reject (null if accepted) of a new position, given the book's state."""
    m = float(risk["atr_mult_stop"])
    stop = first_stop(price, atr, m)
    by_value = lambda q, budget: F.when(budget <= 0, F.lit(0)).otherwise(F.greatest(F.least(q, F.floor(F.try_divide(budget, price))), F.lit(0)))
    budget = F.floor(F.try_divide(equity * float(risk["risk_per_trade"]), price - stop))
    qty = by_value(budget, equity * float(risk["max_exposure_per_name"]) - used_name)
    if "max_exposure_per_sector" in risk:
        qty = by_value(qty, equity * float(risk["max_exposure_per_sector"]) - used_sector)
    qty = by_value(by_value(qty, equity * float(risk["max_total_exposure"]) - used_total), cash)
    fall = F.when(peak > 0, 1 - equity / peak).otherwise(0.0)
    reject = (
        F.when(~F.coalesce((price > 0) & (atr > 0), F.lit(False)), "invalid_price_or_atr")
        .when(open_positions >= int(risk["max_open_positions"]), "max_open_positions")
        .when(fall > float(risk["drawdown_circuit_breaker"]), "drawdown_circuit_breaker")
        .when(price - stop <= 0, "non_positive_stop_distance")
        .when(budget <= 0, "risk_budget_too_small")
        .when(qty <= 0, "exposure_or_cash_limit")
    )
    return {"qty": F.when(reject.isNull(), qty).otherwise(0).cast("long"), "stop": stop, "reject": reject}


def price_factor(kind: Column, value: Column, close: Column) -> Column:
    """What an action multiplies earlier prices by: 1 / ratio of a split, the factor of a rights issue, what a dividend leaves of the close before (1 without one)."""
    return (
        F.when(kind == "split", F.try_divide(F.lit(1.0), value))
        .when(kind == "rights_issue", value)
        .when(kind == "dividend", F.when(close > 0, F.greatest((close - value) / close, F.lit(0.0))).otherwise(1.0))
    )
