"""Declarative rules, given as dicts (from YAML), compiled into columns."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le, "eq": operator.eq}
MODEL_PREFIX = "llm_"

#: The trend strategy (fixed values): long above the 200-row average with rising half-year momentum.
TREND = {
    "name": "trend_momentum",
    "version": 1,
    "entry": {"all": [{"feature": "close_vs_sma200", "op": "gt", "value": 0.0}, {"feature": "momentum_6m", "op": "gt", "value": 0.0}]},
    "exit": {"any": [{"type": "atr_stop", "atr_mult": 2.5}, {"feature": "close_vs_sma200", "op": "lt", "value": 0.0}]},
    "risk": {"risk_per_trade": 0.01, "atr_mult_stop": 2.5, "max_open_positions": 8, "max_exposure_per_name": 0.20, "max_exposure_per_sector": 0.40, "max_total_exposure": 1.0, "drawdown_circuit_breaker": 0.25},
}


def condition(rule: dict[str, Any], stop: Column | None = None) -> Column:
    """One condition; an undefined feature fails it. atr_stop compares the close with stop and fails where there is none."""
    kind = rule.get("type")
    if kind == "atr_stop":
        return F.coalesce(F.col("close") <= stop, F.lit(False)) if stop is not None else F.lit(False)
    if kind is not None:
        raise ValueError(f"unknown condition type {kind!r}")
    if rule["op"] not in OPS:
        raise ValueError(f"unknown operator {rule['op']!r}")
    return F.coalesce(OPS[rule["op"]](F.col(rule["feature"]).cast("double"), F.lit(float(rule["value"]))), F.lit(False))


def clause(rules: dict[str, list], stop: Column | None = None) -> Column:
    """All of the conditions under "all", or else any of those under "any": none given is true, or false. One of the two must be there."""
    if "all" in rules:
        return reduce(operator.and_, (condition(r, stop) for r in rules["all"]), F.lit(True))
    if "any" in rules:
        return reduce(operator.or_, (condition(r, stop) for r in rules["any"]), F.lit(False))
    raise ValueError("a clause has neither all nor any")


def signal(strategy: dict[str, Any], held: Column, stop: Column | None = None) -> Column:
    """EXIT where a position is held and the exit clause holds, ENTER where none is and the entry clause does, else HOLD.

    A strategy without an entry or an exit clause never enters, or exits.
    """
    holds = lambda name: clause(strategy[name], stop) if strategy.get(name) else F.lit(False)
    return F.when(held & holds("exit"), "EXIT").when(~held & holds("entry"), "ENTER").otherwise("HOLD")


def features_read(rules: Any) -> set[str]:
    """The features that a strategy's clauses read, whatever their nesting."""
    found, rest = set(), [rules]
    while rest:
        part = rest.pop()
        if isinstance(part, dict):
            if isinstance(part.get("feature"), str):
                found.add(part["feature"])
            rest += part.values()
        elif isinstance(part, list):
            rest += part
    return found


def of_model(features: set[str]) -> bool:
    """Is any of the features one of the language-model store?"""
    return any(f.startswith(MODEL_PREFIX) for f in features)


def without_model_features(strategy: dict[str, Any]) -> dict[str, Any] | None:
    """The strategy whose entry clause is without conditions on the language-model store; its exit clause stays as it is.

    None if it has no entry clause, or none of its conditions is left.
    """
    left = {k: [r for r in v if not of_model(features_read(r))] for k, v in (strategy.get("entry") or {}).items()}
    return strategy | {"entry": left} if any(left.values()) else None


def radar(features: DataFrame, strategy: dict[str, Any], score: str = "llm_score") -> DataFrame:
    """date, permit, veto, no_score: of the rows that would enter without the model's conditions, how many the whole rule lets
    in, how many a score keeps out, and how many have no score. No row if nothing is left without these conditions."""
    plain = without_model_features(strategy)
    if plain is None:
        return features.select("date").limit(0).selectExpr("date", "0L as permit", "0L as veto", "0L as no_score")
    d = features.filter(clause(plain["entry"])).select("date", clause(strategy["entry"]).alias("in"), F.col(score).isNull().alias("none"))
    return d.groupBy("date").agg(F.count_if(F.col("in")).alias("permit"), F.count_if(~F.col("in") & ~F.col("none")).alias("veto"), F.count_if(~F.col("in") & F.col("none")).alias("no_score"))
