"""The normal distribution, deflated Sharpe ratios and the registry of trials."""

from __future__ import annotations

import math
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions import normal
from tidebook.operators import metrics

N = NormalDist()


def test_distribution_and_quantile_equal_the_standard_library(spark):
    z = [k / 100 for k in range(-3600, 3601, 7)]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in z], "z double").select(normal.cdf(F.col("z"))).collect()]
    exact = [0.5 * math.erfc(-x / math.sqrt(2)) for x in z]
    assert got == pytest.approx(exact, rel=1e-6, abs=1e-15)  # far out, the fraction is cut after four terms
    assert [g for g, x in zip(got, z, strict=True) if abs(x) < 7] == pytest.approx([e for e, x in zip(exact, z, strict=True) if abs(x) < 7], rel=1e-11)
    p = [1e-200, 1e-12, 0.0003, 0.02425, 0.5, 0.9, 0.97575, 0.99999, *(k / 500 for k in range(1, 500))]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in p], "p double").select(normal.quantile(F.col("p"))).collect()]
    assert got == pytest.approx([N.inv_cdf(x) for x in p], rel=1e-9, abs=1e-12)
    assert got[8:] == pytest.approx([N.inv_cdf(x) for x in p[8:]], rel=1e-12, abs=1e-14)


def test_outside_the_domain_is_null(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.5,), (None,)], "p double")
    assert [x[0] for x in d.select(normal.quantile(F.col("p"))).collect()] == [None] * 5
    d = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),)], "z double")
    assert [x[0] for x in d.select(normal.cdf(F.col("z"))).collect()] == [None, 1.0, 0.0]


def curves(spark, runs):
    start = date(2024, 1, 1)
    return spark.createDataFrame([(k, start + timedelta(i), float(x)) for k, e in runs.items() for i, x in enumerate(e)], "run_id string, date date, equity double")


def replay(equity, n, variance):
    r = pd.Series(equity).pct_change().dropna()
    sharpe = r.mean() / r.std(ddof=0) if len(r) >= 2 and r.std(ddof=0) else 0.0
    skew, kurt = (r.skew() if len(r) > 2 else 0.0), (r.kurt() + 3 if len(r) > 3 else 3.0)
    g = metrics.EULER_GAMMA
    bar = math.sqrt(variance) * ((1 - g) * N.inv_cdf(1 - 1 / n) + g * N.inv_cdf(1 - 1 / (n * math.e))) if n > 1 and variance > 0 else 0.0
    spread = math.sqrt(max(1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2, 1e-12))
    return bar, N.cdf((sharpe - bar) * math.sqrt(len(r) - 1) / spread) if len(r) >= 2 else 0.0


def test_deflated_sharpe_of_many_runs_and_registries(spark):
    rng = np.random.default_rng(2)
    runs = {f"r{k}": 100 * np.cumprod(1 + rng.normal(0.001, 0.01, 60)) for k in range(4)} | {"short": [100.0, 101.0], "one": [100.0]}
    c = curves(spark, runs).withColumn("desk", F.when(F.col("run_id") == "r3", "b").otherwise("a"))
    trials = spark.createDataFrame([("a", 17, 0.0004), ("b", 1, 0.5)], "desk string, n_trials long, variance double")
    got = {x["run_id"]: x for x in metrics.deflated_sharpe(c, trials, ("desk",)).collect()}
    for k, e in runs.items():
        if k in got:
            bar, dsr = replay(e, *((1, 0.5) if k == "r3" else (17, 0.0004)))
            assert got[k]["sr_star"] == pytest.approx(bar, rel=1e-9) and got[k]["dsr"] == pytest.approx(dsr, rel=1e-6, abs=1e-12)
    assert {"r0", "r1", "r2", "r3", "short"} <= got.keys() and got["short"]["dsr"] == 0.0


def test_runs_in_sample_are_neither_logged_nor_judged(spark):
    rng = np.random.default_rng(3)
    e = {k: 100 * np.cumprod(1 + rng.normal(0.001, 0.01, 40)) for k in ("in", "out", "also")}
    runs = spark.createDataFrame([("in", "A", 0), ("out", "B", 3), ("also", "C", 2)], "run_id string, config_hash string, walk_forward_windows int")
    stored = spark.createDataFrame([(1, "B", '{"sharpe_pp": 9.0}'), (2, "D", '{"sharpe_pp": 0.01}')], "id long, config_hash string, metrics string")
    found, log = metrics.validated(curves(spark, e), runs, stored)
    rows = {r["id"]: r["config_hash"] for r in log.collect()}
    assert rows == {1: "B", 2: "D", 3: "C", 4: "B"}
    v = {k: replay(x, 1, 0)[0] or pd.Series(x).pct_change().dropna().pipe(lambda r: r.mean() / r.std(ddof=0)) for k, x in e.items()}
    variance = np.var([v["also"], v["out"], 0.01])
    got = {r["run_id"]: r for r in found.collect()}
    assert got.keys() == {"out", "also"} and all(r["n_trials"] == 3 for r in got.values())
    assert got["out"]["dsr"] == pytest.approx(replay(e["out"], 3, variance)[1], rel=1e-6)
    assert metrics.validated(curves(spark, e), runs.filter("walk_forward_windows = 0"), stored)[0].count() == 0
