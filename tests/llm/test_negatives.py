"""Hard negatives against brute force, over many clusters, slices and parts, and awkward tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tidebook.llm import negatives, q_negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, label int, v array<long>"


def brute(rows, is_anchor, floor=50, ceiling=95):
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        s = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va))
        for ps, p, _ in [x for x in s if x[2] == la][:5]:
            fits = [x for x in s if x[2] != la and floor * -ps <= 100 * -x[0] <= ceiling * -ps]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits[:3])]
    return sorted(out)


def made(n, size, seed, spread):
    r = random.Random(seed)
    middles = [[r.randint(-90, 90) for _ in range(size)] for _ in range(5)]
    return [(i, r.randrange(4), [int(m + r.gauss(0, spread)) for m in r.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("spread", [3, 60])
def test_equals_brute_force_whatever_the_slices(spark, spread):
    rows = made(400, 8, 4, spread) + [(1000, 1, [0] * 8), (1001, 1, [0] * 8), (1003, 2, [5, 5, 5]), (1005, 2, [4, 5, 5]), (1010, 1, [5, 5, 4])]
    d = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lambda i: i % 5 == 0)
    for slices, parts, clusters in ((10_000, 512, 3), (60, 7, 4), (25, 512, 1)):
        got = negatives.hard_negatives(d, F.col("id") % 5 == 0, clusters=clusters, sample=20, slice_rows=slices, part_rows=parts)
        assert sorted(map(tuple, got.collect())) == want


def test_equal_scores_go_by_id(spark):
    rows = [(i, i % 2, [10, 0]) for i in range(30)] + [(100 + i, 1, [8, i]) for i in range(10)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.hard_negatives(d, F.col("id") == 0, clusters=2, slice_rows=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 0)


def test_walk_ends_early_and_exactly():
    rng = np.random.default_rng(1)
    v = rng.integers(-5, 6, (9000, 4))
    v[:20] = 100
    listed = {"id": np.arange(9000), "label": np.zeros(9000, int), "v": v, "bound": np.linalg.norm(v, axis=1)}
    order = np.argsort(-listed["bound"], kind="stable")
    listed = {k: x[order] for k, x in listed.items()}
    members = {"id": np.array([-1]), "label": np.array([0]), "v": np.array([[1, 1, 1, 1]]), "need": np.array([[negatives.LOWEST]]), "most": np.array([[negatives.HIGHEST]])}
    looked = []
    listed["v"] = np.ndarray.view(listed["v"], type("Seen", (np.ndarray,), {"__getitem__": lambda self, k: looked.append(k) or np.asarray(self)[k]}))
    found = negatives.walk(members, listed, True, 5)
    assert [int(listed["id"][p]) for _, _, p, _ in found] == [0, 1, 2, 3, 4]
    assert len(looked) == 1  # one block of the list


def test_large_numbers_are_exact():
    a, b = np.array([[2**30, 1]]), np.array([[2**30, 1], [2**30, 2]])
    assert negatives.scores(a, b).tolist() == [[2**60 + 1, 2**60 + 2]]


def test_rows_that_take_no_part(spark):
    schema = "vec_id long, label int, embedding array<float>, v string, id string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.3, 0.4]), (3, None, [0.4, 0.4]), (4, 2, None), (5, 2, [0.4, None]), (6, 2, [nan, 0.4]), (8, 2, [inf, 0.4]), (None, 2, [0.3, 0.3]), (2, 2, [0.3, 0.4]), (9, 2, [])]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    used = negatives.usable(d, "vec_id", "embedding", F.col("label"))
    assert sorted(r["id"] for r in used.collect()) == [0, 1, 2, 2, 9]
    got = negatives.hard_negatives(used, F.col("id") == 0)
    assert [tuple(r)[:4] for r in got.collect()] == [(0, 1, 1, 2)]
    assert negatives.hard_negatives(used, F.col("id") == 77).count() == 0
    assert negatives.hard_negatives(used.limit(0), F.col("id") == 0).count() == 0


def test_query_equals_sql(spark):
    assert_same(q_negatives.op11_hard_negatives(spark, SF), q_negatives.OP11_SQL, SF)
