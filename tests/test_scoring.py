"""The scoring job against a sequential replay, and runs that die."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebook.operators import scoring
from tidebook.storage import scratch

SCHEMA = "filing_id long, published_at timestamp, full_text string, processed boolean, attempts int"
AS_OF = datetime(2024, 5, 20)


def made(n, seed):
    r = random.Random(seed)
    start = datetime(2024, 5, 1)
    texts = [None, "", *("word " * r.randint(1, 30) + str(k) for k in range(n // 2))]
    return [(i, start + timedelta(hours=r.randrange(500)), r.choice(texts), False, r.choice([0, 0, 0, 1])) for i in range(n)]


def answer(text):
    return {"relevance": "relevant", "sentiment": len(text) / 100, "confidence": 0.5, "quote": text[:5]}


def replay(rows, fails, cap, runs):
    """Filing by filing: what each run asks for, what it costs, and what becomes of the filings."""
    state = {i: [a, False] for i, _, _, _, a in rows}
    answers, calls = {}, []
    for run in range(runs):
        spent, ahead, failed = sum(1.0 + len(t) for t in answers), 0.0, set()
        wait = sorted((r for r in rows if not state[r[0]][1] and r[1] <= AS_OF), key=lambda r: (r[1], r[0]))
        claimed = set()
        for i, _, t, *_ in wait:
            t = t or ""
            if t in answers or t in claimed:
                continue
            claimed.add(t)
            if spent + ahead < cap:
                calls.append((run, t))
                if fails(run, t):
                    failed.add(t)
                else:
                    answers[t] = answer(t)
            ahead += 1.0 + len(t)
        for i, _, t, *_ in wait:
            if (t or "") in answers:
                state[i][1] = True
            elif (t or "") in failed:
                state[i][0] += 1
                state[i][1] = state[i][0] >= 3
    return state, answers, calls


@pytest.mark.parametrize("cap", [400.0, 1e9])
def test_three_runs_equal_a_replay(spark, tmp_path, cap):
    rows, log = made(60, 3), str(tmp_path)
    stored = scoring.tables(spark, scratch(spark, "job"), buckets=4)
    stored["filings"].upsert(spark.createDataFrame(rows, SCHEMA))
    usd = 1.0 + F.length(F.coalesce("full_text", F.lit("")))

    def fails(run, t):
        return (int(hashlib.sha256(t.encode()).hexdigest(), 16) + run) % 3 == 0

    for run in range(3):

        def score(t, run=run):
            with open(f"{log}/calls", "a") as f:
                f.write(f"{run} {hashlib.sha256(t.encode()).hexdigest()}\n")
            if (int(hashlib.sha256(t.encode()).hexdigest(), 16) + run) % 3 == 0:
                raise ConnectionError("no")
            return {"relevance": "relevant", "sentiment": len(t) / 100, "confidence": 0.5, "quote": t[:5]}

        scoring.run(stored, score, F.lit(AS_OF), cap, usd, steps=3)
    state, answers, calls = replay(rows, fails, cap, 3)
    got = {r["filing_id"]: [r["attempts"], r["processed"]] for r in stored["filings"].read().collect()}
    assert got == state
    by_hash = {r["input_hash"]: r["usd"] for r in stored["answers"].read().collect()}
    assert by_hash == {hashlib.sha256(t.encode()).hexdigest(): 1.0 + len(t) for t in answers}
    texts = {i: t or "" for i, _, t, *_ in rows}
    scores = {r["filing_id"]: r["sentiment"] for r in stored["scores"].read().collect()}
    assert scores == {i: len(texts[i]) / 100 for i in texts if texts[i] in answers and state[i][1]}
    with open(f"{log}/calls") as f:
        assert sorted(f.read().split("\n")[:-1]) == sorted(f"{run} {hashlib.sha256(t.encode()).hexdigest()}" for run, t in calls)


def test_a_run_that_dies_keeps_the_answers_of_its_steps(spark, tmp_path, monkeypatch):
    rows, log = [r for r in made(30, 5) if r[1] <= AS_OF], str(tmp_path)
    stored = scoring.tables(spark, scratch(spark, "job"), buckets=2)
    stored["filings"].upsert(spark.createDataFrame(rows, SCHEMA))

    def score(t):
        with open(f"{log}/calls", "a") as f:
            f.write(hashlib.sha256(t.encode()).hexdigest() + "\n")
        return {"relevance": "relevant", "sentiment": 0.0, "confidence": 0.5, "quote": ""}

    with monkeypatch.context() as mp:
        mp.setattr(type(stored["scores"]), "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            scoring.run(stored, score, F.lit(AS_OF), 1e9, F.lit(1.0))
    scoring.run(stored, score, F.lit(AS_OF), 1e9, F.lit(1.0))
    with open(f"{log}/calls") as f:
        calls = f.read().split()
    assert len(calls) == len(set(calls)) == len({r[2] or "" for r in rows})
    assert stored["filings"].read().filter("not processed").count() == 0 and stored["scores"].read().count() == len(rows)


def test_nothing_waits(spark):
    stored = scoring.tables(spark, scratch(spark, "job"), buckets=2)
    stored["filings"].upsert(spark.createDataFrame([(1, datetime(2030, 1, 1), "x", False, 0)], SCHEMA))
    scoring.run(stored, lambda t: {}, F.lit(AS_OF), 1e9, F.lit(1.0), steps=1)
    assert stored["scores"].read().count() == 0 and not stored["filings"].read().first()["processed"]


def test_a_run_writes_marks_and_no_texts(spark):
    stored = scoring.tables(spark, scratch(spark, "job"), buckets=2)
    stored["filings"].upsert(spark.createDataFrame([(1, datetime(2024, 5, 1), "x", False, 0), (2, datetime(2024, 5, 1), "y", False, 2)], SCHEMA))
    scoring.run(stored, lambda t: {"relevance": "relevant", "sentiment": 0.0, "confidence": 0.5, "quote": t} if t == "x" else None, F.lit(AS_OF), 1e9, F.lit(1.0), steps=1)
    assert sorted(map(tuple, stored["filings"].read().select("filing_id", "full_text", "processed", "attempts").collect())) == [(1, "x", True, 0), (2, "y", True, 3)]
    assert stored["filings"].whole.versions() == [1] and "full_text" not in stored["filings"].marks.read().columns
    stored["filings"].upsert(spark.createDataFrame([(2, datetime(2024, 5, 1), "z", False, 0)], SCHEMA))  # what is written anew has its own marks
    assert [tuple(r) for r in stored["filings"].read().filter("filing_id = 2").select("full_text", "processed", "attempts").collect()] == [("z", False, 0)]
