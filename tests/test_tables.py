"""Stored tables: batches that run twice, that are killed, that meet; and what is read of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook import tables
from tidebook.operators import pairing, snapshots, stored
from tidebook.storage import scratch
from tidebook.tables import Conflict, Table

SCHEMA = "id long, name string, n long"


def rows(d):
    return sorted(map(tuple, d.collect()), key=str)


def made(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_upsert_twice_is_once(spark):
    t = Table(spark, scratch(spark, "t"), ["id"], buckets=3)
    assert t.read() is None
    t.upsert(made(spark, (1, "a", 1), (2, "b", 1), (None, "c", 1)))
    for _ in range(2):
        t.upsert(made(spark, (2, "x", 5), (2, "y", 7), (3, "z", 1), (None, "d", 2)), F.col("n"))
    assert rows(t.read()) == sorted([(1, "a", 1), (2, "y", 7), (3, "z", 1), (None, "d", 2)], key=str)
    assert rows(Table(spark, t.path, ["id"]).read(1)) == sorted([(1, "a", 1), (2, "b", 1), (None, "c", 1)], key=str)


def test_a_named_batch_is_written_once(spark):
    t = Table(spark, scratch(spark, "t"), ["id"])
    assert t.upsert(made(spark, (1, "a", 1)), batch=("s", 0))
    assert not t.upsert(made(spark, (1, "other", 1)), batch=("s", 0))
    assert t.upsert(made(spark, (1, "b", 1)), batch=("s", 1))
    assert rows(t.read()) == [(1, "b", 1)]


def test_a_killed_batch_leaves_the_old_version(spark, monkeypatch):
    t = Table(spark, scratch(spark, "t"), ["id"])
    t.upsert(made(spark, (1, "a", 1), (2, "b", 1)))
    with monkeypatch.context() as mp:
        mp.setattr(Table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.upsert(made(spark, (1, "x", 1), (5, "y", 1)))
        with pytest.raises(RuntimeError):
            t.overwrite(made(spark, (9, "x", 1)))
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 1)] and t.versions() == [1]
    t.upsert(made(spark, (1, "x", 1)))
    t.vacuum(1)
    assert rows(t.read()) == [(1, "x", 1), (2, "b", 1)] and t.versions() == [2]
    assert len(t._fs.listStatus(t._at("data"))) <= 2  # what killed batches left is gone


def test_of_two_batches_at_a_time_one_fails(spark, monkeypatch):
    t = Table(spark, scratch(spark, "t"), ["id"])
    t.upsert(made(spark, (1, "a", 1)))
    write = Table._write

    def slow(self, d):
        out = write(self, d)
        if not slow.done:
            slow.done = True
            Table(spark, t.path, ["id"]).upsert(made(spark, (2, "first", 1)))
        return out

    slow.done = False
    monkeypatch.setattr(Table, "_write", slow)
    with pytest.raises(Conflict):
        t.upsert(made(spark, (1, "second", 1)))
    assert rows(t.read()) == [(1, "a", 1), (2, "first", 1)]


def test_only_touched_buckets_are_written(spark):
    t = Table(spark, scratch(spark, "t"), ["id"], buckets=8)
    t.upsert(spark.range(200).select("id", F.lit("a").alias("name"), F.lit(1).cast("long").alias("n")))
    before = t.manifest()["folders"]
    t.upsert(made(spark, (7, "b", 2)))
    after = t.manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 200


def test_first_write_wins_and_reads_stay_bounded(spark, monkeypatch):
    t = Table(spark, scratch(spark, "t"), ["id"], buckets=32)
    read = []
    one = Table._rows
    monkeypatch.setattr(Table, "_rows", lambda self, m, b: read.append(len([f for k, fs in m["folders"].items() if b is None or int(k) in b for f in fs])) or one(self, m, b))
    for k in range(12):
        new = spark.range(k * 50, k * 50 + 3).select("id", F.lit(f"batch {k}").alias("name"), F.lit(k).cast("long").alias("n"))
        t.insert_first(new.unionByName(made(spark, (1, f"late {k}", -k - 1))), F.col("n"))
    looked = max(read)
    got = {r["id"]: r["name"] for r in t.read().collect()}
    assert got[1] == "late 0" and got[100] == "batch 2" and len(got) == 36
    assert looked <= 4 * (tables.MOST_FOLDERS + 1)  # four keys touch four buckets at most, however much is stored


def test_replace_takes_groups_whole(spark):
    t = Table(spark, scratch(spark, "t"), ["id", "name"], by=["name"], buckets=2)
    t.replace(made(spark, (1, "a", 1), (2, "a", 1), (1, "b", 1)))
    t.replace(made(spark, (3, "a", 1)))
    assert rows(t.read()) == [(1, "b", 1), (3, "a", 1)]


def test_empty_batches(spark):
    t = Table(spark, scratch(spark, "t"), ["id"])
    for write in (t.upsert, t.replace, lambda d: t.insert_first(d, F.col("n"))):
        write(made(spark, (1, "a", 1)).limit(0))
    assert t.read().count() == 0
    t.insert_first(made(spark, (1, "a", 1)), F.col("n"))
    t.upsert(made(spark, (1, "a", 1)).limit(0))
    assert rows(t.read()) == [(1, "a", 1)]


def test_bars_need_a_source_and_do_not_mix(spark):
    t = stored.bars_table(spark, scratch(spark, "bars"))
    bars = spark.createDataFrame([(1, "2024-01-02", 5.0)], "instrument_id int, date string, close double")
    with pytest.raises(TypeError):
        stored.store_bars(t, bars)
    with pytest.raises(ValueError):
        stored.store_bars(t, bars, source="rumour")
    stored.store_bars(t, bars, source="gpw")
    with pytest.raises(ValueError):
        stored.store_bars(t, bars, source="demo")
    stored.store_bars(t, bars.withColumn("close", F.lit(6.0)), source="stooq")
    assert [(r["close"], r["source"], r["as_of_date"], r["adjusted"]) for r in t.read().collect()] == [(6.0, "stooq", "2024-01-02", False)]


def test_a_log_goes_on_with_its_ids(spark):
    t = Table(spark, scratch(spark, "log"), ["id"])
    d = spark.createDataFrame([("b",), ("a",)], "what string")
    assert stored.append_log(t, d, ("run", 1), F.col("what")) and not stored.append_log(t, d, ("run", 1), F.col("what"))
    stored.append_log(t, spark.createDataFrame([("c",)], "what string"), ("run", 2), F.col("what"))
    assert rows(t.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_unknown_labels_raise(spark):
    t = Table(spark, scratch(spark, "labels"), ["filing_id"])
    with pytest.raises(ValueError):
        stored.store_labels(t, spark.createDataFrame([(1, "splendid", 1)], "filing_id long, label string, labelled_at long"))


# --- snapshots ---------------------------------------------------------------------------------------------------------------


def test_a_snapshot_that_cannot_stand_in_is_named(spark):
    a, b = spark.range(3), spark.range(5)
    then, now = {"t": a, "w": a, "v": a, "m": b}, {"t": b, "u": a, "v": a.withColumn("x", F.lit(1)), "m": a}
    got = snapshots.compared(snapshots.described(then), snapshots.described(now))
    assert rows(got) == [("m", 5, 3, "more rows than now"), ("t", 3, 5, None), ("u", None, 3, "not in the snapshot"), ("v", 3, 3, "lacks x"), ("w", 3, None, "not known")]


def test_snapshots_outlive_later_batches_and_go_when_they_are_old(spark):
    tables = {"t": Table(spark, scratch(spark, "t"), ["id"], buckets=2), "none": Table(spark, scratch(spark, "none"), ["id"])}
    log = snapshots.log_table(spark, scratch(spark, "log"))
    at = lambda day: F.lit(f"2024-03-{day:02d}").cast("timestamp")
    for day in range(1, 6):
        tables["t"].upsert(made(spark, (day, "a", day)))
        snapshots.take(log, tables, at(day))
        snapshots.take(log, tables, at(day))  # again: the same snapshot
    assert log.read().count() == 5
    snapshots.retain(log, tables, daily=2, monthly=1)
    days = sorted(r["d"] for r in log.read().select(F.dayofmonth("taken_at").alias("d")).collect())
    assert days == [1, 4, 5] and tables["t"].versions() == [1, 4, 5]
    assert [snapshots.restore(log, tables, at(d))["t"].count() for d in (1, 3, 4, 9)] == [1, 1, 4, 5]
    assert snapshots.restore(log, tables, F.lit("2020-01-01").cast("timestamp")) == {}


# --- pairing in the order of a queue -------------------------------------------------------------------------------------


def replay(decisions, dates):
    """The queue, decision by decision."""
    at, waiting, out, n = {d: i for i, d in enumerate(dates)}, {}, [], {}
    for ticker, date, seq, action in sorted((d for d in decisions if d[1] in at), key=lambda d: (d[0], d[1], d[2], d[3] != "ENTER")):
        q = waiting.setdefault(ticker, [])
        if action == "ENTER":
            n[ticker] = n.get(ticker, 0) + 1
            q.append((n[ticker], date))
        elif action == "EXIT" and q:
            k, since = q.pop(0)
            out.append((ticker, k, since, date, max(1, at[date] - at[since])))
    return sorted(out + [(t, k, since, None, max(1, len(dates) - 1 - at[since])) for t, q in waiting.items() for k, since in q], key=str)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_pairs_equal_a_queue(spark, block):
    r = random.Random(block)
    dates = [f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}" for k in range(100)]
    flow = [(r.choice("abc"), r.choice([*dates, "2030-01-01"]), r.randrange(5), r.choice(["ENTER", "EXIT", "EXIT", "HOLD"])) for _ in range(500)]
    flow += [("d", dates[0], 1, "ENTER"), ("d", dates[2], 1, "ENTER"), ("d", dates[5], 1, "EXIT"), ("d", dates[9], 1, "EXIT"), ("e", dates[3], 1, "EXIT")]
    d = spark.createDataFrame(flow, "ticker string, date string, seq int, action string")
    sessions = spark.createDataFrame([(x, i) for i, x in enumerate(dates)], "date string, session long")
    got = pairing.pair_trades(d, sessions, block)
    found = sorted(map(tuple, got.select("ticker", "entry", "entered", "exited", "sessions").collect()), key=str)
    assert found == replay(flow, dates)
    assert [x[4] for x in found if x[0] == "d"] == [5, 7]


def test_no_trade_counts_as_one_session(spark):
    d = spark.createDataFrame([("a", "2024-01-01", 1, "EXIT")], "ticker string, date string, seq int, action string")
    sessions = spark.createDataFrame([("2024-01-01", 0)], "date string, session long")
    assert rows(pairing.holdings(pairing.pair_trades(d, sessions))) == [(1,)]
    assert rows(pairing.holdings(pairing.pair_trades(d.limit(0), sessions))) == [(1,)]
