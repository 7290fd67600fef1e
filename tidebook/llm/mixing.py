"""Mixing sources to target weights by balanced sampling (the cube method)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, dense_index, kept, small, text_key, text_of

#: Units that one task moves at once, and blocks whose undecided units meet in one task of the next level.
BLOCK, FAN = 4_096, 1_024


def size_of(column: str = "text") -> Column:
    """The number of words of a text; 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, n, target for each row (source, source_size, n) of sources.

    Sources by code point, null last, weigh weights in turn, repeating. Their targets share share times all sizes by
    weight, but none exceeds limit times its source's size; what is cut is shared anew among the others by weight until
    none is above. Sources stay a distributed table throughout; each round of sharing is one aggregation.
    """
    by_name = kept(sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").sortWithinPartitions("none", "source").withColumn("at", F.monotonically_increasing_id()), "sources")
    placed = by_name.select("source", "source_size", "n", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = kept(dense_index(placed, "place").select("source", "source_size", "n", w.alias("w")), "sources-weighed")
    total = held.agg(F.sum("source_size").cast("double").alias("t")).first()["t"] or 0.0
    level, before = 0.0, -1
    while True:
        full = F.col("source_size") * limit < F.col("w") * level
        r = held.agg(F.count_if(full).alias("k"), F.sum(F.when(full, F.col("source_size") * limit).otherwise(0.0)).alias("cut"), F.sum(F.when(~full, F.col("w")).otherwise(0.0)).alias("w")).first()
        if r["k"] == before or not r["w"]:
            break
        before, level = r["k"], (share * total - r["cut"]) / r["w"]
    return held.select("source", "source_size", "n", F.least(F.col("w") * level, F.col("source_size") * limit).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The flight phase: p is moved until at most two of it are fractions; the sums of p and of p * size stay.

    Three fractions at a time move along the null space of the two constraints, up or down by chances that keep their
    expectation, until one of them is 0 or 1. u: numbers in [0, 1) for the moves.
    """
    p = p.astype(float).copy()
    hand, step = [], 0
    for i in np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)).tolist():
        hand.append(i)
        while len(hand) == 3:
            a, b, c = (size[k] for k in hand)
            v = (c - b, a - c, b - a) if a != b or b != c else (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(hand, v, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(hand, v, strict=True) if x)
            move = up if u[step % len(u)] * (up + down) < down else -down
            step += 1
            for k, x in zip(hand, v, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + move * x))
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = round(p[k])
            hand = [k for k in hand if 0 < p[k] < 1]
    p[p <= 1e-9], p[p >= 1 - 1e-9] = 0.0, 1.0
    return p


def landing(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Decides all of p: flight, then the landing problem of the at most two fractions that are left.

    They are rounded so that the sum of sizes comes nearest, then that of counts; then the one exchange of a taken unit
    for another that best mends the sum of sizes is made, which leaves the count as it is.
    """
    want = float(p @ size)
    p = flight(p, size, u)
    left = np.flatnonzero((p > 0) & (p < 1)).tolist()
    sums, count = sum(p[i] * size[i] for i in left), sum(p[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(left) if m >> k & 1) - sums), abs(m.bit_count() - count), m))
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    off, on = np.flatnonzero(p == 0), np.flatnonzero(p == 1)
    if len(off) and len(on):
        off = off[np.argsort(size[off], kind="stable")]
        gap = want - float(p @ size)
        at = np.clip(np.searchsorted(size[off], size[on] + gap), 0, len(off) - 1)
        choices = [(abs(gap - size[off[k]] + size[j]), int(off[k]), int(j)) for a, j in zip(at, on, strict=True) for k in {max(a - 1, 0), a}]
        least, i, j = min(choices)
        if least < abs(gap):
            p[i], p[j] = 1.0, 0.0
    return p


def balanced(units: DataFrame, seed: int = 11, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """How often each unit is taken: doc_id, key, copy, source, n (units of the source), size, r become doc_id, key, source,
    size, copies: r without its fraction, or one more.

    Units of a source are dealt by hash into blocks of about block units; in each the flight phase leaves at most two
    fractions. Those of fan blocks meet in one task of the next level, until a source has one block, where landing()
    decides. So a source of any size is worked on in parallel, and totals of a source are kept but for the landing.
    Chances come from hashes of doc_id, key and copy and the seed, so reruns agree whatever the partitions.
    """

    def moved(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("size", "ascending"), ("copy", "ascending")])
        decide = landing if t["blocks"][0].as_py() <= 1 else flight
        p = decide(t["p"].to_numpy(), t["size"].to_numpy().astype(float), t["u"].to_numpy())
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).select(names)

    columns = ["source", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "doc_id", "copy", "size", "r", (F.col("r") - F.floor("r")).alias("p"), F.ceil(F.col("n") / block).cast("long").alias("blocks")]
    rest = units.select(*columns).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "a", "b", "copy"), "blocks"))
    names, schema = rest.columns, rest.schema
    done, level = [], 0
    while True:
        h = F.xxhash64(F.lit(seed + 1 + level), "doc_id", "a", "b", "copy")
        dealt = rest.withColumn("h", h).withColumn("u", F.shiftrightunsigned(F.xxhash64("h", F.lit(level)), 11).cast("double") / F.lit(float(1 << 53)))
        out = kept(dealt.groupBy("source", "block").applyInArrow(moved, schema), "flight")
        fractions = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.filter(~fractions))
        rest = out.filter(fractions).withColumn("block", F.floor(F.col("block") / fan).cast("long")).withColumn("blocks", F.ceil(F.col("blocks") / fan).cast("long"))
        level += 1
        if rest.isEmpty():
            break
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select("doc_id", F.struct("a", "b").alias("key"), "source", "size", (F.floor("r") + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, seed: int = 11) -> DataFrame:
    """How often the mix takes each document: doc_id, key, source, size, source_size, target, copies, one row for each row of docs.

    docs: doc_id, text, source. Every document of a source is taken floor(r) times, r = target / source_size, and once
    more with the chance that is left, decided by balanced(): the words and the documents that a source gives stay near
    their targets. A document without words (null, empty) is taken as if r were r of its source. Rows that agree in
    doc_id, text and source are told apart by a number only. Of a text only its size and two hashes are kept, however long it
    is; other columns of docs are left out. An empty table stays empty.
    """
    rows = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("source").cast("string").alias("source"), size_of().alias("size")), "sizes")
    goals = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, limit), "targets")
    same = rows.groupBy("doc_id", "key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    goal = small(goals.withColumnRenamed("source", "_s"))
    r = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("r")
    units = same.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "key", "source", "size", "n", r, F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    taken = balanced(kept(units, "units"), seed)
    return taken.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "key", "source", "size", "source_size", "target", "copies")
