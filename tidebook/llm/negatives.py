"""Hard negatives by exact inner products: anchors in clusters, each with one list of candidates by angular bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined, kept

#: Rows of a list that are scored at once for all members that still walk it.
BLOCK = 1024
#: What bounds get on top, relative to lengths, for the rounding of angles.
SLACK = 1e-7
#: Scores that everything and nothing reaches.
LOWEST, HIGHEST = -(2**63), 2**63 - 1
_FOUND = "id long, target int, other long, score long"


@dataclass
class Clusters:
    """Directions (rows of unit length) by number of components; a vector belongs to the nearest one of its own number."""

    centres: dict[int, np.ndarray]
    offset: dict[int, int]

    @classmethod
    def fit(cls, rows: list[list[int]], n: int, rounds: int = 10) -> Clusters:
        """Spherical k-means of at most n directions each, begun with rows at even distances in their given order."""
        centres, offset, total = {}, {}, 0
        for size in sorted({len(r) for r in rows}):
            x = np.array([r for r in rows if len(r) == size], float).reshape(-1, size)
            x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
            c = x[np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(int))]
            for _ in range(rounds):
                near = (x @ c.T).argmax(axis=1)
                total_of = np.zeros_like(c)
                np.add.at(total_of, near, x)
                length = np.linalg.norm(total_of, axis=1)
                c = np.where((length > 0)[:, None], total_of / np.maximum(length, 1e-300)[:, None], c)
            centres[size], offset[size] = c, total
            total += len(c)
        return cls(centres, offset)

    def angles(self, vectors: list[np.ndarray], size: int) -> np.ndarray:
        """Angles between vectors of one size (rows) and its directions; a zero vector is at a right angle to all."""
        x = np.array(vectors, float).reshape(len(vectors), size)
        return np.arccos(np.clip((x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]) @ self.centres[size].T, -1.0, 1.0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by doubles where no sum can pass 2^53."""
    if np.linalg.norm(a.astype(float), axis=1).max(initial=0) * np.linalg.norm(b.astype(float), axis=1).max(initial=0) < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def walk(members: dict[str, np.ndarray], listed: dict[str, np.ndarray], same: bool, k: int) -> list[tuple[int, int, int, int]]:
    """(member, target, place, score) of each member's k best of each target along a list.

    members: id, label, v (rows of whole numbers), need and most (least and largest score of each target). listed: id,
    label, v and bound, by falling bound: no inner product with a vector of unit length in the members' cluster is
    larger. Only rows of the member's label (same), or of others, count, and never the member's own id. Higher scores
    come first, then smaller ids.

    A member ends its walk when the next bound is under what each of its targets still needs: its need, or its k-th score.
    Equal scores walk on, as a smaller id may come. So what is found is exact.
    """
    n, targets = members["need"].shape
    least = np.where(members["need"] <= members["most"], members["need"], HIGHEST)  # what a row must reach
    best: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(targets)] for _ in range(n)]
    length = np.linalg.norm(members["v"].astype(float), axis=1)
    for at in range(0, len(listed["id"]), BLOCK):
        bound = listed["bound"][at]
        go = np.flatnonzero(length * bound + 1e-6 >= least.min(axis=1))
        if not len(go):
            break
        part = slice(at, at + BLOCK)
        ids, s = listed["id"][part], scores(members["v"][go], listed["v"][part])
        fits = ((members["label"][go, None] == listed["label"][None, part]) == same) & (members["id"][go, None] != ids[None, :])
        for t in range(targets):
            hit = fits & (s >= least[go, t, None]) & (s <= members["most"][go, t, None])
            for g in np.flatnonzero(hit.any(axis=1)):
                m, places = go[g], np.flatnonzero(hit[g])
                if len(places) > 4 * k:  # all that can be among the k best
                    places = places[s[g, places] >= np.partition(s[g, places], len(places) - k)[len(places) - k]]
                new = best[m][t] + [(-int(s[g, p]), int(ids[p]), at + int(p)) for p in places]
                best[m][t] = new = sorted(new)[:k]
                if len(new) == k:
                    least[m, t] = max(least[m, t], -new[-1][0])
    return [(m, t, p, -s) for m in range(n) for t in range(targets) for s, _, p in best[m][t]]


def usable(rows: DataFrame, id_column: str, vector: str, label: Column) -> DataFrame:
    """id, label and v (floor of 256 times each component) of rows with an id, a label and a vector of finite components."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(256 * c).cast("long"))
    return rows.filter(fine).select(F.col(id_column).cast("long").alias("id"), label.cast("int").alias("label"), whole.alias("v"))


class Lists:
    """Candidates, dealt by a hash of their ids into slices of about slice_rows rows, and anchors, in clusters of at most
    part_rows members. The list of a cluster in a slice is the slice's candidates by falling bound."""

    def __init__(self, candidates: DataFrame, anchors: DataFrame, clusters: int, sample: int, slice_rows: int, part_rows: int) -> None:
        self.candidates, self.spark = candidates, candidates.sparkSession
        self.slices = max(1, -(-candidates.count() // slice_rows))
        drawn = anchors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # at most sample rows
        model = Clusters.fit([r["v"] for r in drawn], clusters)

        def placed(batches):
            for batch in batches:
                v = batch.column(batch.schema.get_field_index("v")).to_pylist()
                of, angle = np.full(len(v), -1, np.int32), np.zeros(len(v))
                for size in {len(x) for x in v}:
                    at = [i for i, x in enumerate(v) if len(x) == size]
                    if size in model.centres:
                        found = model.angles([v[i] for i in at], size)
                        of[at], angle[at] = model.offset[size] + found.argmin(axis=1), found.min(axis=1)
                    else:  # a number of components that the sample has not: one cluster of any angle
                        of[at], angle[at] = -1 - size, np.pi
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of), pa.array(angle)], names=["id", "label", "v", "cluster", "angle"])

        near = kept(anchors.select("id", "label", "v").mapInArrow(placed, "id long, label int, v array<long>, cluster int, angle double"), "anchors-near")
        sizes = near.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
        dealt = near.join(F.broadcast(sizes), "cluster").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))  # a row a cluster
        self.members = kept(dealt.select("id", "label", "v", "cluster", "part", "angle"), "anchors")
        self.model = model

    def search(self, wanted: DataFrame, same: bool, k: int, slices: Column | None = None) -> DataFrame:
        """(id, target, other, score): of each wanted anchor (id, need, most) the k best of each target in each slice.

        slices: which slices are searched, all by default. A candidate goes to the part of a cluster only if its bound
        reaches what a member of it needs.
        """
        m = self.members.join(wanted, "id")
        lengths = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        least = F.array_min(F.zip_with("need", "most", lambda a, b: F.when(a <= b, a).otherwise(HIGHEST))) / F.greatest(lengths, F.lit(1e-300))
        of_part = F.max("angle").alias("radius"), F.min(F.when(lengths > 0, least).otherwise(F.lit(float("-inf")))).alias("least"), F.min(F.size("v")).alias("size")
        heads = kept(m.groupBy("cluster", "part").agg(*of_part), "walk-heads")
        found = self._rows_of(heads, slices)
        every = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("slice")
        own = m.select("cluster", "part", "id", "label", "v", "need", "most", every)
        if slices is not None:
            own = own.filter(slices)

        def walked(key: tuple, members: pa.Table, listed: pa.Table) -> pa.Table:
            m = {c: members[c].to_numpy() for c in ("id", "label")} | {c: _matrix(members[c]) for c in ("v", "need", "most")}
            rows = {c: listed[c].to_numpy() for c in ("id", "label", "bound")} | {"v": _matrix(listed["v"])}
            order = np.lexsort((rows["id"], -rows["bound"]))
            rows = {c: x[order] for c, x in rows.items()}
            out = walk(m, rows, same, k) if len(members) and len(listed) else []
            columns = [pa.array([m["id"][i] for i, *_ in out], pa.int64()), pa.array([t for _, t, _, _ in out], pa.int32()), pa.array([rows["id"][p] for *_, p, _ in out], pa.int64()), pa.array([s for *_, s in out], pa.int64())]
            return pa.Table.from_arrays(columns, names=["id", "target", "other", "score"])

        keys = ["cluster", "part", "slice"]
        return own.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(walked, _FOUND)

    def _rows_of(self, heads: DataFrame, slices: Column | None) -> DataFrame:
        """cluster, part, slice, id, label, v and bound of each candidate and each of heads that it may matter to."""
        model, n_slices = self.model, self.slices
        c = self.candidates.select("id", "label", "v", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_slices)).cast("int").alias("slice"), F.size("v").alias("size"))
        if slices is not None:
            c = c.filter(slices)

        def angled(batches):
            for batch in batches:
                v = batch.column(2).to_pylist()
                out, length = [None] * len(v), np.zeros(len(v))
                for size in {len(x) for x in v}:
                    at = [i for i, x in enumerate(v) if len(x) == size]
                    x = np.array([v[i] for i in at], float).reshape(len(at), size)
                    length[at] = np.linalg.norm(x, axis=1)
                    if size in model.centres:
                        for i, row in zip(at, model.angles(list(x), size), strict=True):
                            out[i] = row.tolist()
                offset = [model.offset.get(len(x), 0) for x in v]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(out, pa.list_(pa.float64())), pa.array(offset, pa.int32())], names=[*batch.schema.names, "length", "angles", "offset"])

        near = c.mapInArrow(angled, "id long, label int, v array<long>, slice int, size int, length double, angles array<double>, offset int")
        of = F.get("angles", F.col("cluster") - F.col("offset"))
        beyond = F.coalesce(F.greatest(of - F.col("radius") - SLACK, F.lit(0.0)), F.lit(0.0))
        bound = F.col("length") * (F.cos(beyond) + SLACK)
        each = joined(near, heads, "size", "id")  # a row of heads for each part_rows anchors
        return each.withColumn("bound", bound).filter(F.col("bound") + 1e-6 >= F.col("least")).select("cluster", "part", "slice", "id", "label", "v", "bound")


def hard_negatives(rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, floor: int = 50, ceiling: int = 95, clusters: int = 16, sample: int = 4096, slice_rows: int = 8192, part_rows: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's positives.

    rows: id, label and v (whole numbers). anchors: which rows are anchors. A row's score is its inner product with the
    anchor. An anchor's positives are the n_positives other rows of its label of highest score, ties by smaller id; a
    positive's negatives the n_negatives rows of other labels of highest score between floor and ceiling hundredths of
    the positive's, ties by smaller id. Both are exact: see walk().

    Clusters are fitted to a bounded sample of anchors (sample, by hash); every anchor joins the nearest, whose radius
    covers it. The lists are dealt into slices of about slice_rows rows and the members into parts of at most about
    part_rows, so a task holds one of each, whatever the size of a cluster. Positives are sought first in one slice; what
    an anchor finds there, it needs at least in the others. Of several rows with one id the least (label, v) counts, so
    repeated rows count once. Vectors of different numbers of components are not compared. Zero vectors score 0.
    An empty table, or one without anchors, gives no row.
    """
    one = kept(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"), "vectors")
    own = one.filter(anchors)
    if own.isEmpty():
        return one.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    lists = Lists(one, own, clusters, sample, slice_rows, part_rows)

    def best(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("id", "target").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    array = lambda c: F.array(F.lit(c)).cast("array<long>")
    wanted = own.select("id", array(LOWEST).alias("need"), array(HIGHEST).alias("most"))
    found = kept(lists.search(wanted, True, n_positives, F.col("slice") == 0), "positives")
    if lists.slices > 1:
        known = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= n_positives, F.min("score")).otherwise(LOWEST).alias("low"))
        rest = own.select("id").join(known, "id", "left").select("id", F.array(F.coalesce("low", F.lit(LOWEST))).alias("need"), array(HIGHEST).alias("most"))
        found = kept(found.unionByName(lists.search(rest, True, n_positives, F.col("slice") > 0)), "positives")
    positives = kept(best(found, n_positives).select("id", (F.col("rank") - 1).alias("target"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # floor(n * score / 100) of whole numbers, and the same upwards
    under = lambda n: f"transform(p, x -> ({n}L * x.positive_score - pmod({n}L * x.positive_score, 100L)) div 100L)"
    least, most = F.transform(F.expr(under(-floor)), lambda x: -x), F.expr(under(ceiling))
    by_anchor = positives.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("target", "positive_score"))).alias("p"))  # n_positives at most
    # anchors with fewer positives get targets that nothing reaches
    padded = by_anchor.select("id", *[F.concat(x, F.array_repeat(F.lit(y), F.lit(n_positives) - F.size("p"))).alias(n) for n, x, y in (("need", least, HIGHEST), ("most", most, LOWEST))])
    negatives = best(lists.search(padded, False, n_negatives), n_negatives)
    out = negatives.join(positives, ["id", "target"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
