"""Near-duplicate documents by ProbMinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, kept, small, text_key, texts, with_least
from .components import components
from .shingles import chunks, mix, shingles

#: Components of a signature, and how many of them make a band. Of pairs at 0.8 all but 1 in 1,600 share a band, of
#: those at 0.85 all but 1 in 600,000; of those at 0.5 one in 7 does.
COMPONENTS, ROWS = 320, 8
BANDS = COMPONENTS // ROWS
#: Bits kept of each component, and how far an estimate from them may lie below the threshold for the pair to be
#: compared exactly: about four standard errors (0.0285 at 0.8).
BITS, MARGIN = 2, 0.11


def prob_minhash(sets: list[np.ndarray], weights: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """A row of m element hashes for each weighted set; a share of equal places estimates the probability Jaccard.

    Each element's points arrive as a Poisson process of the rate of its weight; each point falls on one of the m
    components, which keeps the element of its earliest point. All sets go step by step together: step j makes the
    j-th arrivals of the elements whose last one came before their set's latest kept point; later ones can't matter.
    Arrival j of an element depends on its hash and j only. An empty set's row is zero.
    """
    sizes = np.array([len(s) for s in sets])
    d = np.concatenate([*sets, np.zeros(0, np.uint64)])
    w = np.concatenate([*weights, np.zeros(0)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    first, kept_by = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    x, step = np.zeros(len(d)), 0
    while len(d):
        step += 1
        r = mix(d + np.uint64((step * 0x9E3779B97F4A7C15) % (1 << 64)))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / w
        at = owner * m + ((mix(r) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, at, x)
        won = x == first[at]
        kept_by[at[won]] = d[won]
        go = x < first.reshape(-1, m).max(axis=1)[owner]
        d, w, owner, x = d[go], w[go], owner[go], x[go]
    return kept_by.reshape(-1, m)


def packed_bits(sig: np.ndarray) -> np.ndarray:
    """BITS bits of a hash of each component, as 64-bit numbers."""
    r = mix(sig + np.uint64(0x5851F42D4C957F2D))
    bits = np.concatenate([(r >> np.uint64(20 + k)).astype(np.uint8) & 1 for k in range(BITS)], axis=1)
    return np.packbits(bits, axis=1).view(np.int64)


def sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, text_key, key (of the text's sequence of words), bands, bits, n (distinct shingles) and set (of them, as
    sorted 32-bit hashes) of every row.

    Every shingle weighs 1, however often it stands in the text, so that bands and bits estimate the similarity that
    compared() verifies.
    """
    lead = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = batch.columns[1:], texts(batch)
            done = 0
            for part in chunks(held):
                lists, ka, kb = shingles(part, words)
                found = [np.unique(s) for s in lists]
                sig = prob_minhash(found, [np.ones(len(s)) for s in found])
                band = mix((mix(sig.reshape(len(part), -1, ROWS) + lead)).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                bits = packed_bits(sig)
                has = [len(s) > 0 for s in found]
                sets = [np.unique((s >> np.uint64(32)).astype("<u4")) for s in found]
                lists_of = lambda a: pa.array([a[i].tolist() if has[i] else [] for i in range(len(a))], pa.list_(pa.int64()))  # noqa: B023, E731
                key = pa.StructArray.from_arrays([pa.array(ka.view(np.int64)), pa.array(kb.view(np.int64))], ["a", "b"])
                columns = [*(c.slice(done, len(part)) for c in own), key, lists_of(band), lists_of(bits), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "key", "bands", "bits", "n", "set"])
                done += len(part)

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    return rows.mapInArrow(sketched, "doc_id long, text_key struct<a:long,b:long>, key struct<a:long,b:long>, bands array<long>, bits array<long>, n int, set binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (one, two) of keys with jac, the Jaccard similarity of their sets of shingles."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jac = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                jac.append(both / max(1, len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(jac, pa.float64())], names=["one", "two", "jac"])

    x = sets.select(F.col("key").alias("one"), F.col("set").alias("x"))
    y = sets.select(F.col("key").alias("two"), F.col("set").alias("y"))
    j = pairs.join(x, "one").join(y, "two").select("one", "two", "x", "y")
    return j.mapInArrow(checked, "one struct<a:long,b:long>, two struct<a:long,b:long>, jac double")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, text_key, class_id, class_key and n_links for every row of docs (doc_id, text).

    Texts whose sets of word shingles have a Jaccard similarity of at least least are linked, if they share a band;
    class_id is the least doc_id of the texts that links connect. n_links counts a text's links that were verified.
    Equal texts (the same words, A-Z as a-z, whatever the space between) are one text throughout, so copies cost no
    links. class_key tells classes apart even where doc_ids are null.

    First, all texts of a band's bucket are compared with its leader, the text that meets most others over all bands:
    so a large group is settled in as many comparisons as it has texts. What is then still in different components is
    compared pair by pair, once for all the buckets that a pair shares; but not where the similarities to the leader
    differ by more than 1 - least (the Jaccard distance is a metric, so such a pair can't be linked), nor where the
    bits of the signatures put the pair four standard errors below least. Null and wordless texts are copies of each
    other; a text of under words words has one shingle. A very long text is one set of 32-bit hashes, of which some fall
    together: one in two texts of 77,000 shingles loses one. Other columns of docs are left out. An empty table stays empty.
    """
    all_rows = kept(sketch(docs, words), "sketch")
    distinct = kept(all_rows.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")), "texts")
    each = distinct.select("key", F.explode("bands").alias("band"))
    hit = each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = kept(joined(each, hit, "band", "key"), "buckets")
    rows = kept(met.select("key", "band").join(met.groupBy("key").agg(F.sum("n").alias("meets")), "key"), "bucket-rows")
    lead = rows.groupBy("band").agg(F.max(F.struct("meets", "key")).alias("top")).select("band", F.col("top.key").alias("leader"))
    pairs = kept(joined(rows, lead, "band", "key").filter("key != leader").select(F.col("key").alias("one"), F.col("leader").alias("two")).distinct(), "pairs")
    sets = kept(joined(all_rows.select("key", "set", "doc_id"), rows.select("key").distinct(), "key", "doc_id").groupBy("key").agg(F.any_value("set").alias("set")), "sets")
    judged = kept(compared(pairs, sets), "compared")

    linked = lambda d: d.filter(F.col("jac") >= least - 1e-9).select(F.col("one").alias("a"), F.col("two").alias("b"))
    links = linked(judged)
    labels = kept(components(links), "labels")
    sides = joined(rows, lead, "band", "key").join(judged.select(F.col("one").alias("key"), F.col("two").alias("leader"), "jac"), ["key", "leader"], "left")
    sides = sides.join(small(labels.withColumnRenamed("node", "key")), "key", "left").select("band", "key", F.coalesce("jac", F.lit(1.0)).alias("jac"), F.coalesce("component", "key").alias("c"))
    apart = sides.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("band")
    marks = distinct.select("key", "bits", F.transform("bands", lambda x: F.hash(x)).alias("marks"))
    left = kept(joined(sides, apart, "band", "key").join(marks, "key"), "apart")
    right = left.select("band", *[F.col(c).alias(f"{c}_") for c in ("key", "jac", "c", "bits", "marks")])
    equal = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_")[k])) for k in range(BITS * COMPONENTS // 64)), F.lit(0))
    most = int(BITS * COMPONENTS * (1 - least + MARGIN) / 2)
    near = (F.col("c") < F.col("c_")) & (F.abs(F.col("jac") - F.col("jac_")) <= 1 - least + 1e-9) & (equal <= most)
    first = F.array_position(F.zip_with("marks", "marks_", lambda x, y: x == y), F.lit(True))
    here = F.array_position("marks", F.hash("band"))
    more = kept(left.join(right, "band").filter(near & (first == here)).select(F.col("key").alias("one"), F.col("key_").alias("two")).distinct(), "pairs")
    if not more.isEmpty():
        links = kept(links.unionByName(linked(kept(compared(more, sets), "compared"))), "links-all")
        labels = kept(components(links), "labels")

    degree = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    classed = distinct.select("key", "least_id").join(labels.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left").select("key", "least_id", F.coalesce("component", "key").alias("c"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    by_text = kept(with_least(classed, "c", "least_id", "class_id", "key").select("key", "n_links", "class_id", F.col("c").alias("class_key")), "classes")
    return joined(all_rows.select("doc_id", "text_key", "key"), by_text, "key", "doc_id").drop("key")


def firsts(found: DataFrame) -> DataFrame:
    """One row of each class of near_duplicates(), as take_rows() wants it: a text of the document that the class is named by."""
    named = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    first = named.groupBy("class_key").agg(F.min(F.struct("text_key", "rows", "doc_id")).alias("f"))
    return first.select("f.doc_id", F.col("f.text_key").alias("key"), "f.rows", F.lit(1).alias("copies"))
