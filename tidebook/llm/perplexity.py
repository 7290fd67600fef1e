"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's units are characters: an ORDER-gram is a string of ORDER of them. Counts, models and answers are tables keyed
by gram, so they grow with the corpus and are spread over the cluster; each gram that documents have is looked up once
for every shard of the documents that has it, not once for every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, kept, scratch, small, texts, with_columns
from .order import filesystem
from .shingles import mix

ORDER = 4
#: What stands ORDER - 1 times before a text; the same character inside a text counts as U+FFFD.
START = "\0"
#: An unseen character is as likely as any other code point.
UNITS = 0x110000
#: Characters of a shard, and of the texts that are worked on at once.
SHARD, CHUNK = 16 << 20, 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def text_chunks(held: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in held:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def windows(held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, each after ORDER - 1 times START; a 64-bit hash of the gram that begins at each place;
    the places where each text's grams begin, and end)."""
    gap = START * (ORDER - 1)
    points = np.frombuffer(gap.join(["", *(t.replace(START, "�") for t in held)]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in held], np.int64)
    ends = np.cumsum(sizes + ORDER - 1) - (ORDER - 1)
    return points, hashes(points), ends - sizes, ends


def hashes(points: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(points) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        h = h * _BASE + points[k : k + len(h)]
    return mix(h)


def distinct_grams(held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ORDER-grams of some texts, told apart by 64-bit hashes: (hashes, code points, how often each occurs)."""
    points, h, starts, ends = windows(held)
    inside = np.zeros(len(h) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    found, first, n = np.unique(h[at], return_index=True, return_counts=True)
    return found, points[at[first][:, None] + np.arange(ORDER)], n


def gram_strings(points: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(points).view(f"<U{ORDER}").ravel().tolist(), pa.string())


def gram_counts(trusted: DataFrame, column: str = "text") -> DataFrame:
    """(gram, n) over every whole text. Tasks add up their own texts in chunks first; the rest is a groupBy by gram."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, column):
            _, points, n = distinct_grams(held)
            yield pa.RecordBatch.from_arrays([gram_strings(points), pa.array(n, pa.int64())], names=["gram", "n"])

    return trusted.select(column).mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[str]]:
    """The texts of batches, about CHUNK characters at a time."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for t in texts(batch, column):
            held.append(t)
            size += len(t)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


@dataclass
class Level:
    """Of one order: own (gram, own), the discounted share of each seen gram after its context; and back (context, back),
    the weight that the next lower order has after each seen context."""

    own: DataFrame
    back: DataFrame


def _level(counts: DataFrame, k: int) -> Level:
    """counts: gram, n (of the highest order counts, of lower ones numbers of distinct characters before)."""
    of = counts.agg(*[F.count_if(F.col("n") == x).cast("double").alias(f"n{x}") for x in (1, 2, 3, 4)]).first()
    y = of["n1"] / (of["n1"] + 2 * of["n2"]) if of["n1"] and of["n2"] else 0.5
    ratio = lambda a, b: of[a] / of[b] if of[b] else 0.0
    d = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * ratio("n2", "n1")), (2, 2 - 3 * y * ratio("n3", "n2")), (3, 3 - 4 * y * ratio("n4", "n3")))]
    discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    rows = counts.select("gram", "n", F.left("gram", F.lit(k - 1)).alias("context"), discount.alias("off"))
    by = kept(rows.groupBy("context").agg(F.sum("n").cast("double").alias("total"), F.sum("off").alias("given")), f"contexts-{k}")
    own = rows.join(by, "context").select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"))
    return Level(kept(own, f"level-{k}"), by.select("context", (F.col("given") / F.col("total")).alias("back")))


def train(trusted: DataFrame, column: str = "text") -> list[Level]:
    """The model of all whole trusted texts, one Level for each order from 1 to ORDER."""
    counts = {ORDER: kept(gram_counts(trusted, column), "grams")}
    for k in range(ORDER - 1, 0, -1):  # how many distinct characters come before each shorter gram
        counts[k] = kept(counts[k + 1].groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"continuations-{k}")
    return [_level(counts[k], k) for k in range(1, ORDER + 1)]


def gram_bits(asked: DataFrame, model: list[Level]) -> DataFrame:
    """(gram, bits) for each distinct gram of asked: -log2 of the interpolated probability of its last character.

    Each order is a join of the asked grams with the model's counts, of their contexts with the model's contexts, and of
    their endings with the answers of the order below: p = own + back * p of the ending; an unseen context hands all to
    the order below, and below the lowest one all code points are alike.
    """
    answers = None
    for k, level in enumerate(model, 1):
        grams = asked.select(F.right("gram", F.lit(k)).alias("gram")).distinct() if k < ORDER else asked.select("gram")
        rows = grams.select("gram", F.left("gram", F.lit(k - 1)).alias("context"), F.right("gram", F.lit(k - 1)).alias("rest"))
        rows = rows.join(level.own, "gram", "left").join(level.back, "context", "left")
        below = F.lit(1.0 / UNITS)
        if answers is not None:
            rows, below = rows.join(answers.select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest"), F.col("q")
        answers = kept(rows.select("gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * below).alias("p")), f"answers-{k}")
    return answers.select("gram", (-F.log2("p")).alias("bits"))


def in_shards(docs: DataFrame) -> DataFrame:
    """docs with shard, written: each task's rows in runs of about SHARD characters."""
    schema = with_columns(docs.schema, [T.StructField("_shard", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = np.cumsum([len(t) for t in texts(batch)])
            yield append(batch, _shard=pa.array(part + (seen + ends) // SHARD, pa.int64()))
            seen += int(ends[-1]) if len(ends) else 0

    return kept(docs.mapInArrow(numbered, schema), "shards")


def perplexity(docs: DataFrame, model: list[Level]) -> DataFrame:
    """docs with bits: the mean -log2 p of a text's characters.

    bits of a text without characters is null, as of null. Of each shard of the documents the distinct grams are joined
    with their answers, which are written by shard to the shared folder; a task reads those of the shard that it is at.
    So no text is shuffled, and a task holds a few texts and the grams of a shard. A column of this name is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("bits", "_shard")])
    held = in_shards(docs)

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows follow each other, but may be in several tasks; each of these gives its part's grams."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts_, size, shard = [], 0, None

        def count() -> None:
            if texts_:
                parts.append(distinct_grams(texts_)[:2])
                texts_.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            count()
            if parts:
                _, first = np.unique(np.concatenate([h for h, _ in parts]), return_index=True)
                points = np.concatenate([p for _, p in parts])[first]
                parts.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), shard), pa.int64()), gram_strings(points)], names=["shard", "gram"])

        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if s != shard:
                    yield from flush()
                    shard = s
                texts_.append(t)
                size += len(t)
                if size >= CHUNK:
                    count()
                    size = 0
        yield from flush()

    pairs = kept(held.select("_shard", "text").mapInArrow(grams_of, "shard long, gram string"), "shard-grams")
    bits = gram_bits(kept(pairs.select("gram").distinct(), "asked"), model)
    folder = scratch(docs.sparkSession, "answers")
    answers = pairs.join(bits, "gram").select("shard", "gram", "bits")
    answers.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    schema = with_columns(docs.schema, [T.StructField("bits", T.DoubleType())])

    def answers_of(shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a shard's grams, sorted, and their bits; none for a shard without characters."""
        files, path = filesystem(f"{folder}/shard={shard}")
        if files.get_file_info(path).type == FileType.NotFound:
            return np.zeros(0, np.uint64), np.zeros(0)
        t = pq.read_table(path, filesystem=files, columns=["gram", "bits"], partitioning=None)
        h = hashes(np.frombuffer("".join(t["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4"))[::ORDER]
        order = np.argsort(h)
        return h[order], t["bits"].to_numpy()[order]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = None, (np.zeros(0, np.uint64), np.zeros(0))
        for batch in batches:
            at = batch.schema.get_field_index("_shard")
            of = batch.column(at).to_numpy()
            bits: list[float | None] = []
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
                if of[start] != shard:
                    shard, table = int(of[start]), answers_of(int(of[start]))
                for part in text_chunks(texts(batch.slice(start, end - start))):
                    bits += mean_bits(part, *table)
            bare = pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at], names=[n for n in batch.schema.names if n != "_shard"])
            yield append(bare, bits=pa.array(bits, pa.float64()))

    return held.mapInArrow(scored, schema)


def mean_bits(held: list[str], h: np.ndarray, cost: np.ndarray) -> list[float | None]:
    """The mean bits of each text, given sorted hashes of all their grams and what these cost."""
    _, own, starts, ends = windows(held)
    if not len(h):
        return [None] * len(held)
    at = np.minimum(np.searchsorted(h, own), len(h) - 1)
    inside = np.zeros(len(own) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    if (h[at] != own)[np.cumsum(inside[:-1]) > 0].any():
        raise RuntimeError("a shard's answers lack one of its grams")
    total = np.concatenate([[0.0], np.cumsum(cost[at])])
    return [float(total[b] - total[a]) / float(b - a) if b > a else None for a, b in zip(starts, ends, strict=True)]


def band_of(chars: Column) -> Column:
    """Texts of like length share a band: under 64 characters, under 256, under 1024, and the rest."""
    return F.when(chars < 64, 0).when(chars < 256, 1).when(chars < 1024, 2).otherwise(3)


def fences(scored: DataFrame, quantile: float = 0.99, least: int = 30, fewest: int = 10) -> DataFrame:
    """(lang, band, fence): the quantile of bits of trusted texts (lang, band, bits) of each language and band of length.

    Where all_bands is 1 a row is of a whole language, where all_langs is 1 of all languages. A language's band has a
    fence if at least least texts were seen, a language or a band if fewest were, and all together if one was.
    """
    by = scored.filter("bits is not null").cube("lang", "band").agg(F.grouping("lang").alias("all_langs"), F.grouping("band").alias("all_bands"), F.percentile_approx("bits", quantile, 10_000).alias("fence"), F.count(F.lit(1)).alias("n"))
    wide = F.col("all_langs") + F.col("all_bands")
    enough = F.col("n") >= F.when(wide == 0, least).when(wide == 1, fewest).otherwise(1)
    return by.filter(enough & ((F.col("all_langs") == 1) | F.col("lang").isNotNull())).select("lang", "band", "all_langs", "all_bands", "fence")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, fold: int = 5, least: int = 30) -> DataFrame:
    """docs with bits, fence and trusted_like.

    docs: doc_id, text, lang. labels: doc_id, quality; documents labelled 1 (by their largest label) are trusted. Their
    texts train the model, but for one in fold by a hash of doc_id: those set the fences, the quantile of their bits by
    language and band of length, so that a fence is one of texts that the model has not seen. A text passes if its bits
    are at most the fence of its language and band, or else of its band, of its language, or of all texts. Texts without
    characters pass. Without any trusted text that is kept from training every fence is infinite and all pass. Columns
    of the result's names are replaced; repeated rows are judged alike; a very long text is judged whole, in windows; an
    empty table stays empty. Fences are approximate quantiles (percentile_approx), exact up to 10,000 texts of a group;
    beyond that they may depend a little on how rows are dealt to tasks.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1 and doc_id is not null").select("doc_id", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(fold)) == 0).alias("_held"))
    good = kept(good, "trusted-ids")
    own = docs.select("doc_id", "text", "lang")
    model = train(own.join(small(good.filter("not _held").select("doc_id")), "doc_id", "left_semi"))
    seen = perplexity(own.join(small(good.filter("_held").select("doc_id")), "doc_id", "left_semi"), model)
    by = kept(fences(seen.select("lang", band_of(F.length("text")).alias("band"), "bits"), quantile, least), "fences")
    scored = perplexity(docs.select(*[c for c in docs.columns if c not in ("fence", "trusted_like", "_lang", "_band")]), model)
    out = scored.withColumn("_band", band_of(F.length("text")))
    some = small(by.filter("all_langs = 0 and all_bands = 0").select(F.col("lang").alias("_lang"), F.col("band").alias("_b"), F.col("fence").alias("_f1")))
    out = out.join(some, (F.col("lang") == F.col("_lang")) & (F.col("_band") == F.col("_b")), "left").drop("_lang", "_b")
    whole = small(by.filter("all_langs = 0 and all_bands = 1").select(F.col("lang").alias("_lang"), F.col("fence").alias("_f2")))
    out = out.join(whole, F.col("lang") == F.col("_lang"), "left").drop("_lang")
    rest = {r["band"]: r["fence"] for r in by.filter("all_langs = 1").select(F.when(F.col("all_bands") == 1, -1).otherwise(F.col("band")).alias("band"), "fence").collect()}  # five rows at most
    of_band = [F.when(F.col("_band") == b, F.lit(v)) for b, v in sorted(rest.items()) if b >= 0]
    out = out.withColumn("fence", F.coalesce("_f1", *of_band, "_f2", F.lit(rest.get(-1, float("inf"))))).drop("_f1", "_f2", "_band")
    return out.withColumn("trusted_like", F.col("bits").isNull() | (F.col("bits") <= F.col("fence")))
