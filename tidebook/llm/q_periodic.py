"""Query on runs of repeated words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, text_of
from .periodic import find_runs


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where one text in ten, by its id's crc32 h, repeats: from word g % n on, g = h // 10, its words have a
    period that the id chooses. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parted = docs.select("*", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.nullif(F.size("words"), F.lit(0))
    placed = parted.select("*", (F.col("g") % n).cast("int").alias("a"), n.alias("n"))
    known = placed.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    changed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("words", F.col("a") + (i - F.col("a")) % F.col("p") + 1)))
    return known.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def longest(x: Column, y: Column) -> Column:
    """The run of greater exponent; of equal ones the one that comes first."""
    a, b = x["length"] * y["period"], y["length"] * x["period"]
    return F.when(x["start"].isNull() | (b > a), y).otherwise(x)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    found = find_runs(planted(docs))
    none = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")])
    top = F.aggregate("runs", none, longest)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digests = F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), *digests)
    return out.select("doc_id", "n_runs", "top.*", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
