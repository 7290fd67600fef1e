"""Query on the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .perplexity import judge


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "lang", F.round("bits", 6).alias("bits"), F.round(F.pow(F.lit(2.0), "bits"), 4).alias("perplexity"), F.round("fence", 6).alias("fence"), F.col("trusted_like").alias("kept"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
