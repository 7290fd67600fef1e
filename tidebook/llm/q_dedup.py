"""Query on near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .dedup import near_duplicates


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
