"""Query on media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import kept, table
from .media import read_media, write_media


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = kept(write_media(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "media")
    return read_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks")


QUERIES = {"op6_media_columns": op6_media_columns}
ORACLE_SQL: dict[str, str] = {}
