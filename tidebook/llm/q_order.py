"""Query on token ids in training order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import scratch, table
from .order import read_shards, write_shards

KEY = 20_240_229


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence's place in the shards, with the checksum of the ids that are stored there, read back."""
    folder = scratch(spark, "training-order")
    placed = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), KEY)
    stored = read_shards(spark, folder).select("slot", "ids_crc32")
    return placed.join(stored.hint("merge"), "slot").select("slot", "shard", "offset", "doc_id", "piece", "n_tokens", "ids_crc32")


QUERIES = {"op1_training_order": op1_training_order}
ORACLE_SQL: dict[str, str] = {}
