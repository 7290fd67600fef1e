"""Query on encoding and decoding by an automaton."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import decode, encode
from .common import table, text_of


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text")), path)
    back = decode(coded.select("doc_id", "ids"), path)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return back.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_bpe_automaton": op12_bpe_automaton}
ORACLE_SQL: dict[str, str] = {}
