"""Documents on their way to training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import dedup, mixing, packing, perplexity, toxicity
from tidebook.llm.common import kept, table, take_rows
from tidebook.llm.q_toxicity import THRESHOLD, held_out


def aside(docs: DataFrame, used: list[str]) -> DataFrame:
    """docs with all columns but the used ones in a struct, so that an operator can't take them for its own."""
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in used]).alias("_kept"))


def back(found: DataFrame, docs: DataFrame, used: list[str]) -> DataFrame:
    return found.select(*[F.col(c) if c in used else F.col("_kept")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold stay; empty and null texts do."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out())
    scored = toxicity.score(aside(docs, ["text"]), model)
    return back(scored.filter(F.col("score") < THRESHOLD), docs, ["text"])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's fence stay."""
    used = ["doc_id", "text", "lang"]
    judged = perplexity.judge(aside(docs, used), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return back(judged.filter("trusted_like"), docs, used)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays."""
    return take_rows(docs, dedup.firsts(dedup.near_duplicates(docs.select("doc_id", "text"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or more."""
    found = mixing.mix(docs.select("doc_id", "text", "source"))
    chosen = found.groupBy("doc_id", "key", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    return take_rows(docs, chosen, ["source"])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.cut(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, signatures and a tokenizer are beyond SQL; tests hold each stage's decisions against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
