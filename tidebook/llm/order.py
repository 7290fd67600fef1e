"""Token ids in training order: fixed-stride shards under a keyed permutation of all sequences."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_index, forget, kept, texts
from .shingles import mix
from .tokens import encoder

ROUNDS = 6


def slots(index: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each index under a permutation of 0 .. total - 1 that key picks; with back, the index of each slot.

    A balanced Feistel network permutes the least power of four that holds total. Where it leaves the range it is
    applied again (cycle-walking): at most four times on average, and always to an end, as it is a permutation.
    """
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def network(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in reversed(keys) if back else keys:
            if back:
                a, b = b ^ (mix(a ^ k) & mask), a
            else:
                a, b = b, a ^ (mix(b ^ k) & mask)
        return a << half | b

    x = network(index.astype(np.uint64))
    out = np.flatnonzero(x >= np.uint64(total))
    while len(out):
        x[out] = network(x[out])
        out = out[x[out] >= np.uint64(total)]
    return x.astype(np.int64)


def cut_sequences(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """part, pos, doc_id, piece, n_tokens, ids (16-bit little-endian) for each sequence of length ids.

    A document's ids and end_id are cut from the front; the last piece may be shorter. part is the task and pos counts
    its sequences. A null text is empty and gives one piece, end_id alone.
    """

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            row, piece, size, ids = [], [], [], []
            for i, text in enumerate(texts(batch)):
                found = encode(text)
                found.append(end_id)
                held = np.array(found, "<u2")
                for k, a in enumerate(range(0, len(held), length)):
                    row.append(i)
                    piece.append(k)
                    size.append(min(length, len(held) - a))
                    ids.append(held[a : a + length].tobytes())
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n)), batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())],
                names=["part", "pos", "doc_id", "piece", "n_tokens", "ids"],
            )
            done += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sequences, "part int, pos long, doc_id long, piece int, n_tokens int, ids binary")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: int, length: int = 512, end_id: int = 2, pad_id: int = 0xFFFF, shard_rows: int = 16_384, waves: int = 4) -> DataFrame:
    """Writes all sequences of docs (doc_id, text) into folder in training order; gives slot, shard, offset, doc_id, piece, n_tokens.

    Sequence i of n (numbered by task and place) goes to slot slots(i, n, key). Shard s is the file s.ids, which holds
    slots s * shard_rows onwards, each as length 16-bit little-endian ids, the rest of a short one as pad_id: so slot k
    lies at byte (k % shard_rows) * 2 * length of shard k // shard_rows, and a reader can resume anywhere. layout.json
    says so. Shards are written in waves of neighbouring slots, each with a shuffle of its own, so that at most a part
    of 1 / waves of the ids is in shuffle files at a time. A shard is written under another name and moved when whole;
    a task that runs again writes the same bytes. Without documents there is no shard. Null texts are empty and have the end
    id alone; repeated rows are sequences of their own; a very long text is many sequences. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    cut = kept(cut_sequences(docs, tokenizer, length, end_id), "sequences")
    total = cut.count()
    stride = 2 * length
    slot_of = F.pandas_udf(lambda i: pd.Series(slots(i.to_numpy(), total, key)), "long")
    numbered = dense_index(cut).withColumn("slot", slot_of("index")).withColumn("shard", F.expr(f"slot div {shard_rows}").cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        at, out, name = -1, None, ""
        tag = f"{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{top}/{name}.{tag}", f"{top}/{name}")

        for batch in batches:
            for slot, shard, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("slot", "shard", "ids")), strict=True):
                if shard != at:
                    close()
                    at, name = shard, f"{shard:08d}.ids"
                    out = fs.open_output_stream(f"{top}/{name}.{tag}")
                out.write(ids + np.full((stride - len(ids)) // 2, pad_id, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("slot", "shard", "doc_id", "piece", "n_tokens")], names=["slot", "shard", "doc_id", "piece", "n_tokens"])
        close()

    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/layout.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "bytes_an_id": 2, "shard_rows": shard_rows, "pad_id": pad_id, "end_id": end_id, "key": key}).encode())
    shards = -(-total // shard_rows)
    each = max(1, -(-shards // waves))
    done = []
    for low in range(0, max(shards, 1), each):
        n = max(1, min(each, shards - low))
        part = numbered.filter(F.col("shard").between(low, low + n - 1)).select("slot", "shard", "doc_id", "piece", "n_tokens", "ids")
        dealt = part.repartitionById(n, (F.col("shard") - low).cast("int")).sortWithinPartitions("slot")
        done.append(kept(dealt.mapInArrow(write, "slot long, shard int, doc_id long, piece int, n_tokens int"), "shards-written"))
    forget(cut)
    return reduce(DataFrame.unionByName, done).withColumn("offset", F.col("slot") % shard_rows * stride)


def read_shards(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, n_tokens, ids_crc32 and ids of the slots from first to before last, each shard read from where they begin."""
    fs, top = filesystem(folder)
    with fs.open_input_stream(f"{top}/layout.json") as f:
        layout = json.loads(f.read())
    last = layout["sequences"] if last is None else min(last, layout["sequences"])
    rows, stride, pad = layout["shard_rows"], 2 * layout["length"], layout["pad_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                a, b = max(first, shard * rows), min(last, (shard + 1) * rows)
                with fs.open_input_file(f"{top}/{shard:08d}.ids") as f:
                    f.seek((a - shard * rows) * stride)
                    for k in range(a, b, 1_024):
                        n = min(1_024, b - k)
                        held = np.frombuffer(f.read(n * stride), "<u2").reshape(n, -1)
                        size = (held != pad).sum(axis=1)
                        ids = [held[i, : size[i]].tobytes() for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), pa.array(size.astype(np.int32)), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["slot", "n_tokens", "ids_crc32", "ids"])

    schema = "slot long, n_tokens int, ids_crc32 long, ids binary"
    if first >= last:
        return spark.createDataFrame([], schema)
    low, high = first // rows, (last - 1) // rows + 1
    return spark.range(low, high, 1, min(high - low, 10_000)).mapInArrow(read, schema)


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI (or local path) and the path in it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
