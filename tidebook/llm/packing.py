"""Best-fit packing of tokenized documents under several capacities (vector best-fit)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, texts
from .tokens import encoder

#: Pieces that one task packs; blocks are dealt by hash, so that each has the same mix of lengths.
BLOCK = 16_000


def cut(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int | None = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document's ids.

    A document that is longer than length is cut into pieces of length, of which the first takes the remainder. A null
    text is empty; an empty text still has its end id (without end_id it has no piece). Rows with equal ids are separate
    documents. Other columns are not read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, number, start, size, crc = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                ids = encode(text)
                if end_id is not None:
                    ids.append(end_id)
                held, a = np.array(ids, "<u4"), 0
                for k in range(-(-len(ids) // length)):
                    b = a + length if k or len(ids) % length == 0 else len(ids) % length
                    row.append(i)
                    number.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(held[a:b].tobytes()))
                    a = b
            whole = [pa.array(x, pa.int64()) for x in (start, size, crc)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *whole], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The bin of each piece. A piece needs its length, one document and length squared of a bin's capacity.

    Pieces go by falling length, equal ones in the given order. Of the bins in which all three needs fit, "norm" takes
    the one whose weighted residual is least afterwards, "dot" the one whose residual, as shares of the capacity, has
    the largest weighted product with the need; of equal bins the oldest.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    need_of = lambda n: np.array([n, 1.0, float(n) * n]) / cap
    bins, free, number, used, opened = np.zeros(len(lengths), np.int64), np.zeros((64, 3)), np.zeros(64, np.int64), 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min(initial=0)
    shortest = need_of(least) - 1e-12
    for i in order:
        need = need_of(lengths[i])
        left = free[:used]
        fits = np.flatnonzero((left >= need - 1e-12).all(axis=1))
        if len(fits):
            r = left[fits]
            k = fits[np.argmin(((r - need) ** 2) @ w) if rule == "norm" else np.argmax((r * need) @ w)]
        else:
            if used == len(free):
                free, number = np.concatenate([free, np.zeros_like(free)]), np.concatenate([number, np.zeros_like(number)])
            free[used], number[used] = 1.0, opened
            k, used, opened = used, used + 1, opened + 1
        free[k] -= need
        bins[i] = number[k]
        if (free[k] < shortest).any():  # no piece of the block fits any more; the order by age stays
            free[k : used - 1], number[k : used - 1] = free[k + 1 : used], number[k + 1 : used]
            used -= 1
    return bins


def pack(pieces: DataFrame, length: int = 1024, max_docs: int = 1024, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """Gives each piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset.

    Each sequence keeps three capacities: length tokens, max_docs pieces and max_cost attention (the sum of squared
    lengths; none: length squared). Pieces that fill a sequence have one alone. The others are dealt by hash into blocks
    of about block pieces, each packed by best_fit() in one task; sequences that stayed at most half full in every
    capacity, one or two of a block, are opened again and packed together, until they make up a single block or a round
    leaves as many as it got. Equal pieces go by their row, so repeated documents are packed like any others; other
    columns than the five are not kept. An empty input gives an empty result.
    """
    max_cost = float(length) ** 2 if max_cost is None else float(max_cost)
    capacity = (length, max_docs, max_cost)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, block long, bin long, offset long, loose boolean"

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending")])
        f = pd.DataFrame({"n": t["length"].to_numpy()})
        f["bin"] = best_fit(f["n"].to_numpy(), capacity, weights, rule)
        by = f.groupby("bin")["n"]
        f["offset"] = by.cumsum() - f["n"]
        half = (by.transform("sum") * 2 <= length) & (by.transform("size") * 2 <= max_docs)
        loose = half & ((f["n"] ** 2).groupby(f["bin"]).transform("sum") * 2 <= max_cost)
        for name, values in (("bin", f["bin"]), ("offset", f["offset"]), ("loose", loose)):
            t = t.append_column(name, pa.array(values.to_numpy()))
        return t

    held = kept(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = held.filter(F.col("length") >= length).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, level, before = [whole], held.filter(F.col("length") < length), 0, -1
    while True:
        n = rest.count()
        blocks = max(1, -(-n // block))
        dealt = rest.select(*columns, "row", F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(blocks)).alias("block"))
        out = kept(dealt.groupBy("block").applyInArrow(packed, schema), "packed")
        last, before = blocks == 1 or n == before, n
        done.append((out if last else out.filter("not loose")).select(*columns, (F.lit(level << 56) + F.col("block") * (1 << 28) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        rest, level = out.filter("loose"), level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
