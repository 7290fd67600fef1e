"""Folders for intermediate tables, streams and their checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that the cluster names; it isn't created.

    Where none is named, as in tests, a local folder stands in, but only for a session whose tasks run in this process.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        top = _own[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: worked out once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with _part and _pos: rows in the given order are those of part 0 in the order of _pos, then those of part 1, and so on.

    Rows are dealt by range, so that no task sorts them all, and written: bounds of ranges come from samples, which are drawn
    anew each time that a plan runs, so what counts parts and what numbers rows have to read the same ones.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    d = d.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)})
    return written(d.drop("_id"), name)


def in_order(df: DataFrame, order: list[str | Column], column: str, first: int = 0) -> DataFrame:
    """df with the number of each row, from first on, in the given order. Only one count a part passes through the driver."""
    d = in_parts(df, order, column)
    starts = []
    for r in d.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        starts.append((r["_part"], first))
        first += r["n"]
    at = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return d.join(F.broadcast(at), "_part").withColumn(column, F.col("_start") + F.col("_pos")).drop("_part", "_pos", "_start")
