"""What the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import scratch

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes, in memory, and rows up to which a side keyed by an id is broadcast; beyond either the join shuffles.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    free = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(free, "false")
    spark.conf.set(free, "true")  # what was shuffled for this write is of no use after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(free, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a kept() frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df, a narrow frame, for broadcast if it was counted and is small enough; else a join shuffles it.

    Its size is its number of rows times the width of a row in a hash table of the join, strings at their mean length.
    """
    width = 48 + sum(_width(f.dataType) for f in df.schema.fields)
    most = min(BROADCAST_ROWS, limit // width)
    if df.limit(most + 1).count() > most:
        return df
    long = [F.octet_length(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    inside = [F.aggregate(f.name, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0))) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]
    if long or inside:
        total = sum((F.coalesce(F.sum(x), F.lit(0)) for x in [*long, *inside]), F.count(F.lit(1)) * width)
        if df.agg(total.alias("n")).first()["n"] > limit:
            return df
    return F.broadcast(df)


def _width(kind: T.DataType) -> int:
    """Bytes of a value in a row of Spark, without what a string or an array of strings holds."""
    return 16 + sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8


#: Parts into which rows of one key are dealt, so that no task gets all the rows of a hot one.
SALTS = 64


def _salted(df: DataFrame, *spread: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))


def with_least(df: DataFrame, by: str, value: str, name: str, spread: str) -> DataFrame:
    """df with name: the least value of each group by. The rows of a group are dealt into SALTS parts by the column spread.

    Each part's least is found first, then that of the parts, which goes back to them: so a group of any size is at most
    SALTS rows in one task.
    """
    rows = _salted(df, spread)
    parts = rows.groupBy(by, "_salt").agg(F.min(value).alias("_part"))
    whole = parts.groupBy(by).agg(F.min("_part").alias(name))
    return rows.join(parts.select(by, "_salt").join(whole, by), [by, "_salt"]).drop("_salt")


def joined(df: DataFrame, side: DataFrame, key: str, *spread: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """df joined with side, which has one row for a key; df may have many for one.

    A side of a checked size is broadcast. A larger one goes to the parts, dealt by the columns spread, that the rows of a
    key have, so that a hot key's rows are spread over SALTS tasks.
    """
    marked = small(side, limit)
    if marked is not side:
        return df.join(marked, key, how)
    rows = _salted(df, *spread)
    return rows.join(rows.select(key, "_salt").distinct().join(side, key), [key, "_salt"], how).drop("_salt")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text_of(column)).alias("a"), F.xxhash64(F.lit(17), text_of(column)).alias("b"))


def with_columns(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    """schema with added fields at its end; fields of the same names are replaced."""
    names = {f.name for f in added}
    return T.StructType([f for f in schema.fields if f.name not in names] + added)


def append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def take_rows(docs: DataFrame, chosen: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of docs as often as chosen says.

    chosen has a row for each combination of doc_id, text_key of docs and the columns by that is to stay: doc_id, key,
    by, rows (how many rows of docs have that combination) and copies (how many shall come out). Combinations with one
    row, nearly all, go straight through the join; of the others the least row is kept and multiplied.
    """
    by = by or []
    d = docs.withColumn("_key", text_key())
    c = chosen.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.col("rows").alias("_rows"), F.col("copies").alias("_copies"), *[F.col(x).alias(f"_by_{x}") for x in by])
    same = d["doc_id"].eqNullSafe(c["_id"]) & (d["_key"]["a"] == c["_k"]["a"]) & (d["_key"]["b"] == c["_k"]["b"])
    for x in by:
        same = same & d[x].eqNullSafe(c[f"_by_{x}"])
    j = d.join(c, same)
    single = j.filter("_rows = 1").select(*docs.columns, "_copies")
    several = j.filter("_rows > 1").groupBy("_id", "_k", *[f"_by_{x}" for x in by]).agg(F.min(F.struct(*docs.columns)).alias("_row"), F.any_value("_copies").alias("_copies")).select("_row.*", "_copies")
    out = single.unionByName(several).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*docs.columns)


def dense_index(df: DataFrame, name: str = "index") -> DataFrame:
    """Numbers the rows of a kept() frame 0, 1, ... without a single-task window.

    The frame must have been written with the columns part and pos: the task that wrote a row and the row's place in
    it. Only one count for each task passes through the driver.
    """
    sizes = df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total - r["low"]))
        total += r["n"]
    at = df.sparkSession.createDataFrame(starts, "part int, start long")
    return df.join(F.broadcast(at), "part").withColumn(name, F.col("start") + F.col("pos")).drop("start")
