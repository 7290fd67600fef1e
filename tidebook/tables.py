"""Tables in a folder that batches change by key: what was there before stays readable until a batch is whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.refdata import insert_new, upsert

#: Folders of a bucket that lie beside each other before they are written together.
MOST_FOLDERS = 8


class Conflict(Exception):
    """Another batch was written meanwhile; nothing of this one shows. Run it again."""


class Table:
    """Rows with a key, as Parquet files dealt into buckets by a hash of the columns by (those of the key, by default).

    A batch writes new folders for the buckets that it touches and then one manifest that names the folders of all
    buckets. Readers take the newest manifest; so a batch shows whole or not at all, and a batch that is killed leaves
    the old version. Of two batches at a time one fails with Conflict, as a manifest is never replaced. Only bucket
    numbers and folder names pass through the driver. The number of buckets is fixed when the first batch is written.

    Batches may be named (batch = (name, number)): one whose number its name has reached is passed over, so that a
    stream's batch that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], by: list[str] | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.by = spark, path.rstrip("/"), key, by or key
        jvm = spark._jvm
        self._jvm, self._conf = jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at("").getFileSystem(self._conf)
        found = self.manifest()
        self.buckets = found["buckets"] if found else buckets

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if version is None and not known or version is not None and version not in known:
            return None
        stream = self._fs.open(self._at(f"manifests/{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of the newest version, or of an older one; of some buckets only, if they are given. None: there is none."""
        m = self.manifest(version)
        return self._rows(m, buckets) if m else None

    def _rows(self, m: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{f}" for b, names in m["folders"].items() if buckets is None or int(b) in buckets for f in names]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """rows in a new folder; the folder of each bucket that has some."""
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith("_bucket=")}

    def _commit(self, old: dict | None, folders: dict[str, list[str]], schema: T.StructType, batch: tuple[str, int] | None) -> int:
        version = old["version"] + 1 if old else 1
        batches = (old["batches"] if old else {}) | ({batch[0]: batch[1]} if batch else {})
        text = json.dumps({"version": version, "buckets": self.buckets, "schema": schema.jsonValue(), "batches": batches, "folders": folders})
        draft, final = self._at(f"manifests/_{uuid.uuid4().hex}"), self._at(f"manifests/{version:08d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, never_over)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} was written by another batch") from None
            raise
        return version

    def _changed(self, rows: DataFrame, batch: tuple[str, int] | None, change) -> bool:
        """Stages rows and commits change(manifest, staged rows, their buckets) -> folders; False: the batch was there already."""
        m = self.manifest()
        if m and batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return False
        schema = T.StructType.fromJson(m["schema"]) if m else rows.schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        staged = self._write(rows)  # rows are worked out once: their buckets are those that are read and written
        try:
            base = m or {"version": 0, "folders": {}, "batches": {}, "schema": schema.jsonValue()}
            new = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in staged.values()]) if staged else self.spark.createDataFrame([], schema)
            self._commit(m, change(base, new, sorted(map(int, staged))), schema, batch)
        finally:
            for f in {s.rpartition("/")[0] for s in staged.values()}:
                self._fs.delete(self._at(f), True)
        return True

    def upsert(self, rows: DataFrame, newest: Column | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Rows replace those of their key, and add the others; of several rows of a key that of largest newest stays."""

        def change(m: dict, new: DataFrame, touched: list[int]) -> dict:
            own = self._write(upsert(self._rows(m, touched), new, self.key, newest))
            return m["folders"] | {b: [f] for b, f in own.items()}

        return self._changed(rows, batch, change)

    def insert_first(self, rows: DataFrame, first: Column, batch: tuple[str, int] | None = None) -> bool:
        """Rows of new keys are added, of several of a key that of least first; stored rows never change.

        Only keys of the buckets that rows touch are read, and what is added lies beside what is there; a bucket of
        MOST_FOLDERS folders is written together.
        """

        def change(m: dict, new: DataFrame, touched: list[int]) -> dict:
            stored = self._rows(m, touched).select(*self.key)
            own = self._write(insert_new(stored, new, self.key, first))
            folders = m["folders"] | {b: [*m["folders"].get(b, []), f] for b, f in own.items()}
            full = [b for b in own if len(folders[b]) > MOST_FOLDERS]
            if full:
                whole = self._write(self._rows({"schema": m["schema"], "folders": {b: folders[b] for b in full}}, None))
                folders |= {b: [f] for b, f in whole.items()}
            return folders

        return self._changed(rows, batch, change)

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Rows take the place of all stored rows with their values of by: a group that rows have is replaced whole."""

        def change(m: dict, new: DataFrame, touched: list[int]) -> dict:
            left = self._rows(m, touched).join(new.select(*self.by).distinct(), self.by, "left_anti").select(*new.columns)
            return m["folders"] | {b: [f] for b, f in self._write(left.unionByName(new)).items()}

        return self._changed(rows, batch, change)

    def overwrite(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Rows take the place of everything, with their own schema."""
        m = self.manifest()
        if m and batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return False
        self._commit(m, {b: [f] for b, f in self._write(rows).items()}, rows.schema, batch)
        return True

    def vacuum(self, keep: int = 2, also: Sequence[int] = ()) -> None:
        """Deletes all but the newest versions and those of also, and the folders that none of these names. No batch may run meanwhile."""
        known = self.versions()
        stay = {*known[-keep:], *also}
        for v in known:
            if v not in stay:
                self._fs.delete(self._at(f"manifests/{v:08d}.json"), False)
        used = {f.rpartition("/")[0] for v in stay & {*known} for names in self.manifest(v)["folders"].values() for f in names}
        for s in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            if f"data/{s.getPath().getName()}" not in used:
                self._fs.delete(s.getPath(), True)
