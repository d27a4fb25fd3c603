"""A table with one row per key, kept current by the changes of micro-batches.

Keys are dealt into ``buckets`` by hash. A batch reads and rewrites only the buckets that its changes touch, into a folder of its
own; then one small version file, which names the folder of every bucket, is written and renamed into place. Readers follow the newest
version file, so they see a whole version also while a batch is being written, and a batch that is run again
finds its version done. Bounded driver work: bucket numbers and names, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """``key`` is unique in the table; ``order`` (columns) says which of two rows of a key is newer."""

    def __init__(self, root: str, key: str, order: list[str], buckets: int = 32, keep_versions: int = 3):
        self.root, self.key, self.order, self.buckets, self.keep = root.rstrip("/"), key, list(order), buckets, keep_versions

    # -- reading -------------------------------------------------------------------------------------------

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The rows of the newest version; no rows before the first one."""
        done = self.versions(spark)
        folders = self._manifest(spark, done[-1]) if done else {}
        return self._load(spark, folders, schema)

    def versions(self, spark: SparkSession) -> list[int]:
        """Batch ids of the committed versions, in order."""
        fs, p = self._path(spark, f"{self.root}/versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def _load(self, spark: SparkSession, folders: dict, schema) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in sorted(folders.values())])

    # -- writing -------------------------------------------------------------------------------------------

    def merge(self, changes: DataFrame, batch_id: int, deleted=None) -> None:
        """Apply a batch: rows replace older rows of their key, rows for which ``deleted`` (a Column) holds remove it."""
        spark = changes.sparkSession
        done = self.versions(spark)
        if batch_id in done:
            return
        done = [v for v in done if v < batch_id]
        folders = self._manifest(spark, done[-1]) if done else {}
        columns = changes.columns
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = changes.withColumns({"_gone": gone, "_bucket": bucket, "_new": F.lit(1)}).persist()
        try:
            touched = [r[0] for r in batch.select("_bucket").distinct().collect()]
            if touched:
                old = self._load(spark, {b: folders[str(b)] for b in touched if str(b) in folders}, changes.schema)
                rows = batch.unionByName(old.withColumns({"_gone": F.lit(False), "_bucket": bucket, "_new": F.lit(0)}))
                newest = Window.partitionBy("_bucket", self.key).orderBy(*[F.col(c).desc_nulls_last() for c in self.order], F.desc("_new"))
                kept = rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1 AND NOT _gone").select(*columns, "_bucket")
                at = f"data/{batch_id}-{uuid.uuid4().hex[:8]}"
                kept.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
                left = self._names(spark, f"{self.root}/{at}")
                folders = {b: f for b, f in folders.items() if int(b) not in touched}
                folders |= {n.split("=")[1]: f"{at}/{n}" for n in left if n.startswith("_bucket=")}
            self._commit(spark, batch_id, folders)
        finally:
            batch.unpersist()
        self._prune(spark)

    def upserter(self, deleted=None):
        """``foreachBatch`` function that merges every batch; ``deleted``: function of no argument that gives the Column."""
        def write(batch: DataFrame, batch_id: int) -> None:
            gone = deleted() if deleted else None
            self.merge(batch, batch_id, gone)
        return write

    # -- version files -------------------------------------------------------------------------------------

    def _path(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, p = self._path(spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest(self, spark: SparkSession, version: int) -> dict:
        fs, p = self._path(spark, f"{self.root}/versions/{version}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, spark: SparkSession, version: int, folders: dict) -> None:
        fs, p = self._path(spark, f"{self.root}/versions/.{version}-{uuid.uuid4().hex[:8]}")
        out = fs.create(p)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        if not fs.rename(p, self._path(spark, f"{self.root}/versions/{version}")[1]):
            raise OSError(f"version {version} of {self.root} could not be committed")

    def _prune(self, spark: SparkSession) -> None:
        """Drop the version files beyond ``keep`` and the batch folders that no kept version names."""
        done = self.versions(spark)
        for v in done[: -self.keep]:
            fs, p = self._path(spark, f"{self.root}/versions/{v}")
            fs.delete(p, False)
        named = {f.split("/")[1] for v in done[-self.keep:] for f in self._manifest(spark, v).values()}
        for n in self._names(spark, f"{self.root}/data"):
            if n not in named and int(n.split("-")[0]) < done[-1]:
                fs, p = self._path(spark, f"{self.root}/data/{n}")
                fs.delete(p, True)
