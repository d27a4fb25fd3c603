"""Writers (ops 13-16). Every writer is a distributed ``DataFrameWriter`` call:
one file set per task, no driver-side buffering or appending."""

from __future__ import annotations

import logging
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  max_records_per_file: int = 500_000, mode: str = "overwrite") -> str:
    """Snappy parquet; ``maxRecordsPerFile`` plays the reference's write batch size."""
    w = (df.write.mode(mode).option("compression", "snappy")
         .option("maxRecordsPerFile", max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv_gz(df: DataFrame, path: str, mode: str = "overwrite",
                 max_records_per_file: int = 500_000) -> str:
    """Gzipped CSV with a header in every part file."""
    (df.write.mode(mode).option("header", True).option("compression", "gzip")
     .option("maxRecordsPerFile", max_records_per_file).csv(path))
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",",
              encoding: str | None = None) -> str:
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    if encoding:
        w = w.option("encoding", encoding)
    w.csv(path)
    return path


def write_both(df: DataFrame, parquet_path: str, csv_gz_path: str, mode: str = "both",
               partition_by: list[str] | None = None, csv_columns: list[str] | None = None) -> dict:
    """Write ``parquet``, ``csv`` or ``both`` and publish them together; returns the written paths by format.

    Each format goes to a folder beside its target first. Only when every wanted one is whole are they swapped into place, so a
    reader sees the old table or the new one and a failed job leaves what was there. With ``both`` a parquet
    failure is tolerated: it is logged, its half-written folder goes, and the CSV is written and
    published alone. The CSV is made from the staged parquet, so the input is evaluated once and nothing is cached.
    """
    if mode not in ("parquet", "csv", "both"):
        raise ValueError(f"mode must be parquet, csv or both, not {mode!r}")
    spark, tag, staged = df.sparkSession, uuid.uuid4().hex[:8], {}
    source = df
    targets = {"parquet": parquet_path, "csv": csv_gz_path}
    try:
        if mode in ("parquet", "both"):
            try:
                write_parquet(df, f"{parquet_path}.staged-{tag}", partition_by)
                staged["parquet"] = f"{parquet_path}.staged-{tag}"
                source = spark.read.schema(df.schema).parquet(staged["parquet"])
            except Exception as exc:  # noqa: BLE001 - tolerated by design in "both"
                if mode == "parquet":
                    raise
                log.warning("no parquet this time: %s", exc)
        if mode in ("csv", "both"):
            write_csv_gz(source.select(*csv_columns) if csv_columns else source, f"{csv_gz_path}.staged-{tag}")
            staged["csv"] = f"{csv_gz_path}.staged-{tag}"
        for kind, folder in staged.items():
            _swap(spark, folder, targets[kind], tag)
    finally:
        for path in targets.values():
            _folder(spark, f"{path}.staged-{tag}", delete=True)
    return {k: targets[k] for k in staged}


def _folder(spark: SparkSession, path: str, delete: bool = False):
    """The file system and path object of a folder, which is deleted if asked for."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if delete:
        fs.delete(p, True)
    return fs, p


def _swap(spark: SparkSession, staged: str, target: str, tag: str) -> None:
    """Put a staged folder in the place of a table, whose old folder goes last."""
    fs, new = _folder(spark, staged)
    _, place = _folder(spark, target)
    _, old = _folder(spark, f"{target}.old-{tag}")
    replaced = fs.exists(place)
    if replaced and not _renamed(fs, place, old):
        raise OSError(f"{target} could not be replaced")
    if not _renamed(fs, new, place):
        if replaced:
            fs.rename(old, place)
        raise OSError(f"{target} could not be put in place")
    if replaced:
        fs.delete(old, True)


def _renamed(fs, a, b) -> bool:
    """Whether a rename worked: some stores answer, others raise."""
    try:
        return bool(fs.rename(a, b))
    except Py4JJavaError:
        return False
