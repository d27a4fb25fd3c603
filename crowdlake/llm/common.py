"""Helpers the corpus operators share: scratch tables, row keys, files and components."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdlake.session import scratch_path

#: Texts are worked on in slices of about this many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20


def materialize(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts the lineage, survives lost executors.

    ``compact``: a table of a few numbers per row is written by two tasks per core, however many shuffle
    partitions they take together, instead of one small file per partition.
    """
    path = scratch_path(df.sparkSession, name)
    if compact:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES):
    """Zero-copy slices of a batch holding about ``max_bytes`` of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    off = _offsets(col)
    lo = 0
    while lo < n:
        hi = lo + 1
        while hi < n and off[hi + 1] - off[lo] <= max_bytes:
            hi += 1
        yield batch.slice(lo, hi - lo)
        lo = hi


def slices_returned(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES):
    """``text_slices`` that hands free memory back to the machine after each batch: Python workers outlive a stage, and what one
    stage's arrays took would else stay beside the next stage's."""
    yield from text_slices(batch, column, max_bytes)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _offsets(col: pa.Array):
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    dtype = np.int64 if wide else np.int32
    return np.frombuffer(col.buffers()[1], dtype=dtype)[col.offset: col.offset + len(col) + 1]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def map_array(uri: str, dtype):
    """A sorted array file, memory-mapped where the store is mounted, else read whole."""
    import numpy as np

    store, path = open_fs(uri)
    if not store.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_bytes(uri: str, *parts) -> None:
    """Write one file. Its folder is made if the store has folders."""
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(p)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)``: one row ``(node, component)`` per
    end of an edge, ``component`` the smallest reachable node.

    Minimum labels spread along edges and then jump to their label's label, so a round halves
    long chains. Each round aggregates to one row per node before it joins; a hub's edges meet its
    single label row in a plain equi-join, which AQE splits. Every round is a written table.
    Rows with a null end are no edges; an empty table gives no rows.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                       f"{name}-edges", compact=True)
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")),
                        f"{name}-0", compact=True)
    step = 0
    while True:
        step += 1
        near = (both.join(state.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        hop = state.join(near, "node").select("node", F.col("label").alias("was"),
                                              F.least("label", "near").alias("label"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialize(hop.join(jump, "label", "left")
                          .select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")),
                          f"{name}-{step}", compact=True)
        changed = new.where(F.col("label") != F.col("was")).limit(1).count()
        state = new.select("node", "label")
        if not changed:
            return state.select("node", F.col("label").alias("component"))


def running_start(df: DataFrame, order: str, amount: str) -> DataFrame:
    """Add ``start``: the sum of ``amount`` over rows before, by ``order``. For tables with one row per file or task."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))
