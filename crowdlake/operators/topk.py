"""Sorts, limits and top-k (ops 85-90). A global ``orderBy(...).limit(k)`` is
planned as TakeOrderedAndProject: each task keeps its own top k, only k rows
per task reach the final merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.operators.windows import tail_n_per_key


def topk_segments(resampled: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """Top ``k`` ids by the mean of their bin means (ties by id)."""
    return (resampled.groupBy(key).agg(F.avg(value).alias("mean_level"))
            .orderBy(F.col("mean_level").desc(), F.col(key)).limit(k))


def topk_series(resampled: DataFrame, top: DataFrame, key: str, ts: str, n: int = 20) -> DataFrame:
    """The last ``n`` points of each top id (left-semi join on the k ids, then tail)."""
    sel = resampled.join(top.select(key), key, "left_semi")
    return tail_n_per_key(sel, key, [ts], n)


def worst_k(per_key: DataFrame, metric: str, key: str, k: int = 5) -> DataFrame:
    """``k`` rows with the largest ``metric``, descending."""
    return per_key.orderBy(F.col(metric).desc(), F.col(key)).limit(k)


def best_worst(per_key: DataFrame, key: str, metric: str) -> DataFrame:
    """Best and worst key by ``metric`` in one aggregate (ties by key)."""
    best = F.max_by(F.col(key), F.struct(F.col(metric), -F.col(key).cast("double")))
    worst = F.min_by(F.col(key), F.struct(F.col(metric), F.col(key)))
    return per_key.agg(best.alias(f"best_{key}"), F.max(metric).alias(f"best_{metric}"),
                       worst.alias(f"worst_{key}"), F.min(metric).alias(f"worst_{metric}"))


def top_importances(importances: DataFrame, k: int = 8) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def sort_series(df: DataFrame, cols: list[str], within_partitions: bool = False) -> DataFrame:
    """Order by (id, time): a range-partitioned global sort, or per partition only."""
    return df.sortWithinPartitions(*cols) if within_partitions else df.orderBy(*cols)
