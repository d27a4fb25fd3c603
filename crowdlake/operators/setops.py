"""Set operations (ops 91-94)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.functions.scalars import ntz_lit
from crowdlake.operators.filters import split_past_now_future


def concat_typed_series(parts: dict[str, DataFrame], ts: str = "timestamp", value: str = "value",
                        keys: list[str] | None = None) -> DataFrame:
    """Stack (key, time, value) series with a ``type`` label (historic, current, forecast, actual)."""
    out = None
    for label, df in parts.items():
        piece = df.select(*(keys or []), F.col(ts).alias(ts), F.col(value).cast("double").alias(value),
                          F.lit(label).alias("type"))
        out = piece if out is None else out.unionByName(piece)
    return out


def typed_series(df: DataFrame, now, ts: str = "timestamp", value: str = "value", keys: list[str] | None = None,
                 steps: int = 20, minutes: int = 3) -> DataFrame:
    """Historic, current and actual-future series of one table as ``concat_typed_series`` would stack them, labelled in one pass."""
    labelled = split_past_now_future(df.select(*(keys or []), F.col(ts).alias(ts), F.col(value).cast("double").alias(value)), ts, now, steps, minutes)
    return labelled.select(*(keys or []), ts, value, "type")


def history_and_current(df: DataFrame, ts: str, now) -> DataFrame:
    """History and current rows of one table: one filter where the two are not separate tables."""
    return df.where(F.col(ts) <= ntz_lit(now))


def concat_history_current(history: DataFrame, current: DataFrame) -> DataFrame:
    return history.unionByName(current)


def concat_columns(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Align two tables on time (outer: equal to inner when both share the index)."""
    return a.join(b, on, "full")


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Option list: sorted distinct values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
