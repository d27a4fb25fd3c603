"""Filters, predicates and data-quality profiles (ops 45-56)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.functions.scalars import ntz_lit


def filter_sensors(df: DataFrame, col: str, sensors: list) -> DataFrame:
    """Rows of the chosen sensors (``isin`` is pushed to the parquet scan)."""
    return df.where(F.col(col).isin(list(sensors)))


def filter_time_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive range on a wall clock."""
    return df.where(F.col(col).between(ntz_lit(start), ntz_lit(end)))


def filter_date_slice(df: DataFrame, col: str, start_date: str, end_date: str) -> DataFrame:
    """Whole days ``start_date .. end_date`` (the last day is included whole)."""
    start = dt.datetime.fromisoformat(start_date)
    end = dt.datetime.fromisoformat(end_date) + dt.timedelta(days=1)
    return df.where((F.col(col) >= ntz_lit(start)) & (F.col(col) < ntz_lit(end)))


def recent_window(df: DataFrame, col: str, minutes: float, partition_col: str | None = None) -> DataFrame:
    """Rows within ``minutes`` of the newest time in ``df``, both ends inclusive.

    The newest time is a scalar subquery (one partial max per task), not a
    driver round trip; it is also pushed into the scan as a runtime filter.
    With ``partition_col`` (a date partition column of a table partitioned by
    day) both passes are restricted to the partitions that can hold the
    window: the newest date comes from the partition column, the newest time
    is searched only in that day, and the rows only in the days the window
    spans — partition pruning instead of a scan of all history.
    """
    if partition_col is None:
        newest = df.select(F.max(col)).scalar()
        lo = F.timestamp_add("SECOND", F.lit(-int(minutes * 60)), newest)
        return df.where((F.col(col) >= lo) & (F.col(col) <= newest))
    last_day = df.select(F.max(partition_col)).scalar()
    newest = df.where(F.col(partition_col) == last_day).select(F.max(col)).scalar()
    lo = F.timestamp_add("SECOND", F.lit(-int(minutes * 60)), newest)
    first_day = F.date_sub(last_day, int(-(-minutes // 1440)))
    return df.where((F.col(partition_col) >= first_day) & (F.col(col) >= lo) & (F.col(col) <= newest))


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def incomplete_rows(df: DataFrame, required: list[str], report_cols: list[str]) -> DataFrame:
    """Rows skipped by a map layer because a required field is NULL; distinct and sorted."""
    cond = None
    for c in required:
        cond = F.col(c).isNull() if cond is None else (cond | F.col(c).isNull())
    return df.where(cond).select(*report_cols).distinct().orderBy(*report_cols)


def incomplete_rows_by_layer(df: DataFrame, layers: dict, report_cols: list[str]) -> DataFrame:
    """Rows skipped by any map layer (each layer has its own required fields), de-duplicated, sorted."""
    required = sorted({c for cols in layers.values() for c in cols})  # one pass: any layer's field that is missing
    return incomplete_rows(df, required, report_cols)


def drop_null_flow(df: DataFrame, col: str = "flow") -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))


def split_past_now_future(df: DataFrame, col: str, now, steps: int = 20, minutes: int = 3) -> DataFrame:
    """Label rows ``historic`` (< now), ``current`` (= now), ``actual_future`` in (now, now+k*min]."""
    now_c = ntz_lit(now)
    horizon = F.timestamp_add("MINUTE", F.lit(steps * minutes), now_c)
    label = (F.when(F.col(col) < now_c, F.lit("historic"))
             .when(F.col(col) == now_c, F.lit("current"))
             .when((F.col(col) > now_c) & (F.col(col) <= horizon), F.lit("actual_future")))
    return df.withColumn("type", label).where(F.col("type").isNotNull())


def positive_only(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL (or NaN) count per column, one row per column (single pass)."""
    exprs = []
    for f in df.schema.fields:
        isnull = F.col(f.name).isNull()
        if f.dataType.typeName() in ("double", "float"):
            isnull = isnull | F.isnan(F.col(f.name))
        exprs.append(F.count_if(isnull).alias(f.name))
    wide = df.agg(*exprs)
    stack = ", ".join(f"'{f.name}', `{f.name}`" for f in df.schema.fields)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, nulls)")


def describe_profile(df: DataFrame, cols: list[str], exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """count / mean / std / min / quartiles / max per numeric column, long form.

    Moments come from one aggregation pass over all columns. Quartiles are
    exact by default (pandas' linear interpolation) through
    ``aggregates.exact_quantiles`` — distinct values with counts, narrowed to
    the ranges that hold the ranks, so no task holds a whole column or a hot value's rows;
    ``exact=False`` uses the ``percentile_approx`` sketch instead.
    """
    from crowdlake.operators.aggregates import exact_quantiles

    exprs = []
    for c in cols:
        x = F.col(c).cast("double")
        exprs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                  F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                  F.max(x).alias(f"{c}__max")]
        if not exact:
            exprs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q"))
    wide = df.agg(*exprs)

    def quartiles(c):
        if not exact:
            return [F.col(f"{c}__q")[i] for i in range(3)]
        q = exact_quantiles(df, c, [0.25, 0.5, 0.75])
        return [F.lit(q[p]).cast("double") for p in (0.25, 0.5, 0.75)]

    rows = []
    for c in cols:
        q25, q50, q75 = quartiles(c)
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"{c}__count").alias("count"),
            F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
            F.col(f"{c}__min").alias("min"), q25.alias("p25"), q50.alias("p50"), q75.alias("p75"),
            F.col(f"{c}__max").alias("max")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and repeated rows: a partial-combining group-by, then a one-row total."""
    g = df.groupBy(*df.columns).count()
    return g.agg(F.sum("count").cast("bigint").alias("total_rows"),
                 F.count("*").cast("bigint").alias("distinct_rows")).withColumn(
        "duplicates", F.col("total_rows") - F.col("distinct_rows"))
