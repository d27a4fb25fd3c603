"""Aggregations (ops 65-77).

The group-bys are hash aggregates with map-side partial combine, so a hot key
costs one partial row per task before the shuffle. ``exact_quantiles`` is the
one order statistic: it pre-aggregates to distinct values, then range-partitions
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.functions.scalars import frame_floor


def total_crowd(long_df: DataFrame, ts: str = "ts", value: str = "count") -> DataFrame:
    """Sum across sensors per timestamp (NULLs skipped, all-NULL -> 0)."""
    return long_df.groupBy(ts).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def total_crowd_wide(wide: DataFrame, sensors: list[str], ts: str = "hour") -> DataFrame:
    """Wide form: row-wise sum of ``coalesce(sensor, 0)`` (no shuffle)."""
    total = None
    for s in sensors:
        term = F.coalesce(F.col(s), F.lit(0.0))
        total = term if total is None else total + term
    return wide.select(ts, total.alias("total"))


def mean_by_hour(totals: DataFrame, ts: str = "ts", value: str = "total") -> DataFrame:
    return totals.groupBy(F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean_total"))


def mean_by_weekday(totals: DataFrame, ts: str = "ts", value: str = "total") -> DataFrame:
    return totals.groupBy(F.weekday(ts).alias("weekday")).agg(F.avg(value).alias("mean_total"))


def segment_mean_in_frame(flat: DataFrame, frame: str = "frame_time", key: str = "id_str",
                          level: str = "traffic_level") -> DataFrame:
    """Mean level per segment per 3-minute frame (every frame, not one)."""
    return flat.groupBy(frame, key).agg(F.avg(level).alias("mean_level"))


def resample_minutes(df: DataFrame, key: str, ts: str, value: str, minutes: int = 3,
                     out_ts: str = "bin_start") -> DataFrame:
    """Mean per key per ``minutes`` bin; empty bins do not appear."""
    return (df.groupBy(key, frame_floor(ts, minutes).alias(out_ts))
            .agg(F.avg(value).alias(value))
            .where(F.col(value).isNotNull()))


def resample_hourly(df: DataFrame, ts: str, cols: list[str], fill_gaps: bool = True) -> DataFrame:
    """Hourly mean of ``cols``; hours without rows appear with NULLs when ``fill_gaps``.

    The hour grid is generated from the data's own min/max hour (a bounded
    sequence: its size grows with the time span, not with the row count).
    """
    hourly = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(*[F.avg(c).alias(c) for c in cols])
    if not fill_gaps:
        return hourly
    bounds = hourly.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return grid.join(hourly, "hour", "left")


def frame_list(df: DataFrame, frame: str) -> DataFrame:
    """Sorted distinct frames."""
    return df.select(frame).where(F.col(frame).isNotNull()).distinct().orderBy(frame)


def frame_range(df: DataFrame, ts: str) -> DataFrame:
    """The data range shown beside the frame list: first and last time."""
    return df.agg(F.min(ts).alias("range_start"), F.max(ts).alias("range_end"))


def distinct_times_range(df: DataFrame, ts: str) -> DataFrame:
    """Rows, distinct times, first and last time from one scan."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(ts).alias("n_times"),
                  F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def map_center_points(latest_positions: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Median lat / lon of the latest position per vessel (exact, via ``exact_quantiles``)."""
    spark = latest_positions.sparkSession
    pos = latest_positions.select(lat, lon).persist()     # one row per vessel, read by both passes
    try:
        mlat = exact_quantiles(pos, lat, [0.5])[0.5]
        mlon = exact_quantiles(pos, lon, [0.5])[0.5]
    finally:
        pos.unpersist()
    return spark.createDataFrame([(mlat, mlon)], "center_lat double, center_lon double")


# Fallback map centre (lat, lon) when no feature has coordinates.
FALLBACK_CENTER = (52.37, 4.90)


def map_center_lines(features: DataFrame, order_col: str = "feature_id",
                     coords_col: str = "coordinates") -> DataFrame:
    """First coordinate of the first feature that has coordinates, else the fallback."""
    pts = features.select(order_col,
                          F.regexp_extract(coords_col, r"\[\s*\[\s*([-0-9.eE]+)", 1).try_cast("double").alias("lon0"),
                          F.regexp_extract(coords_col, r"\[\s*\[\s*[-0-9.eE]+\s*,\s*([-0-9.eE]+)", 1)
                          .try_cast("double").alias("lat0"))
    pts = pts.where(F.col("lon0").isNotNull() & F.col("lat0").isNotNull())
    m = pts.agg(F.min_by(F.struct("lat0", "lon0"), F.col(order_col)).alias("m"))
    return m.select(F.coalesce(F.col("m.lat0"), F.lit(FALLBACK_CENTER[0])).alias("center_lat"),
                    F.coalesce(F.col("m.lon0"), F.lit(FALLBACK_CENTER[1])).alias("center_lon"))


def metrics_by_location(scored: DataFrame, key: str, actual: str, pred: str) -> DataFrame:
    """MAE and RMSE per location, sorted by RMSE."""
    e = F.col(actual) - F.col(pred)
    return (scored.groupBy(key)
            .agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.count("*").alias("n"))
            .orderBy("rmse", key))


def r2_by_sensor(scored: DataFrame, key: str, actual: str, pred: str) -> DataFrame:
    """R² (0 when the actuals are constant) and MAE per sensor, in one aggregation.

    ``ss_tot = n * var_pop(actual)``: Spark's variance aggregate merges
    central moments (numerically stable, unlike ``sum(y²) - n·mean²``) and
    combines partially before the shuffle, so a hot sensor costs one partial
    row per task and no means table has to be joined back.
    """
    e = F.col(actual) - F.col(pred)
    agg = scored.groupBy(key).agg(F.sum(e * e).alias("ss_res"),
                                  (F.var_pop(actual) * F.count(actual)).alias("ss_tot"),
                                  F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))
    r2 = F.when(F.col("ss_tot") != 0, F.lit(1.0) - F.col("ss_res") / F.col("ss_tot")).otherwise(F.lit(0.0))
    return agg.select(key, r2.alias("r2"), "mae", "n")


def metrics_summary(per_sensor: DataFrame) -> DataFrame:
    return per_sensor.agg(F.avg("mae").alias("mean_mae"), F.avg("r2").alias("mean_r2"))


def mse(scored: DataFrame, actual: str, pred: str) -> DataFrame:
    e = F.col(actual) - F.col(pred)
    return scored.agg(F.avg(e * e).alias("mse"))


#: A range of at most this many distinct values is ranked at once.
RANKED_VALUES = 200_000


def exact_quantiles(df: DataFrame, col: str, probs: list[float], ranked: int = RANKED_VALUES) -> dict:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``), distributed.

    1. rows are reduced to (distinct value, count), so a value repeated by a third of the rows is one row;
    2. a range of values is cut at bounds that are fixed numbers (approximate quantiles, taken once); counting
       its parts tells which part holds a wanted rank. Only such parts are looked into again, until they hold
       at most ``ranked`` distinct values, which a window numbers.

    Returns ``{p: value}``; the driver receives the counts of some 250 parts a round and the values at the
    wanted ranks. Nothing depends on which task a row is in.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    vals = x.groupBy("x").agg(F.count("*").alias("c")).persist()
    try:
        n, distinct, low, high = vals.agg(F.sum("c"), F.count("*"), F.min("x"), F.max("x")).first()
        if not n:
            return {p: None for p in probs}
        wanted = sorted({r for p in probs for r in (int((n - 1) * p // 1), -int(-(n - 1) * p // 1))})
        at: dict = {}
        todo = [(low, high, 0, distinct, wanted)]  # values from low to high, both included, behind so many rows
        while todo:
            low, high, before, distinct, ranks = todo.pop()
            part = vals.where((F.col("x") >= low) & (F.col("x") <= high))
            if distinct <= ranked:
                w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # at most ``ranked`` rows
                cum = part.withColumn("hi", F.sum("c").over(w) + F.lit(before)).withColumn("lo", F.col("hi") - F.col("c"))
                hit = F.filter(F.array(*[F.lit(k) for k in ranks]), lambda k: (k >= F.col("lo")) & (k < F.col("hi")))
                at.update({r.k: r.x for r in cum.select("x", F.explode(hit).alias("k")).collect()})
                continue
            bounds = sorted(set(part.approxQuantile("x", [i / 250 for i in range(1, 250)], 0.001)) - {low})
            number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("x") >= b))
            for r in sorted(part.groupBy(number.alias("i")).agg(F.sum("c").alias("c"), F.count("*").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()):
                mine = [k for k in ranks if before <= k < before + r.c]
                if mine:
                    todo.append((r.lo, r.hi, before, r.d, mine))
                before += r.c
    finally:
        vals.unpersist()
    out = {}
    for p in probs:
        h = (n - 1) * p
        lo, hi = int(h // 1), -int(-h // 1)
        out[p] = at[lo] + (h - lo) * (at[hi] - at[lo])
    return out
