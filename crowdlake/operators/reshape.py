"""Wide <-> long reshaping (ops 20-25). Unpivot is a per-row generator: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Calendar columns that travel with the crowd counts.
CALENDAR_COLUMNS = ["hour", "minute", "day", "month", "weekday", "is_weekend"]


def melt_counts(wide: DataFrame, ids: list[str], sensors: list[str],
                var: str = "sensor_id", value: str = "count") -> DataFrame:
    """Wide -> long; NULL counts are kept, as ``pandas.melt`` keeps NaN."""
    return wide.unpivot(ids, sensors, var, value)


def melt_with_features(wide: DataFrame, ts: str, sensors: list[str], features: list[str],
                       var: str = "location", value: str = "count") -> DataFrame:
    """Melt the sensors and carry the per-timestamp features along as id columns.

    Equal to the reference's melt + self-join on the timestamp when
    timestamps are unique, without the join.
    """
    return wide.unpivot([ts] + list(features), sensors, var, value)


def location_index(df: DataFrame, location: str, out: str = "location_id",
                   order: list[str] | None = None) -> DataFrame:
    """Stable integer per location.

    With ``order`` (the wide table's sensor columns, schema metadata) the id is
    the column position, as the reference enumerates its columns; it is a
    native ``array_position`` lookup, no join. Without it, locations are
    numbered in sorted order of the distinct values (a table of one row per
    sensor, joined back), inside blocks of neighbouring values whose sizes are summed up.
    """
    if order is not None:
        pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(location).cast("string"))
        return df.withColumn(out, F.when(pos > 0, (pos - 1).cast("int")))
    number = dict(df.dtypes)[location] in ("tinyint", "smallint", "int", "bigint")
    block = F.floor(F.col(location) / F.lit(1024)) if number else F.substring(location, 1, 2)
    locs = df.select(location).distinct().withColumn("_block", block)
    locs = locs.withColumn("_in", F.row_number().over(Window.partitionBy("_block").orderBy(location)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = locs.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    idx = locs.join(blocks, locs["_block"].eqNullSafe(blocks["_block"])).select(location, (F.col("_before") + F.col("_in") - 1).cast("int").alias(out))
    return df.join(idx, location, "left")


def latest_row_to_kv(wide: DataFrame, ts: str, sensors: list[str]) -> DataFrame:
    """The newest wide row as (sensor, value) pairs (the long table is the dictionary)."""
    newest = wide.select(F.max(ts)).scalar()
    row = wide.where(F.col(ts) == newest)
    return row.unpivot([ts], sensors, "sensor", "value")


def pivot_predictions(scored: DataFrame, ts: str, sensor: str, actual: str, pred: str,
                      sensors: list[str]) -> DataFrame:
    """Per timestamp, ``<sensor>_actual`` and ``<sensor>_xgb_pred`` columns.

    The pivot values are passed explicitly so Spark skips the distinct-values job.
    """
    p = (scored.groupBy(ts).pivot(sensor, sensors)
         .agg(F.first(actual).alias("actual"), F.first(pred).alias("xgb_pred")))
    return p


def sensor_direction_split(df: DataFrame, name_col: str) -> DataFrame:
    """``<id>_<bearing>`` -> ``sensor_id`` text and integer ``sensor_direction``."""
    parts = F.split(F.col(name_col), "_")
    return df.withColumns({
        "sensor_id": F.get(parts, 0),
        "sensor_direction": F.get(parts, 1).try_cast("int"),
    })
