"""Map-ready tables: the data half of the map layers (ops 95-103)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.functions.scalars import fixed_text
from crowdlake.functions.bands import band_traffic

# Required fields of the circle/heat layers and of the arrow layer.
CIRCLE_REQUIRED = ["lat", "lon", "name", "sensor"]
ARROW_REQUIRED = ["lat", "lon", "name", "sensor", "direction"]
ROAD_LINE_WIDTH = 3.0


def heat_points(loc_with_value: DataFrame, value: str) -> DataFrame:
    """``[lat, lon, weight]`` for complete locations with a positive value."""
    ok = None
    for c in CIRCLE_REQUIRED:
        ok = F.col(c).isNotNull() if ok is None else (ok & F.col(c).isNotNull())
    pts = loc_with_value.where(ok & (F.col(value) > 0))
    return pts.select("sensor", F.array(F.col("lat").cast("double"), F.col("lon").cast("double"),
                                         F.col(value).cast("double")).alias("point"))


def traffic_features(roads_with_level: DataFrame, level: str = "mean_level",
                     id_col: str = "rid_str") -> DataFrame:
    """Road rows as feature properties: rounded level, constant width, RGBA colour."""
    b = band_traffic(level)
    rounded = fixed_text(F.col(level), 2).cast("double")
    return roads_with_level.select(
        "*",
        rounded.alias("traffic_level_2d"),
        F.lit(ROAD_LINE_WIDTH).alias("width"),
        b["band"].alias("band"),
        b["rgba"].alias("rgba"),
        F.to_json(F.struct(F.col(id_col).alias("id"), rounded.alias("traffic_level"),
                           b["rgba"].alias("rgba"), F.lit(ROAD_LINE_WIDTH).alias("width"))).alias("feature_json"),
    )
