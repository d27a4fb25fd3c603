"""Joins: as-of nearest, sensor/location lookups, road matching, key detection.

Small-dimension joins carry no broadcast hint: Catalyst broadcasts a side
only when its estimated size is under ``spark.sql.autoBroadcastJoinThreshold``
and AQE re-plans from real shuffle sizes, so a dimension that grows with the
data falls back to a shuffle join instead of blowing up executor memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.functions.scalars import decimal_comma, id_text, split_lat_lon


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


# ---------------------------------------------------------------------------
# op 57: as-of nearest
# ---------------------------------------------------------------------------

def asof_nearest(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                 tolerance_minutes: float = 60, right_order: str | None = None,
                 suffix_ts: str = "matched_ts") -> DataFrame:
    """Attach to every left row the right row nearest in time within the tolerance.

    pandas ``merge_asof(direction='nearest')`` semantics: the tolerance is
    inclusive; on equal distance the earlier right time wins; among right
    rows sharing one time the last (by ``right_order``) wins when it lies at
    or before the left time and the first when after. Left rows are never
    lost or duplicated.

    Plan (linear, no candidate pairs, no copies of rows): both sides become one table of distinct times, whatever the number of
    rows at a time, cut into blocks of a second (or of the tolerance, if that is shorter). ``nearest_times`` finds
    each left time's neighbours inside its block and takes those of blocks without right times from a carry over the table of blocks.
    Only the matched time is joined to the right side, which is reduced to the first and the last
    row of each time.
    """
    tol_us = int(tolerance_minutes * 60 * 1_000_000)
    right_cols = [c for c in right.columns if c != right_on]
    payload = F.struct(F.col(right_on).alias(suffix_ts), *[F.col(c) for c in right_cols])
    order = F.struct(F.col(right_order or right_on).alias("o"))
    reduced = right.where(F.col(right_on).isNotNull()).groupBy(_micros(F.col(right_on)).alias("_rt")).agg(
        F.min_by(payload, order).alias("_first"), F.max_by(payload, order).alias("_last"))
    found = nearest_times(left.select(_micros(F.col(left_on)).alias("us")), right.select(_micros(F.col(right_on)).alias("us")), tol_us)
    best = found.join(reduced, found["match"] == reduced["_rt"]).select(
        "us", F.when(F.col("match") <= F.col("us"), F.col("_last")).otherwise(F.col("_first")).alias("_m"))
    best = best.select(F.col("us").alias("_lts"), *[F.col(f"_m.{c}").alias(c) for c in [suffix_ts] + right_cols])
    return left.join(best, _micros(left[left_on]) == best["_lts"], "left").drop("_lts")


def nearest_times(left: DataFrame, right: DataFrame, tolerance: int, block: int = 1_000_000) -> DataFrame:
    """The nearest right time (``match``) of every distinct left time within ``tolerance``; both sides hold a column ``us`` of whole numbers.

    Carry over ordered blocks, in three levels of bounded size: a window over the times of a block; one over the blocks of a span, which is as
    wide as the tolerance at least; and the neighbouring spans' last and first right time by an equi-join - nothing farther can match.
    Of two right times at the same distance the earlier one is taken.
    """
    width = max(1, min(block, tolerance))
    per_span = max(1, -(-tolerance // width))
    both = (left.where("us IS NOT NULL").select("us", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("r"))
            .unionByName(right.where("us IS NOT NULL").select("us", F.lit(False).alias("asks"), F.col("us").alias("r"))))
    times = both.groupBy("us").agg(F.max("asks").alias("asks"), F.max("r").alias("r")).withColumn("b", F.floor(F.col("us") / F.lit(width)))
    blocks = times.groupBy("b").agg(F.max("r").alias("last"), F.min("r").alias("first")).withColumn("s", F.floor(F.col("b") / F.lit(per_span)))
    spans = blocks.where("last IS NOT NULL").groupBy("s").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    in_span = Window.partitionBy("s").orderBy("b")
    carry = blocks.select("b", "s", F.max("last").over(in_span.rowsBetween(Window.unboundedPreceding, -1)).alias("p"),
                          F.min("first").over(in_span.rowsBetween(1, Window.unboundedFollowing)).alias("n"))
    sides = F.array(F.struct((F.col("s") + 1).alias("s"), F.col("last").alias("p"), F.lit(None).cast("long").alias("n")),
                    F.struct((F.col("s") - 1).alias("s"), F.lit(None).cast("long").alias("p"), F.col("first").alias("n")))
    beside = spans.select(F.explode(sides).alias("x")).groupBy(F.col("x.s").alias("s")).agg(F.max("x.p").alias("_p"), F.max("x.n").alias("_n"))
    carry = (carry.join(beside, "s", "left")
             .select("b", F.coalesce("p", "_p").alias("p"), F.coalesce("n", "_n").alias("n")))
    in_block = Window.partitionBy("b").orderBy("us")
    near = times.select("us", "asks", "b", F.max("r").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
                        F.min("r").over(in_block.rowsBetween(0, Window.unboundedFollowing)).alias("after"))
    near = near.where("asks").join(carry, "b").select("us", F.coalesce("before", "p").alias("before"), F.coalesce("after", "n").alias("after"))
    back, ahead = F.col("us") - F.col("before"), F.col("after") - F.col("us")
    match = (F.when((back <= tolerance) & (ahead.isNull() | (ahead > tolerance) | (back <= ahead)), F.col("before"))
             .when(ahead <= tolerance, F.col("after")))
    return near.select("us", match.alias("match")).where("match IS NOT NULL")


# ---------------------------------------------------------------------------
# ops 58-60: sensors and their locations
# ---------------------------------------------------------------------------

def parse_locations(loc: DataFrame, width_col: str = "width_txt", latlon_col: str = "latlon_txt") -> DataFrame:
    """Typed location table: decimal-comma width, ``"lat, lon"`` split."""
    lat, lon = split_lat_lon(latlon_col)
    return (loc.withColumn("width", decimal_comma(width_col))
            .withColumn("lat", lat).withColumn("lon", lon))


def join_sensor_location(sensors: DataFrame, loc: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Sensor/bearing table <- location on ``sensor_id = Objectummer`` (left join)."""
    return sensors.join(loc, sensors[left_key] == loc[right_key], "left")


def flow_for_readings(readings: DataFrame, loc: DataFrame, sensor_col: str = "sensor",
                      count_col: str = "count") -> DataFrame:
    """Crowd flow per reading: ``int(count)/width/3``.

    Unknown sensor -> 0 (reference default); known sensor with NULL width ->
    NULL (the reference's NaN, removed later by ``drop_null_flow``).
    """
    from crowdlake.functions.scalars import crowd_flow

    lk = loc.select(F.col(sensor_col).alias("_lsensor"), F.col("width"), F.lit(True).alias("_known"))
    j = readings.join(lk, readings[sensor_col] == lk["_lsensor"], "left")
    flow = F.when(F.col("_known").isNull(), F.lit(0.0)).otherwise(crowd_flow(count_col, "width"))
    return j.withColumn("flow", flow).drop("_lsensor", "_known")


def locations_with_reading(loc: DataFrame, latest: DataFrame, key: str, value_col: str,
                           how: str = "left", fill: float | None = 0.0) -> DataFrame:
    """Location rows <- their latest reading; missing -> ``fill`` (arrows, heat) or dropped (circles)."""
    j = loc.join(latest.select(key, value_col), key, how)
    if how == "left" and fill is not None:
        j = j.withColumn(value_col, F.coalesce(F.col(value_col), F.lit(fill)))
    return j


# ---------------------------------------------------------------------------
# ops 61-62: roads and their segment id key
# ---------------------------------------------------------------------------

# Property names tried when no property overlaps the ids.
ROAD_KEY_FALLBACKS = ["WVK_ID", "WVKID", "wegvakid", "wegvak_id", "road_id", "ROAD_ID", "ID", "id"]


def detect_join_key(roads: DataFrame, ids: DataFrame, id_col: str = "id_str",
                    props_col: str = "properties") -> DataFrame:
    """One-row table naming the property whose values overlap the known ids most.

    ``explode(properties)`` -> count by (name, value) -> left join with the distinct ids ->
    overlap count per property name -> top-1; equal overlaps are broken by the
    fallback list, then by name. When no property overlaps, the first named
    fallback present in any feature wins, else the smallest property name.
    Runs on all features (the reference samples at most 5,000; the full scan
    is distributed and exact).
    """
    kv = roads.select(F.explode(props_col).alias("prop", "val")).where(F.col("val").isNotNull())
    # one pass over the bags: a value that many features share is one row before it meets the ids
    kv = kv.groupBy("prop", id_text(F.col("val")).alias("val_id")).agg(F.count("*").alias("n"))
    known = ids.select(F.col(id_col).alias("val_id"), F.lit(True).alias("known")).distinct()
    scored = kv.join(known, "val_id", "left").groupBy("prop").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("overlap"))
    fb_rank = F.lit(len(ROAD_KEY_FALLBACKS))
    for i, fb in reversed(list(enumerate(ROAD_KEY_FALLBACKS))):
        fb_rank = F.when(F.col("prop") == fb, F.lit(i)).otherwise(fb_rank)
    scored = scored.withColumn("fb_rank", fb_rank)
    # order: any overlap first by size, then fallback rank, then name
    key = F.struct((-F.col("overlap")).alias("o"), F.col("fb_rank"), F.col("prop"))
    return scored.agg(F.min_by(F.struct("prop", "overlap"), key).alias("m")).select(
        F.col("m.prop").alias("key_field"), F.col("m.overlap").alias("overlap"))


def roads_with_traffic(roads: DataFrame, traffic: DataFrame, key_field: str,
                       id_col: str = "id_str", level_col: str = "mean_level",
                       props_col: str = "properties") -> DataFrame:
    """Road features kept only where the segment has a level; level attached (inner join)."""
    r = roads.withColumn("rid_str", id_text(F.try_element_at(F.col(props_col), F.lit(key_field))))
    r = r.where(F.col("rid_str").isNotNull())
    t = traffic.where(F.col(level_col).isNotNull() & ~F.isnan(level_col))
    return r.join(t, r["rid_str"] == t[id_col], "inner").drop(id_col)


# ---------------------------------------------------------------------------
# ops 63-64
# ---------------------------------------------------------------------------

def merge_suffixes(left: DataFrame, right: DataFrame, on: str,
                   suffixes: tuple[str, str] = ("_sensor", "_loc")) -> DataFrame:
    """Inner join on ``on``; other colliding names get the pandas-style suffixes."""
    common = (set(left.columns) & set(right.columns)) - {on}
    lsel = [F.col(c).alias(c + suffixes[0]) if c in common else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in common else F.col(c) for c in right.columns]
    return left.select(*lsel).join(right.select(*rsel), on, "inner")


def attach_features(long_df: DataFrame, features: DataFrame, on: str = "ts") -> DataFrame:
    """Long counts <- per-timestamp features (left join)."""
    return long_df.join(features, on, "left")
