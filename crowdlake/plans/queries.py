"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's tables through the stand-ins and runs the
operator over the whole table. Doubles produced by aggregation (whose
summation order differs between engines) are rounded to 6 decimals; exact
IEEE arithmetic (the same operations in the same order) is left unrounded.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.functions import bands as B
from crowdlake.functions import scalars as S
from crowdlake.functions.scalars import ntz_lit
from crowdlake.operators import aggregates as A
from crowdlake.operators import filters as FL
from crowdlake.operators import joins as J
from crowdlake.operators import maps as M
from crowdlake.operators import reshape as R
from crowdlake.operators import setops as SO
from crowdlake.operators import topk as TK
from crowdlake.operators import windows as W
from crowdlake.operators.flatten import carflow_flat, flatten_carflow
from crowdlake.plans import jobs
from crowdlake.plans import standins as SI
from crowdlake.session import scratch_path

QUERIES: dict = {}

# Fixed parameters of the registered queries (features of the operators, not row caps).
NOW = dt.datetime(2024, 1, 15, 12, 0, 0)
CHOSEN_SENSORS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]
# The reference model's full feature lists.
LAGS, ROLLING = W.DEFAULT_LAGS, W.DEFAULT_ROLLING
SELECTED_VESSELS = ["1", "2", "3"]


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# shared derived tables
# ---------------------------------------------------------------------------

@SI.per_session
def parsed_locations(spark, d) -> DataFrame:
    return J.parse_locations(SI.locations(spark, d))


@SI.per_session
def flat_carflow(spark, d) -> DataFrame:
    return carflow_flat(SI.carflow_raw(spark, d))


@SI.per_session
def carflow_frames(spark, d) -> DataFrame:
    return jobs.frame_table(flat_carflow(spark, d))


@SI.per_session
def resampled_3min(spark, d) -> DataFrame:
    fr = carflow_frames(spark, d)
    return A.resample_minutes(fr, "id_str", "time_local", "traffic_level", 3, "time_local")


@SI.per_session
def features_table(spark, d, dropna=True) -> DataFrame:
    """Model features (op 80) of the long readings: calendar, lags and rolling means per sensor."""
    from crowdlake.ml.features import create_features_long

    return create_features_long(SI.readings(spark, d), "sensor", "ts", "count", order_tie="event_id",
                                lags=LAGS, windows=ROLLING, dropna=dropna)


@SI.per_session
def scored_table(spark, d) -> DataFrame:
    """Hold-out scores of the persistence baseline (prediction = previous count)."""
    f = features_table(spark, d)
    return f.select("sensor", "ts", "count", F.col("lag_1").alias("pred"))


@SI.per_session
def station_clean(spark, d) -> DataFrame:
    from crowdlake.sources.readers import clean_station

    return clean_station(SI.station_hourly(spark, d))


@SI.per_session
def weather_text_numbers(spark, d) -> DataFrame:
    from crowdlake.sources.readers import clean_weather_text

    out = clean_weather_text(SI.weather_text(spark, d))
    return out.withColumn("event_id", F.col("event_id").cast("bigint"))


# ---------------------------------------------------------------------------
# 2.2 flattening and reshaping
# ---------------------------------------------------------------------------

@q("flatten_carflow")
def q_flatten_carflow(spark, d):
    return flat_carflow(spark, d)           # carflow_flat(raw, keep_first_pair=True), built once


@q("flatten_carflow_strict")
def q_flatten_carflow_strict(spark, d):
    return carflow_flat(SI.carflow_raw(spark, d), keep_first_pair=False)


@q("flatten_carflow_quoted")
def q_flatten_carflow_quoted(spark, d):
    """Frames whose quoted fields hold separators, quotes and line breaks."""
    return carflow_flat(SI.carflow_quoted(spark, d))


@q("flatten_carflow_quoted_strict")
def q_flatten_carflow_quoted_strict(spark, d):
    return carflow_flat(SI.carflow_quoted(spark, d), keep_first_pair=False)


@q("pack_carflow")
def q_pack_carflow(spark, d):
    """The packed rows of text rows with good and bad times, ids and levels: two of seven rows are spoilt."""
    from crowdlake.operators.flatten import pack_carflow

    txt = flatten_carflow(SI.carflow_raw(spark, d))
    kind = F.pmod(F.length("level_raw") + F.col("id_raw").try_cast("bigint"), F.lit(7))
    return pack_carflow(txt.select("time_raw", F.when(kind == 1, F.concat("id_raw", F.lit(".0"))).when(kind == 2, F.lit("x")).otherwise(F.col("id_raw")).alias("id_raw"),
                                   F.when(kind == 3, F.lit("n/a")).when(kind == 4, F.concat(F.lit(" "), "level_raw", F.lit(" "))).otherwise(F.col("level_raw")).alias("level_raw")))


@q("melt_counts")
def q_melt_counts(spark, d):
    wide = SI.readings_wide(spark, d).withColumnRenamed("hour", "timestamp")
    cal = S.calendar_features("timestamp")
    wide = wide.withColumns({k: cal[k] for k in R.CALENDAR_COLUMNS})
    out = R.melt_counts(wide, ["timestamp"] + R.CALENDAR_COLUMNS, SI.WIDE_SENSORS, "sensor_id", "count")
    return out.withColumn("count", r6(F.col("count")))


@q("melt_with_features")
def q_melt_with_features(spark, d):
    wide = SI.readings_wide(spark, d)
    st = station_clean(spark, d)
    hourly_w = A.resample_hourly(st, "datetime", ["temperature", "air_pressure"], fill_gaps=False)
    wide = wide.join(hourly_w, "hour", "left")
    out = R.melt_with_features(wide, "hour", SI.WIDE_SENSORS, ["temperature", "air_pressure"])
    return out.withColumns({"temperature": r6(F.col("temperature")), "air_pressure": r6(F.col("air_pressure")),
                            "count": r6(F.col("count"))})


@q("location_index")
def q_location_index(spark, d):
    rd = SI.readings(spark, d)
    return R.location_index(rd, "sensor").select("sensor", "ts", "location_id")


@q("latest_row_to_kv")
def q_latest_row_to_kv(spark, d):
    out = R.latest_row_to_kv(SI.readings_wide(spark, d), "hour", SI.WIDE_SENSORS)
    return out.withColumn("value", r6(F.col("value")))


@q("pivot_predictions")
def q_pivot_predictions(spark, d):
    long = R.melt_counts(SI.readings_wide(spark, d), ["hour"], SI.WIDE_SENSORS, "sensor", "actual")
    from pyspark.sql import Window
    long = long.withColumn("pred", F.lag("actual", 1).over(Window.partitionBy("sensor").orderBy("hour")))
    p = R.pivot_predictions(long, "hour", "sensor", "actual", "pred", SI.WIDE_SENSORS)
    return p.select("hour", *[r6(F.col(c)).alias(c) for c in p.columns if c != "hour"])


@q("sensor_direction_split")
def q_sensor_direction_split(spark, d):
    loc = SI.locations(spark, d).select("sensor_id_full")
    return R.sensor_direction_split(loc, "sensor_id_full")


# ---------------------------------------------------------------------------
# 2.3 scalar functions
# ---------------------------------------------------------------------------

@q("parse_iso_utc")
def q_parse_iso_utc(spark, d):
    raw = SI.carflow_raw(spark, d)
    return raw.select("time", S.parse_iso_utc("time").alias("time_utc"))


@q("to_local_time")
def q_to_local_time(spark, d):
    v = SI.vessels(spark, d)
    return v.select("event_id", "time_utc", S.to_local_time("time_utc").alias("time_local"))


@q("frame_floor")
def q_frame_floor(spark, d):
    return SI.readings(spark, d).select("event_id", "ts", S.frame_floor("ts", 3).alias("frame_time"))


@q("drop_tz")
def q_drop_tz(spark, d):
    v = SI.vessels(spark, d)
    return v.select("event_id", S.drop_tz("time_utc").alias("wall_clock"))


@q("localize")
def q_localize(spark, d):
    rd = SI.readings(spark, d)
    utc, amb = S.localize("ts")
    return rd.select("event_id", "ts", utc.alias("ts_utc"), amb.alias("ambiguous"))


@q("decimal_comma")
def q_decimal_comma(spark, d):
    loc = SI.locations(spark, d)
    return loc.select("sensor", "width_txt", S.decimal_comma("width_txt").alias("width"))


@q("split_lat_lon")
def q_split_lat_lon(spark, d):
    loc = SI.locations(spark, d)
    lat, lon = S.split_lat_lon("latlon_txt")
    return loc.select("sensor", lat.alias("lat"), lon.alias("lon"))


@q("hour24_fix")
def q_hour24_fix(spark, d):
    st = SI.station_hourly(spark, d)
    return st.select("YYYYMMDD", "HH", S.hour24_fix("YYYYMMDD", "HH").alias("datetime"))


@q("tenths_to_units")
def q_tenths_to_units(spark, d):
    return station_clean(spark, d)


@q("imperial_to_metric")
def q_imperial_to_metric(spark, d):
    n = weather_text_numbers(spark, d).withColumnRenamed("precip.", "precipitation")
    conv = S.imperial_to_metric()
    return n.select("event_id", *[conv[k].alias(k) for k in conv])


@q("clean_text")
def q_clean_text(spark, d):
    wt = SI.weather_text(spark, d)
    return wt.select("event_id", S.clean_text("temperature").alias("temperature"),
                     S.clean_text("humidity").alias("humidity"), S.clean_text("condition").alias("condition"))


@q("extract_number")
def q_extract_number(spark, d):
    wt = SI.weather_text(spark, d)
    return wt.select("event_id", S.extract_number("wind_speed").alias("wind_speed"),
                     S.extract_number("pressure").alias("pressure"),
                     S.extract_number("condition").alias("condition_number"))


@q("parse_date_ampm")
def q_parse_date_ampm(spark, d):
    wt = SI.weather_text(spark, d)
    return wt.select("event_id", S.parse_date_ampm("date", "time").alias("timestamp"))


@q("select_rename")
def q_select_rename(spark, d):
    n = weather_text_numbers(spark, d)
    keep = ["timestamp", "temperature", "dew_point", "humidity", "wind_speed", "wind_gust", "pressure",
            "precip.", "condition"]
    return n.select(*[F.col(f"`{c}`") for c in keep]).withColumnRenamed("precip.", "precipitation")


@q("calendar_features")
def q_calendar_features(spark, d):
    cal = S.calendar_features("ts")
    rd = SI.readings(spark, d)
    return rd.select("event_id", cal["hour"].alias("hour"), cal["weekday"].alias("weekday"),
                     cal["is_weekend"].alias("is_weekend"), F.round(cal["time_sin"], 9).alias("time_sin"),
                     F.round(cal["time_cos"], 9).alias("time_cos"))


@q("crowd_flow")
def q_crowd_flow(spark, d):
    rd = SI.readings(spark, d)
    loc = parsed_locations(spark, d)
    j = rd.join(loc.select("sensor", "width"), "sensor", "inner")
    return j.select("event_id", "sensor", S.crowd_flow("count", "width").alias("flow"))


@q("id_text")
def q_id_text(spark, d):
    r = SI.roads(spark, d)
    kv = r.select("feature_id", F.explode("properties").alias("prop", "val"))
    return kv.select("feature_id", "prop", S.id_text("val").alias("id_text"))


@q("vessel_label")
def q_vessel_label(spark, d):
    v = SI.vessels(spark, d)
    local = S.to_local_time("time_utc")
    return v.select("event_id", S.vessel_label("id_str", local, "lon", "lat", "speed_cm_s").alias("tooltip"))


@q("rd_to_lonlat")
def q_rd_to_lonlat(spark, d):
    from crowdlake.sources.readers import positions_from_grid

    ev = SI.table(spark, d, "events")
    grid = ev.select("event_id",
                     F.when(F.col("event_id") % 50 != 0, F.lit(100000.0) + F.col("value") * F.lit(100.0))
                     .alias("position-x"),
                     (F.lit(450000.0) + (F.col("event_id") % 1000) * F.lit(50.0)).alias("position-y"))
    out = positions_from_grid(grid)
    return out.select("event_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


# ---------------------------------------------------------------------------
# 2.4 filters
# ---------------------------------------------------------------------------

@q("filter_sensors")
def q_filter_sensors(spark, d):
    return FL.filter_sensors(SI.readings(spark, d), "sensor", CHOSEN_SENSORS)


@q("filter_time_range")
def q_filter_time_range(spark, d):
    return FL.filter_time_range(SI.readings(spark, d), "ts", dt.datetime(2024, 1, 10, 0, 0),
                                dt.datetime(2024, 1, 12, 12, 0))


@q("filter_date_slice")
def q_filter_date_slice(spark, d):
    return FL.filter_date_slice(station_clean(spark, d), "datetime", "2024-01-05", "2024-01-09")


@q("recent_window")
def q_recent_window(spark, d):
    return FL.recent_window(SI.vessels(spark, d), "time_utc", 1440)


@q("recent_window_daily")
def q_recent_window_daily(spark, d):
    """The same window over positions that are kept by day and sorted by time: only the newest days are read."""
    path = jobs.land_positions(SI.vessels(spark, d), scratch_path(spark, "positions_by_day"))
    return jobs.recent_positions(spark, path, 1440)


@q("drop_incomplete")
def q_drop_incomplete(spark, d):
    loc = parsed_locations(spark, d)
    return FL.drop_incomplete(loc, ["lat", "lon", "width"]).select("sensor", "name", "lat", "lon", "width")


@q("incomplete_rows")
def q_incomplete_rows(spark, d):
    """Location rows skipped by the circle layer (4 fields) or the arrow layer (5 fields)."""
    loc = parsed_locations(spark, d)
    return FL.incomplete_rows_by_layer(loc, {"circles": M.CIRCLE_REQUIRED, "arrows": M.ARROW_REQUIRED},
                                       ["sensor", "name"])


@q("drop_null_flow")
def q_drop_null_flow(spark, d):
    f = J.flow_for_readings(SI.readings(spark, d), parsed_locations(spark, d))
    return FL.drop_null_flow(f).select("event_id", "sensor", "flow")


@q("split_past_now_future")
def q_split_past_now_future(spark, d):
    return FL.split_past_now_future(SI.readings(spark, d), "ts", NOW, 20, 3)


@q("positive_only")
def q_positive_only(spark, d):
    f = J.flow_for_readings(SI.readings(spark, d), parsed_locations(spark, d))
    return FL.positive_only(f, "flow").select("event_id", "sensor", "flow")


@q("missing_profile")
def q_missing_profile(spark, d):
    return FL.missing_profile(SI.readings_wide(spark, d))


@q("describe_profile")
def q_describe_profile(spark, d):
    out = FL.describe_profile(SI.readings(spark, d), ["count", "sensor"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "p25", "p50", "p75")})


@q("duplicate_count")
def q_duplicate_count(spark, d):
    rd = SI.readings(spark, d)
    return FL.duplicate_count(rd.select("sensor", F.date_trunc("hour", "ts").alias("hour")))


# ---------------------------------------------------------------------------
# 2.5 joins
# ---------------------------------------------------------------------------

@q("asof_nearest")
def q_asof_nearest(spark, d):
    left = SI.counts_for_weather(spark, d)
    right = SI.weather(spark, d)
    return J.asof_nearest(left, right, "ts", "ts", 60, right_order="w_id", suffix_ts="weather_ts")


@q("join_sensor_location")
def q_join_sensor_location(spark, d):
    sensors = SI.readings(spark, d).select("sensor").distinct()
    loc = parsed_locations(spark, d).select(F.col("sensor").alias("loc_sensor"), "name", "lat", "lon", "width")
    return J.join_sensor_location(sensors, loc, "sensor", "loc_sensor").drop("loc_sensor")


@q("flow_for_timestamp")
def q_flow_for_timestamp(spark, d):
    f = J.flow_for_readings(SI.readings(spark, d), parsed_locations(spark, d))
    return f.select("ts", "sensor", "event_id", "flow")


@q("locations_with_reading")
def q_locations_with_reading(spark, d):
    latest = W.latest_per_key(SI.readings(spark, d), "sensor", ["ts", "event_id"])
    loc = parsed_locations(spark, d).select("sensor", "name", "lat", "lon")
    return J.locations_with_reading(loc, latest, "sensor", "count", "left", 0.0)


@q("roads_with_traffic")
def q_roads_with_traffic(spark, d):
    seg = A.segment_mean_in_frame(carflow_frames(spark, d))
    out = J.roads_with_traffic(SI.roads(spark, d), seg, "WVK_ID")
    return out.select("feature_id", "frame_time", "rid_str", r6(F.col("mean_level")).alias("mean_level"))


@q("detect_join_key")
def q_detect_join_key(spark, d):
    ids = flat_carflow(spark, d).select(F.col("id").cast("string").alias("id_str"))
    return J.detect_join_key(SI.roads(spark, d), ids)


@q("merge_suffixes")
def q_merge_suffixes(spark, d):
    cu = SI.table(spark, d, "customer").select(F.col("c_custkey").alias("sensorId"), F.col("c_name").alias("name"),
                                               F.col("c_nationkey").alias("nation"))
    su = SI.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sensorId"), F.col("s_name").alias("name"),
                                               F.col("s_nationkey").alias("nation"))
    return J.merge_suffixes(cu, su, "sensorId")


@q("attach_features")
def q_attach_features(spark, d):
    rd = SI.readings(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    st = station_clean(spark, d)
    hourly = A.resample_hourly(st, "datetime", ["temperature"], fill_gaps=False)
    out = J.attach_features(rd, hourly, "hour")
    return out.select("event_id", "sensor", "count", r6(F.col("temperature")).alias("temperature"))


# ---------------------------------------------------------------------------
# 2.6 aggregations
# ---------------------------------------------------------------------------

def _frame_totals(spark, d):
    rd = SI.readings(spark, d).withColumn("frame", S.frame_floor("ts", 3))
    return A.total_crowd(rd, "frame", "count")


@q("total_crowd")
def q_total_crowd(spark, d):
    return _frame_totals(spark, d).withColumn("total", r6(F.col("total")))


@q("total_crowd_wide")
def q_total_crowd_wide(spark, d):
    out = A.total_crowd_wide(SI.readings_wide(spark, d), SI.WIDE_SENSORS, "hour")
    return out.withColumn("total", r6(F.col("total")))


@q("mean_by_hour")
def q_mean_by_hour(spark, d):
    out = A.mean_by_hour(_frame_totals(spark, d), "frame", "total")
    return out.withColumn("mean_total", r6(F.col("mean_total")))


@q("mean_by_weekday")
def q_mean_by_weekday(spark, d):
    out = A.mean_by_weekday(_frame_totals(spark, d), "frame", "total")
    return out.withColumn("mean_total", r6(F.col("mean_total")))


@q("segment_mean_in_frame")
def q_segment_mean_in_frame(spark, d):
    out = A.segment_mean_in_frame(carflow_frames(spark, d))
    return out.withColumn("mean_level", r6(F.col("mean_level")))


@q("resample_3min")
def q_resample_3min(spark, d):
    return resampled_3min(spark, d).withColumn("traffic_level", r6(F.col("traffic_level")))


@q("resample_hourly")
def q_resample_hourly(spark, d):
    out = A.resample_hourly(SI.readings(spark, d), "ts", ["count"], fill_gaps=True)
    return out.withColumn("count", r6(F.col("count")))


@q("frame_list")
def q_frame_list(spark, d):
    return A.frame_list(carflow_frames(spark, d), "frame_time")


@q("frame_range")
def q_frame_range(spark, d):
    return A.frame_range(carflow_frames(spark, d), "time_local")


@q("distinct_times_range")
def q_distinct_times_range(spark, d):
    return A.distinct_times_range(flat_carflow(spark, d), "time_utc")


@q("map_center")
def q_map_center(spark, d):
    latest = W.latest_per_key(SI.vessels(spark, d), "id_str", ["time_utc", "event_id"])
    return A.map_center_points(latest).select(r6(F.col("center_lat")).alias("center_lat"),
                                              r6(F.col("center_lon")).alias("center_lon"))


@q("map_center_lines")
def q_map_center_lines(spark, d):
    """Centre on the first displayed road: the first feature that has traffic in some frame."""
    seg = A.segment_mean_in_frame(carflow_frames(spark, d))
    shown = J.roads_with_traffic(SI.roads(spark, d), seg, "WVK_ID").select("feature_id", "coordinates").distinct()
    return A.map_center_lines(shown)


@q("metrics_by_location")
def q_metrics_by_location(spark, d):
    out = A.metrics_by_location(scored_table(spark, d), "sensor", "count", "pred")
    return out.select("sensor", r6(F.col("mae")).alias("mae"), r6(F.col("rmse")).alias("rmse"), "n")


def _r2(spark, d):
    return A.r2_by_sensor(scored_table(spark, d), "sensor", "count", "pred")


@q("r2_by_sensor")
def q_r2_by_sensor(spark, d):
    return _r2(spark, d).select("sensor", r6(F.col("r2")).alias("r2"), r6(F.col("mae")).alias("mae"), "n")


@q("metrics_summary")
def q_metrics_summary(spark, d):
    out = A.metrics_summary(_r2(spark, d))
    return out.select(r6(F.col("mean_mae")).alias("mean_mae"), r6(F.col("mean_r2")).alias("mean_r2"))


@q("mse")
def q_mse(spark, d):
    return A.mse(scored_table(spark, d), "count", "pred").select(r6(F.col("mse")).alias("mse"))


# ---------------------------------------------------------------------------
# 2.7 windows
# ---------------------------------------------------------------------------

def _round_feats(df):
    return df.withColumns({c: r6(F.col(c)) for c in df.columns if c.startswith("roll_mean_")})


@q("lag_features")
def q_lag_features(spark, d):
    rd = SI.readings(spark, d)
    return W.lag_and_rolling(rd, "sensor", ["ts", "event_id"], "count", LAGS, [])


@q("rolling_means")
def q_rolling_means(spark, d):
    rd = SI.readings(spark, d)
    return _round_feats(W.lag_and_rolling(rd, "sensor", ["ts", "event_id"], "count", [], ROLLING))


@q("create_features")
def q_create_features(spark, d):
    return _round_feats(features_table(spark, d, dropna=True))


@q("latest_per_key")
def q_latest_per_key(spark, d):
    return W.latest_per_key(SI.vessels(spark, d), "id_str", ["time_utc", "event_id"])


@q("latest_feature_row")
def q_latest_feature_row(spark, d):
    f = features_table(spark, d, dropna=False)
    return _round_feats(W.latest_per_key(f, "sensor", ["ts", "event_id"]))


@q("tail_n_per_key")
def q_tail_n_per_key(spark, d):
    out = W.tail_n_per_key(resampled_3min(spark, d), "id_str", ["time_local"], 20)
    return out.withColumn("traffic_level", r6(F.col("traffic_level")))


@q("sliding_window_vectors")
def q_sliding_window_vectors(spark, d):
    long = R.melt_counts(SI.readings_wide(spark, d), ["hour"], SI.WIDE_SENSORS, "sensor", "value")
    out = W.sliding_window_vectors(long, "sensor", "hour", "value", past_hours=3, horizon=1)
    return out.select("sensor", "window_end", F.transform("past_values", lambda x: F.round(x, 6)).alias("past_values"),
                      r6(F.col("past_mean")).alias("past_mean"), r6(F.col("past_std")).alias("past_std"),
                      r6(F.col("target")).alias("target"), "target_ts")


# ---------------------------------------------------------------------------
# 2.8 top-k
# ---------------------------------------------------------------------------

@q("topk_segments")
def q_topk_segments(spark, d):
    out = TK.topk_segments(resampled_3min(spark, d), "id_str", "traffic_level", 5)
    return out.withColumn("mean_level", r6(F.col("mean_level")))


@q("topk_series")
def q_topk_series(spark, d):
    res = resampled_3min(spark, d)
    top = TK.topk_segments(res, "id_str", "traffic_level", 5)
    out = TK.topk_series(res, top, "id_str", "time_local", 20)
    return out.withColumn("traffic_level", r6(F.col("traffic_level")))


@q("worst_k_models")
def q_worst_k_models(spark, d):
    out = TK.worst_k(_r2(spark, d), "mae", "sensor", 5)
    return out.select("sensor", r6(F.col("mae")).alias("mae"), r6(F.col("r2")).alias("r2"))


@q("best_worst_model")
def q_best_worst_model(spark, d):
    out = TK.best_worst(_r2(spark, d), "sensor", "r2")
    return out.select("best_sensor", r6(F.col("best_r2")).alias("best_r2"), "worst_sensor",
                      r6(F.col("worst_r2")).alias("worst_r2"))


@q("sort_series")
def q_sort_series(spark, d):
    return TK.sort_series(SI.readings(spark, d), ["sensor", "ts"])


# ---------------------------------------------------------------------------
# 2.9 set operations
# ---------------------------------------------------------------------------

@q("concat_typed_series")
def q_concat_typed_series(spark, d):
    rd = SI.readings(spark, d).select(F.col("ts").alias("timestamp"), F.col("count").alias("value"), "sensor")
    return SO.typed_series(rd, NOW, "timestamp", "value", keys=["sensor"], steps=20, minutes=3)


@q("concat_history_current")
def q_concat_history_current(spark, d):
    return SO.history_and_current(SI.readings(spark, d), "ts", NOW)


@q("concat_columns")
def q_concat_columns(spark, d):
    sensors = SI.readings_wide(spark, d)
    weather = A.resample_hourly(station_clean(spark, d).withColumnRenamed("datetime", "ts"), "ts",
                                ["temperature", "rainfall"], fill_gaps=False)
    out = SO.concat_columns(sensors, weather, "hour")
    return out.select(*[r6(F.col(c)).alias(c) if c != "hour" else F.col(c) for c in out.columns])


@q("distinct_sensors")
def q_distinct_sensors(spark, d):
    return SO.distinct_sorted(SI.vessels(spark, d), "id_str")


# ---------------------------------------------------------------------------
# 2.10 bands and map-ready tables
# ---------------------------------------------------------------------------

def _latest_counts(spark, d):
    return W.latest_per_key(SI.readings(spark, d), "sensor", ["ts", "event_id"])


@q("band_count")
def q_band_count(spark, d):
    lt = _latest_counts(spark, d)
    b = B.band_count("count")
    return lt.select("sensor", "count", b["band"].alias("band"), b["colour"].alias("colour"),
                     b["radius"].alias("radius"))


@q("band_flow")
def q_band_flow(spark, d):
    return jobs.crowd_flow_map(SI.readings(spark, d), SI.locations(spark, d)).select(
        "event_id", "flow", "band", "colour", "radius")


@q("band_arrow_count")
def q_band_arrow_count(spark, d):
    lt = _latest_counts(spark, d)
    loc = parsed_locations(spark, d).select("sensor", "direction")
    j = J.locations_with_reading(loc, lt, "sensor", "count", "left", 0.0)
    b = B.band_arrow_count("count")
    return j.select("sensor", "direction", "count", b["band"].alias("band"), b["colour"].alias("colour"))


@q("band_arrow_flow")
def q_band_arrow_flow(spark, d):
    f = jobs.crowd_flow_map(SI.readings(spark, d), SI.locations(spark, d))
    b = B.band_arrow_flow("flow")
    return f.select("event_id", "flow", b["band"].alias("band"), b["colour"].alias("colour"))


@q("band_traffic")
def q_band_traffic(spark, d):
    seg = A.segment_mean_in_frame(carflow_frames(spark, d))
    b = B.band_traffic("mean_level")
    return seg.select("frame_time", "id_str", b["band"].alias("band"), b["rgba"].alias("rgba"))


@q("heat_points")
def q_heat_points(spark, d):
    lt = _latest_counts(spark, d)
    loc = parsed_locations(spark, d).select("sensor", "name", "lat", "lon")
    j = J.locations_with_reading(loc, lt, "sensor", "count", "left", 0.0)
    return M.heat_points(j, "count")


@q("highlight_flag")
def q_highlight_flag(spark, d):
    latest = W.latest_per_key(SI.vessels(spark, d), "id_str", ["time_utc", "event_id"])
    h = B.highlight_flag("id_str", SELECTED_VESSELS)
    return latest.select("id_str", *[h[k].alias(k) for k in ("highlighted", "r", "g", "b", "a")])


@q("traffic_features")
def q_traffic_features(spark, d):
    seg = A.segment_mean_in_frame(carflow_frames(spark, d))
    rw = J.roads_with_traffic(SI.roads(spark, d), seg, "WVK_ID")
    out = M.traffic_features(rw, "mean_level", "rid_str")
    return out.select("feature_id", "frame_time", "traffic_level_2d", "width", "band", "rgba")


# ---------------------------------------------------------------------------
# entry flagship
# ---------------------------------------------------------------------------

@q("crowd_flow_map")
def q_crowd_flow_map(spark, d):
    return jobs.crowd_flow_map(SI.readings(spark, d), SI.locations(spark, d))


@q("flow_at_time")
def q_flow_at_time(spark, d):
    """Every sensor's flow at the newest reading's time; sensors without a reading then give 0."""
    rd = SI.readings(spark, d)
    at = rd.agg(F.max("ts")).first()[0]
    return jobs.flow_at_time(rd, SI.locations(spark, d), at)


@q("vessel_snapshot")
def q_vessel_snapshot(spark, d):
    return jobs.vessel_snapshot(SI.vessels(spark, d), 1440).drop("tooltip")
