"""End-to-end batch jobs (the reference's entry points re-expressed as plans).

* ``crowd_flow_map``   – Entry A: readings -> location join -> flow -> NULL filter -> band.
* ``flow_at_time``     – Entry A's per-refresh call: every sensor's flow at one timestamp.
* ``carflow_frames``   – Entry C: nested feed -> flat rows -> local 3-minute frames.
* ``vessel_snapshot``  – Entry D: positions -> newest-time window -> latest per vessel -> label.
* ``train_crowd_model`` / ``score_and_forecast`` – Entry B's training and scoring jobs.
* ``land_carflow``     – Entry C's landing job (nested feed -> partitioned flat files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.functions.bands import band_flow
from crowdlake.functions.scalars import frame_floor, id_text, to_local_time, vessel_label
from crowdlake.operators.filters import drop_null_flow, recent_window
from crowdlake.operators.flatten import carflow_flat
from crowdlake.operators.joins import flow_for_readings, parse_locations
from crowdlake.operators.windows import latest_per_key


def crowd_flow_map(readings: DataFrame, locations_raw: DataFrame) -> DataFrame:
    """Flow per reading with its circle band; unknown sensors get flow 0, NULL widths are dropped."""
    loc = parse_locations(locations_raw)
    flow = drop_null_flow(flow_for_readings(readings, loc))
    b = band_flow("flow")
    return flow.select("ts", "sensor", "event_id", "count", "width", "flow",
                       b["band"].alias("band"), b["colour"].alias("colour"), b["radius"].alias("radius"))


def flow_at_time(readings: DataFrame, locations_raw: DataFrame, at, key: str = "sensor",
                 ts: str = "ts") -> DataFrame:
    """Flow of every sensor seen in ``readings`` at one timestamp (the live map's call).

    A sensor without a reading at ``at`` gets 0, as does an unknown sensor;
    a known sensor without a width gets NULL (dropped by the map).
    """
    from crowdlake.functions.scalars import ntz_lit

    sensors = readings.select(key).distinct()
    now = readings.where(F.col(ts) == ntz_lit(at))
    flows = flow_for_readings(now, parse_locations(locations_raw)).select(key, "flow", F.lit(True).alias("_has"))
    return sensors.join(flows, key, "left").select(
        key, ntz_lit(at).alias(ts),
        F.when(F.col("_has").isNull(), F.lit(0.0)).otherwise(F.col("flow")).alias("flow"))


def frame_table(flat: DataFrame) -> DataFrame:
    """Flat car-flow rows with local time, 3-minute frame and text id."""
    local = to_local_time("time_utc")
    return flat.select("time_utc", "id", "traffic_level",
                       local.alias("time_local"),
                       frame_floor(local, 3).alias("frame_time"),
                       id_text(F.col("id")).alias("id_str"))


def carflow_frames(raw: DataFrame) -> DataFrame:
    return frame_table(carflow_flat(raw))


def vessel_snapshot(positions: DataFrame, window_minutes: float = 15,
                    tie_col: str = "event_id") -> DataFrame:
    """Latest position per vessel among rows within ``window_minutes`` of the newest time."""
    clean = positions.dropna(subset=["id_str", "time_utc", "lon", "lat"])
    recent = recent_window(clean, "time_utc", window_minutes)
    latest = latest_per_key(recent, "id_str", ["time_utc", tie_col])
    local = to_local_time("time_utc")
    return latest.select("id_str", "time_utc", "lon", "lat", "speed_cm_s",
                         local.alias("time_ams"),
                         vessel_label("id_str", local, "lon", "lat", "speed_cm_s").alias("tooltip"))


# ---------------------------------------------------------------------------
# Entry B: training and scoring jobs
# ---------------------------------------------------------------------------

def train_crowd_model(counts: DataFrame, weather: DataFrame, model_path: str, cutoff,
                      key: str = "sensor", ts: str = "ts", value: str = "count", tie: str = "event_id",
                      weather_cols: list[str] | None = None, weather_order: str | None = None,
                      lags: list[int] | None = None, windows: list[int] | None = None,
                      tolerance_minutes: float = 60, **model_params):
    """Counts <- nearest weather -> features -> rows before ``cutoff`` -> boosted trees -> saved.

    Returns ``(model, features, feature_cols)``.
    """
    from crowdlake.ml.features import CALENDAR, create_features_long
    from crowdlake.ml.models import save_model, train_global_model
    from crowdlake.ml.splits import chronological_split
    from crowdlake.operators.joins import asof_nearest
    from crowdlake.operators.reshape import location_index

    weather_cols = weather_cols or [c for c in weather.columns if c != ts]
    merged = asof_nearest(counts, weather.select(ts, *weather_cols), ts, ts, tolerance_minutes,
                          right_order=weather_order, suffix_ts="weather_ts")
    merged = location_index(merged, key)
    feats = create_features_long(merged, key, ts, value, order_tie=tie, lags=lags, windows=windows)
    feature_cols = (["location_id"] + CALENDAR + [c for c in weather_cols if c != weather_order]
                    + [c for c in feats.columns if c.startswith(("lag_", "roll_mean_"))])
    feats = feats.dropna(subset=feature_cols)
    train = chronological_split(feats, ts, cutoff).where(F.col("split") == "train")
    model = train_global_model(train, feature_cols, value, **model_params)
    save_model(model, model_path)
    return model, feats, feature_cols


def score_and_forecast(model, history: DataFrame, now, key: str = "sensor", ts: str = "ts",
                       value: str = "count", frozen: list[str] | None = None,
                       lags: list[int] | None = None, windows: list[int] | None = None,
                       steps: int = 20, interval_minutes: int = 3, checkpoint_every: int = 5) -> DataFrame:
    """The prediction page as one table: history, current, forecast and actual future per sensor.

    ``history`` must carry the model's frozen inputs (calendar / weather columns).
    """
    from crowdlake.functions.scalars import ntz_lit
    from crowdlake.ml.forecast import recursive_forecast
    from crowdlake.operators.setops import concat_typed_series, typed_series

    frozen = frozen or ["hour", "weekday", "is_weekend"]
    t_now = ntz_lit(now)
    upto = history.where(F.col(ts) <= t_now)
    fc = recursive_forecast(model, upto, key, ts, value, frozen, steps, interval_minutes, lags, windows, checkpoint_every)
    shown = typed_series(history, now, ts, value, [key], steps, interval_minutes).withColumnRenamed(value, "v")
    predicted = concat_typed_series({"prediction_multistep": fc.select(key, ts, F.col("prediction").alias("v"))}, ts, "v", keys=[key])
    return shown.unionByName(predicted).withColumnRenamed("v", "value")


# ---------------------------------------------------------------------------
# Entry C: landing job for the car-flow feed
# ---------------------------------------------------------------------------

def land_carflow(spark, raw_path: str, parquet_path: str, csv_gz_path: str, mode: str = "both") -> dict:
    """Nested feed file(s) -> flat rows -> date-partitioned parquet and/or gzipped CSV."""
    from crowdlake.sources.readers import read_carflow_nested
    from crowdlake.sources.sinks import write_both

    flat = carflow_flat(read_carflow_nested(spark, raw_path)).withColumn("date", F.to_date("time_utc"))
    # rows of a day meet before the write (AQE splits a large day), so a day has few files
    return write_both(flat.hint("rebalance", "date") if mode != "csv" else flat, parquet_path, csv_gz_path, mode,
                      partition_by=["date"], csv_columns=["time_utc", "id", "traffic_level"])


def recent_positions(spark, path: str, window_minutes: float = 15, ts: str = "time_utc") -> DataFrame:
    """The window behind the newest row of a table that ``land_positions`` keeps: only the days it can reach are read."""
    from crowdlake.sources.readers import read_newest_days

    return recent_window(read_newest_days(spark, path, int(-(-window_minutes // 1440))).drop("date"), ts, window_minutes)


def land_positions(positions: DataFrame, path: str, ts: str = "time_utc") -> str:
    """Positions kept by day (``date``) and sorted by time inside each file, for windows that end at the newest row."""
    from crowdlake.sources.sinks import write_parquet

    by_day = positions.withColumn("date", F.to_date(ts)).hint("rebalance", "date").sortWithinPartitions("date", ts)
    return write_parquet(by_day, path, partition_by=["date"])
