"""Registered streaming queries (ops 116-121).

Each query lands its stand-in as files under the shared scratch folder, runs
the streaming job over them with ``trigger(availableNow=True)`` (checkpointed
state, a parquet sink), then returns the sink read back as a batch table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.operators.joins import parse_locations
from crowdlake.plans import oracle as O
from crowdlake.plans import queries as Q
from crowdlake.plans import standins as SI
from crowdlake.session import scratch_path
from crowdlake.sources import sinks as SK
from crowdlake.streaming import jobs as ST

QUERIES: dict = {}
ORACLE: dict = {}


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _land(df, spark, name, files: int = 4):
    path = scratch_path(spark, name)
    df.repartition(files).write.mode("overwrite").parquet(path)
    return path, df.schema


def _readings_stream(spark, d):
    path, schema = _land(SI.readings(spark, d), spark, "readings_src")
    return ST.file_stream(spark, path, schema)


@q("stream_latest_reading")
def q_stream_latest_reading(spark, d):
    latest = ST.stream_latest_reading(_readings_stream(spark, d))
    table = ST.latest_reading_sink(scratch_path(spark, "latest_table"))
    ST.run_available(latest, None, scratch_path(spark, "latest_ckpt"), mode="update", foreach_batch=table.upserter())
    return table.read(spark, latest.schema)


ORACLE["stream_latest_reading"] = O.W("latest_counts") + "SELECT sensor, \"count\", ts, event_id FROM latest_counts"


@q("stream_crowd_flow")
def q_stream_crowd_flow(spark, d):
    loc = parse_locations(SI.locations(spark, d))
    sink = scratch_path(spark, "flow_sink")
    ST.run_available(ST.stream_crowd_flow(_readings_stream(spark, d), loc), sink, scratch_path(spark, "flow_ckpt"))
    return spark.read.parquet(sink).select("ts", "sensor", "event_id", "flow")


ORACLE["stream_crowd_flow"] = O.W("flow") + "SELECT ts, sensor, event_id, flow FROM flow"


@q("stream_history")
def q_stream_history(spark, d):
    sink = scratch_path(spark, "history_sink")
    ST.run_available(ST.stream_history(_readings_stream(spark, d)), sink, scratch_path(spark, "history_ckpt"))
    return spark.read.parquet(sink)


ORACLE["stream_history"] = O.W("readings") + "SELECT * FROM readings"


@q("stream_frames_3min")
def q_stream_frames_3min(spark, d):
    raw = SI.carflow_raw(spark, d)
    src = SK.write_csv(raw, scratch_path(spark, "carflow_raw_stream"))
    schema = "time string, data string"
    nested = ST.file_stream(spark, src, schema, fmt="csv", header=True, multiLine=True, quote='"', escape='"')
    from crowdlake.operators.flatten import carflow_flat
    flat = carflow_flat(nested)
    sink = scratch_path(spark, "frames_sink")
    ST.run_available(ST.stream_frames_3min(flat), sink, scratch_path(spark, "frames_ckpt"))
    out = spark.read.parquet(sink)
    return out.select("id", "frame_start_utc", "frame_end_utc", F.round("mean_level", 6).alias("mean_level"))


ORACLE["stream_frames_3min"] = O.W("cf") + """, w AS (
  SELECT id, time_bucket(INTERVAL 3 MINUTE, time_utc) AS frame_start_utc,
         time_bucket(INTERVAL 3 MINUTE, time_utc) + INTERVAL 3 MINUTE AS frame_end_utc,
         round(avg(traffic_level), 6) AS mean_level
  FROM cf GROUP BY 1, 2)
SELECT * FROM w WHERE frame_end_utc <= (SELECT max(time_utc) FROM cf) - INTERVAL 15 MINUTE"""

VESSEL_WINDOW_MINUTES = 1440


@q("stream_vessel_window")
def q_stream_vessel_window(spark, d):
    path, schema = _land(SI.vessels(spark, d), spark, "vessels_src")
    changes = ST.stream_latest_in_window(ST.file_stream(spark, path, schema, max_files_per_trigger=1), VESSEL_WINDOW_MINUTES)
    table = ST.vessel_window_sink(scratch_path(spark, "vessel_table"))
    ST.run_available(changes, None, scratch_path(spark, "vessel_ckpt"), foreach_batch=ST.vessel_window_upsert(table))
    return (ST.vessel_window_table(spark, table, changes.schema, VESSEL_WINDOW_MINUTES)
            .select("id_str", "time_utc", "lon", "lat", "speed_cm_s"))


ORACLE["stream_vessel_window"] = O.W("vessels") + """, rw AS (
  SELECT * FROM vessels QUALIFY row_number() OVER (PARTITION BY id_str ORDER BY time_utc DESC, event_id DESC) = 1)
SELECT id_str, time_utc, lon, lat, speed_cm_s FROM rw
WHERE time_utc >= (SELECT max(time_utc) FROM vessels) - INTERVAL 1440 MINUTE"""


@q("stream_features")
def q_stream_features(spark, d):
    sink = scratch_path(spark, "features_sink")
    feats = ST.stream_features(_readings_stream(spark, d), "sensor", "ts", "event_id", "count",
                               Q.LAGS, Q.ROLLING)
    ST.run_available(feats, sink, scratch_path(spark, "features_ckpt"))
    out = spark.read.parquet(sink)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("roll_mean_")})


# rows the final watermark (newest event time, in ms, minus 15 minutes) has passed
ORACLE["stream_features"] = "WITH " + SI.SQL["readings"] + ",\n" + O._feat_sql(Q.LAGS, Q.ROLLING, "sf") + \
    "\nSELECT sensor, ts, event_id, \"count\", " + ", ".join(f"lag_{k}" for k in Q.LAGS) + ", " + \
    ", ".join(f"round(roll_mean_{n}, 6) AS roll_mean_{n}" for n in Q.ROLLING) + \
    " FROM sf WHERE epoch_us(ts) <= ((SELECT epoch_ms(max(ts)) FROM events) - 900000) * 1000"

