"""Streaming versions of the live pages (ops 116-121).

The reference polls files on a timer; here the same transforms run on
Structured Streaming file sources with checkpointed state, so a restarted
query resumes exactly where it stopped. Event time is carried as a real
TIMESTAMP (``event_time``) because watermarks reject TIMESTAMP_NTZ.

Late-data rule (the reference has none): the flow, 3-minute-frame and
feature streams use a 15-minute watermark — the width of the reference's
vessel snapshot. Windows and buffered rows are emitted once the watermark
passes them; rows later than that are dropped. The history and latest-reading
streams keep every row; the vessel window keeps the latest position per
vessel within the window of the newest time seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlake.functions.scalars import crowd_flow, instant_to_utc_ntz, utc_ntz_to_instant
from crowdlake.operators.windows import DEFAULT_LAGS, DEFAULT_ROLLING
from crowdlake.streaming.keyed import KeyedTable
from crowdlake.streaming.state import LatestInWindow, PackedFeatureRing, rocksdb_state

WATERMARK = "15 minutes"


def with_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Add ``event_time`` (TIMESTAMP instant) from a UTC-NTZ column."""
    return df.withColumn("event_time", utc_ntz_to_instant(F.col(ts)))


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


# ---------------------------------------------------------------------------
# op 116: latest reading per sensor
# ---------------------------------------------------------------------------

def stream_latest_reading(readings: DataFrame, key: str = "sensor", ts: str = "ts",
                          tie: str = "event_id", value: str = "count") -> DataFrame:
    """Running ``max_by`` per sensor. In output mode ``update`` a batch emits the sensors it has changed,
    which ``latest_reading_sink`` merges into a keyed table."""
    order = F.struct(F.col(ts), F.col(tie))
    return readings.groupBy(key).agg(
        F.max_by(F.struct(F.col(value).alias(value), F.col(ts).alias(ts), F.col(tie).alias(tie)), order).alias("_m")
    ).select(key, f"_m.{value}", f"_m.{ts}", f"_m.{tie}")


def latest_reading_sink(root: str, key: str = "sensor", ts: str = "ts", tie: str = "event_id", buckets: int = 32) -> KeyedTable:
    """The keyed table of latest readings: a batch rewrites only the buckets of the sensors it has changed."""
    return KeyedTable(root, key, [ts, tie], buckets)


# ---------------------------------------------------------------------------
# ops 117-118: flow and history
# ---------------------------------------------------------------------------

def stream_crowd_flow(readings: DataFrame, locations: DataFrame, key: str = "sensor",
                      ts: str = "ts", value: str = "count", with_band: bool = True) -> DataFrame:
    """Live map as a stream: stream-static join with the typed locations -> flow -> band.

    Idempotent on (ts, sensor) within the watermark. With ``with_band`` the
    circle band, colour and radius are attached; rows without a flow (known
    sensor, no width) are kept with a NULL band so the sink holds every reading.
    """
    from crowdlake.functions.bands import band_flow

    lk = locations.select(F.col(key).alias("_lsensor"), "width", F.lit(True).alias("_known"))
    s = with_event_time(readings, ts).withWatermark("event_time", WATERMARK)
    s = s.dropDuplicatesWithinWatermark([ts, key])
    j = s.join(lk, s[key] == lk["_lsensor"], "left")
    flow = F.when(F.col("_known").isNull(), F.lit(0.0)).otherwise(crowd_flow(value, "width"))
    out = j.withColumn("flow", flow).drop("_lsensor", "_known", "event_time")
    if with_band:
        b = band_flow("flow")
        has = F.col("flow").isNotNull() & ~F.isnan("flow")
        out = out.withColumns({"band": F.when(has, b["band"]), "colour": F.when(has, b["colour"]),
                               "radius": F.when(has, b["radius"])})
    return out


def stream_history(readings: DataFrame) -> DataFrame:
    """Long readings appended as they arrive (the line graph's history table)."""
    return readings


# ---------------------------------------------------------------------------
# op 119: 3-minute frames
# ---------------------------------------------------------------------------

def stream_frames_3min(flat: DataFrame, key: str = "id", ts: str = "time_utc",
                       level: str = "traffic_level") -> DataFrame:
    """Tumbling 3-minute mean per segment; a window is emitted once the watermark passes it."""
    s = with_event_time(flat, ts).withWatermark("event_time", WATERMARK)
    agg = s.groupBy(F.window("event_time", "3 minutes").alias("w"), F.col(key)).agg(F.avg(level).alias("mean_level"))
    return agg.select(key, instant_to_utc_ntz(F.col("w.start")).alias("frame_start_utc"),
                      instant_to_utc_ntz(F.col("w.end")).alias("frame_end_utc"), "mean_level")


# ---------------------------------------------------------------------------
# op 120: latest vessel positions within the window, as changes into a keyed table
# ---------------------------------------------------------------------------

def stream_latest_in_window(positions: DataFrame, window_minutes: float = 15, key: str = "id_str",
                            ts: str = "time_utc", tie: str = "event_id") -> DataFrame:
    """Changes of "latest row per key within the window behind the newest event time" (append mode, RocksDB state).

    One row of state per key; a batch emits an ``upsert`` for each key with a newer row and a ``delete`` for each key whose row
    the watermark, which trails the newest event by the window, has passed - with or without new data of
    that key. So work and output follow the batch, not the table. Rows older than the window are dropped as they come.
    """
    kinds = dict(positions.dtypes)
    columns = [c for c in positions.columns if c != key]
    schema = ", ".join(f"`{c}`: {kinds[c]}" for c in columns)
    out = ", ".join([f"`{key}` {kinds[key]}"] + [f"`{c}` {kinds[c]}" for c in columns] + ["change string"])
    s = with_event_time(positions, ts).withWatermark("event_time", f"{int(window_minutes * 60_000)} milliseconds")
    return s.groupBy(key).transformWithStateInPandas(LatestInWindow(key, ts, tie, columns, schema), out, "append", "eventTime")


def vessel_window_sink(root: str, key: str = "id_str", ts: str = "time_utc", tie: str = "event_id", buckets: int = 32) -> KeyedTable:
    """The keyed table that the window's changes go to."""
    return KeyedTable(root, key, [ts, tie], buckets)


def vessel_window_upsert(table: KeyedTable):
    """``foreachBatch`` function: upserts and deletes of a batch into the keyed table."""
    return table.upserter(deleted=lambda: F.col("change") == "delete")


def vessel_window_table(spark: SparkSession, table: KeyedTable, schema, window_minutes: float = 15, ts: str = "time_utc") -> DataFrame:
    """The window's current rows.

    The watermark has millisecond steps and moves after its batch: the bound behind the newest row is applied once more, exactly.
    """
    rows = table.read(spark, schema).drop("change")
    newest = rows.select(F.max(ts)).scalar()
    return rows.where(F.col(ts) >= F.timestamp_add("MICROSECOND", F.lit(-int(window_minutes * 60_000_000)), newest))


# ---------------------------------------------------------------------------
# op 121: lag / rolling features of each new reading from a per-sensor ring buffer
# ---------------------------------------------------------------------------

def stream_features(readings: DataFrame, key: str = "sensor", ts: str = "ts", tie: str = "event_id",
                    value: str = "count", lags: list[int] | None = None,
                    windows: list[int] | None = None, delay: str = WATERMARK) -> DataFrame:
    """Lag / rolling features of each reading from bounded per-sensor state (append mode, RocksDB state).

    ``transformWithState`` with an event-time timer per sensor: new rows wait in map state, in blocks of time chunks, until the watermark
    passes them, and are then released in (time, tie) order against a ring of the sensor's last
    ``max(lags, windows)`` values in list state. So rows may arrive out of order within the
    delay and the output still equals the batch ``lag_and_rolling`` for every row older than the watermark; rows
    behind the watermark are dropped, and a row that comes twice counts once. A backfill of one
    hot sensor is read back chunk by chunk: memory follows the chunk, not the sensor's rows.
    """
    lags = DEFAULT_LAGS if lags is None else list(lags)
    windows = DEFAULT_ROLLING if windows is None else list(windows)
    key_type = dict(readings.dtypes)[key]
    ring = PackedFeatureRing(key, ts, tie, value, lags, windows)
    s = with_event_time(readings, ts).withWatermark("event_time", delay)
    return ring.unpacked(s.groupBy(key).transformWithStateInPandas(ring, ring.schema(key_type), "append", "eventTime"))


# ---------------------------------------------------------------------------
# running a stream to completion (tests, backfills)
# ---------------------------------------------------------------------------

def run_available(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
                  fmt: str = "parquet", foreach_batch=None) -> None:
    """Process everything available now, then stop (``trigger(availableNow=True)``); state is kept in RocksDB."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocksdb_state(df.sparkSession):
        if foreach_batch is not None:
            q = w.foreachBatch(foreach_batch).start()
        else:
            q = w.format(fmt).option("path", sink_path).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
