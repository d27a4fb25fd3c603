"""Registered source / sink queries (ops 1-16, 101).

Each query lands a stand-in in the feed's file format under the shared
scratch folder (``spark.checkpoint.dir``), then reads it back through the
library's reader, so the reader's parsing runs on every row of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdlake.functions import bands as B
from crowdlake.functions import scalars as S
from crowdlake.operators.flatten import carflow_flat
from crowdlake.plans import oracle as O
from crowdlake.plans import standins as SI
from crowdlake.session import scratch_path
from crowdlake.sources import readers as RD
from crowdlake.sources import sinks as SK

QUERIES: dict = {}
ORACLE: dict = {}


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# landing helpers (stand-in -> file in the feed's format)
# ---------------------------------------------------------------------------

NBSP = " "


def land_locations(spark, d) -> str:
    loc = SI.locations(spark, d)
    out = loc.select(F.col("sensor_id_full"), F.col("sensor").cast("string").alias("Objectummer"),
                     F.col("direction").cast("string").alias("sensor_direction"),
                     F.col("name").alias("Locatienaam"), F.col("latlon_txt").alias("Lat/Long"),
                     F.lit(None).cast("string").alias("Breedte"),
                     F.col("width_txt").alias(f"Effectieve{NBSP} breedte"))
    return SK.write_csv(out, scratch_path(spark, "locations_csv"))


def land_flat_text(spark, d):
    flat = carflow_flat(SI.carflow_raw(spark, d))
    return flat.select(F.date_format("time_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time_utc"),
                       F.col("id").cast("string").alias("id"),
                       F.col("traffic_level").cast("string").alias("traffic_level"))


def _features_collection(df, group_col, feature):
    """One FeatureCollection document per group (partitioned write: one document per file)."""
    return (df.select(group_col, feature.alias("f"))
            .groupBy(group_col).agg(F.collect_list("f").alias("features"))
            .select(group_col, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                                  F.col("features"))).alias("value")))


def land_geojson(df, path, group_col):
    df.write.mode("overwrite").partitionBy(group_col).text(path)
    return path


# ---------------------------------------------------------------------------
# 2.1 readers
# ---------------------------------------------------------------------------

@q("read_locations")
def q_read_locations(spark, d):
    return RD.read_locations(spark, land_locations(spark, d))


ORACLE["read_locations"] = O.W("ploc") + """SELECT sensor_id_full, CAST(sensor AS VARCHAR) AS sensor_id,
  direction AS sensor_direction, name, lat, lon, width FROM ploc"""


@q("read_crowd")
def q_read_crowd(spark, d):
    wide = SI.readings_wide(spark, d)
    cal = S.calendar_features("hour")
    txt = wide.select(F.concat(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")).alias("timestamp"),
                      *[F.col(s).cast("string").alias(s) for s in SI.WIDE_SENSORS],
                      *[cal[k].alias(k) for k in ("hour", "minute", "day", "month", "weekday", "is_weekend")])
    path = SK.write_csv(txt, scratch_path(spark, "crowd_csv"))
    out = RD.read_crowd(spark, path)
    return out.select("timestamp", *[r6(F.col(s)).alias(s) for s in SI.WIDE_SENSORS],
                      "hour", "minute", "day", "month", "weekday", "is_weekend")


ORACLE["read_crowd"] = O.W("readings_wide") + "SELECT hour AS \"timestamp\", " + ", ".join(
    f"round({s}, 6) AS {s}" for s in SI.WIDE_SENSORS) + """,
  CAST(hour(hour) AS INTEGER) AS hour, CAST(minute(hour) AS INTEGER) AS minute, CAST(day(hour) AS INTEGER) AS day,
  CAST(month(hour) AS INTEGER) AS month, CAST(isodow(hour) - 1 AS INTEGER) AS weekday,
  CAST(CASE WHEN isodow(hour) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM readings_wide"""


@q("read_weather_hourly")
def q_read_weather_hourly(spark, d):
    st = SI.station_hourly(spark, d)
    padded = st.select(*[F.col(c).cast("string").alias(f"{c:>8}") for c in st.columns])
    path = SK.write_csv(padded, scratch_path(spark, "station_txt"))
    return RD.clean_station(RD.read_weather_hourly(spark, path))


ORACLE["read_weather_hourly"] = O.W("station_clean") + "SELECT * FROM station_clean"

_WT_HEADERS = {"event_id": " Event Id ", "date": "Date", "time": "Time", "temperature": "Temperature",
               "dew_point": "Dew Point", "humidity": "Humidity", "wind_speed": "Wind Speed",
               "wind_gust": "Wind Gust", "pressure": "Pressure", "precip.": "Precip.", "condition": "Condition"}


@q("read_weather_text")
def q_read_weather_text(spark, d):
    wt = SI.weather_text(spark, d)
    txt = wt.select(*[F.col(f"`{c}`").cast("string").alias(h) for c, h in _WT_HEADERS.items()])
    path = SK.write_csv(txt, scratch_path(spark, "weather_text_csv"), encoding="ISO-8859-1")
    out = RD.clean_weather_text(RD.read_weather_text(spark, path))
    return out.withColumn("event_id", F.col("event_id").cast("bigint"))


ORACLE["read_weather_text"] = O.W("wt_num") + "SELECT * FROM wt_num"


@q("read_carflow_nested")
def q_read_carflow_nested(spark, d):
    raw = SI.carflow_raw(spark, d).select(F.col("time").alias("Time"), F.col("data").alias("DATA"))
    path = SK.write_csv(raw, scratch_path(spark, "carflow_raw_csv"))
    return carflow_flat(RD.read_carflow_nested(spark, path))


ORACLE["read_carflow_nested"] = O.W("cf") + "SELECT time_utc, id, traffic_level FROM cf"


@q("read_carflow_flat")
def q_read_carflow_flat(spark, d):
    path = SK.write_csv_gz(land_flat_text(spark, d), scratch_path(spark, "carflow_flat_csv_gz"))
    return RD.read_carflow_flat(spark, path)


ORACLE["read_carflow_flat"] = ORACLE["read_carflow_nested"]


@q("read_carflow_any")
def q_read_carflow_any(spark, d):
    flat = carflow_flat(SI.carflow_raw(spark, d))
    path = SK.write_parquet(flat, scratch_path(spark, "carflow_flat") + ".parquet")
    return RD.read_carflow_any(spark, path)


ORACLE["read_carflow_any"] = ORACLE["read_carflow_nested"]


@q("read_carflow_any_csv")
def q_read_carflow_any_csv(spark, d):
    """The same reader on a flat CSV.GZ and on the raw nested feed."""
    flat = SK.write_csv_gz(land_flat_text(spark, d), scratch_path(spark, "carflow_flat") + ".csv.gz")
    raw = SK.write_csv(SI.carflow_raw(spark, d), scratch_path(spark, "carflow_raw") + ".csv")
    return (RD.read_carflow_any(spark, flat).withColumn("kind", F.lit("flat"))
            .unionByName(RD.read_carflow_any(spark, raw).withColumn("kind", F.lit("nested"))))


ORACLE["read_carflow_any_csv"] = O.W("cf") + """SELECT time_utc, id, traffic_level, 'flat' AS kind FROM cf
UNION ALL SELECT time_utc, id, traffic_level, 'nested' FROM cf"""


@q("read_vessels")
def q_read_vessels(spark, d):
    v = SI.vessels(spark, d)
    comma = lambda c: F.translate(F.col(c).cast("string"), ".", ",")
    txt = v.select(F.concat(F.date_format("time_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("upload-timestamp"),
                   comma("lon").alias("lon"), comma("lat").alias("lat"), F.col("id_str").alias("identifier-sensor"),
                   F.col("speed_cm_s").cast("string").alias("speed-in-centimeters-per-second"))
    path = SK.write_csv(txt, scratch_path(spark, "vessels_csv"), sep=";")
    return RD.read_vessels(spark, path)


ORACLE["read_vessels"] = O.W("vessels") + "SELECT id_str, time_utc, lon, lat, speed_cm_s FROM vessels"


@q("read_snapshot_parquet")
def q_read_snapshot_parquet(spark, d):
    return RD.read_snapshot_parquet(spark, f"{d}/events.parquet")


ORACLE["read_snapshot_parquet"] = "SELECT * FROM events"


def _land_lines(df, feature, path):
    """One feature per line, as many files as tasks."""
    df.select(F.to_json(feature).alias("value")).write.text(path)
    return path


def _land_stops(spark, d):
    st = SI.stops(spark, d)
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.col("name").alias("Naam"), F.col("mode").alias("Modaliteit"),
                             F.col("lines").alias("Lijn")).alias("properties"),
                    F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    return _land_lines(st, feat, scratch_path(spark, "stops_geojson"))


@q("read_stops")
def q_read_stops(spark, d):
    return RD.read_stops(spark, _land_stops(spark, d), one_per_line=True)


ORACLE["read_stops"] = O.W("stops") + "SELECT name, mode, lines, lon, lat FROM stops"


@q("flatten_api_pages")
def q_flatten_api_pages(spark, d):
    cu = SI.table(spark, d, "customer")
    rec = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("naam"),
                   F.col("c_mktsegment").alias("type"),
                   F.struct((F.lit(52.0) + F.col("c_nationkey") / F.lit(100.0)).alias("lat"),
                            (F.lit(4.0) + (F.col("c_custkey") % 1000) / F.lit(1000.0)).alias("lon")).alias("locatie"))
    page = (F.col("c_custkey") / 100).cast("bigint")
    pages = (cu.select(page.alias("page"), rec.alias("r")).groupBy("page")
             .agg(F.collect_list("r").alias("recs"))
             .select("page", F.to_json(F.struct(
                 F.struct(F.col("recs").alias("sensor")).alias("_embedded"),
                 F.struct(F.struct(F.concat(F.lit("page-"), (F.col("page") + 1).cast("string")).alias("href"))
                          .alias("next")).alias("_links"))).alias("value")))
    path = land_geojson(pages, scratch_path(spark, "api_pages"), "page")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("_embedded", T.StructType([T.StructField("sensor", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("naam", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("locatie", T.StructType([T.StructField("lat", T.DoubleType()),
                                               T.StructField("lon", T.DoubleType())]))])))]))])
    return RD.flatten_api_pages(spark, path, "sensor", schema)


ORACLE["flatten_api_pages"] = """SELECT c_custkey AS id, c_name AS naam, c_mktsegment AS type,
  52.0 + c_nationkey / 100.0 AS "locatie.lat", 4.0 + (c_custkey % 1000) / 1000.0 AS "locatie.lon" FROM customer"""


def _land_roads(spark, d, one_per_line=True):
    su = SI.table(spark, d, "supplier")
    lon = F.lit(4.0) + (F.col("s_suppkey") % 200) / F.lit(1000.0)
    lat = F.lit(52.0) + F.col("s_nationkey") / F.lit(1000.0)
    feat = F.struct(F.lit("Feature").alias("type"), F.col("s_suppkey").alias("id"),
                    F.struct(F.col("s_suppkey").cast("double").alias("WVK_ID"), F.col("s_name").alias("name"),
                             F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation")).alias("properties"),
                    F.struct(F.lit("LineString").alias("type"),
                             F.array(F.array(lon, lat), F.array(lon + F.lit(0.001), lat)).alias("coordinates")).alias("geometry"))
    if one_per_line:
        return _land_lines(su, feat, scratch_path(spark, "roads_geojson"))
    grouped = _features_collection(su.withColumn("grp", F.floor(F.col("s_suppkey") / 100)), "grp", feat)
    return land_geojson(grouped, scratch_path(spark, "roads_geojson"), "grp")


@q("read_roads")
def q_read_roads(spark, d):
    roads = RD.read_roads(spark, _land_roads(spark, d), one_per_line=True)
    return roads.select("feature_id", S.id_text(F.try_element_at("properties", F.lit("WVK_ID"))).alias("wvk_id"),
                        F.try_element_at("properties", F.lit("name")).alias("name"), "geom_type")


ORACLE["read_roads"] = """SELECT s_suppkey AS feature_id, CAST(s_suppkey AS VARCHAR) AS wvk_id, s_name AS name,
  'LineString' AS geom_type FROM supplier"""


@q("road_property_names")
def q_road_property_names(spark, d):
    return RD.road_property_names(RD.read_roads(spark, _land_roads(spark, d, one_per_line=False)))


ORACLE["road_property_names"] = "SELECT * FROM (VALUES ('WVK_ID'), ('name'), ('nation')) t(prop)"

# ---------------------------------------------------------------------------
# 2.1 writers
# ---------------------------------------------------------------------------


@q("write_parquet")
def q_write_parquet(spark, d):
    flat = carflow_flat(SI.carflow_raw(spark, d)).withColumn("date", F.to_date("time_utc"))
    path = SK.write_parquet(flat, scratch_path(spark, "flat_by_date"), partition_by=["date"])
    return spark.read.parquet(path).select("time_utc", "id", "traffic_level")


ORACLE["write_parquet"] = ORACLE["read_carflow_nested"]


@q("write_csv_gz")
def q_write_csv_gz(spark, d):
    path = SK.write_csv_gz(land_flat_text(spark, d), scratch_path(spark, "flat_csv_gz"))
    return RD.read_carflow_flat(spark, path)


ORACLE["write_csv_gz"] = ORACLE["read_carflow_nested"]


@q("write_both")
def q_write_both(spark, d):
    pq, cz = scratch_path(spark, "both_parquet"), scratch_path(spark, "both_csv_gz")
    written = SK.write_both(land_flat_text(spark, d), pq, cz, mode="both")
    a = RD.normalise_flat(spark.read.parquet(written["parquet"]), "string").withColumn("format", F.lit("parquet"))
    b = RD.read_carflow_flat(spark, written["csv"]).withColumn("format", F.lit("csv"))
    return a.unionByName(b)


ORACLE["write_both"] = O.W("cf") + """SELECT time_utc, id, traffic_level, 'parquet' AS format FROM cf
UNION ALL SELECT time_utc, id, traffic_level, 'csv' AS format FROM cf"""


@q("write_csv")
def q_write_csv(spark, d):
    from crowdlake.operators.joins import parse_locations
    loc = parse_locations(SI.locations(spark, d)).select("sensor", "name", "lat", "lon", "width")
    path = SK.write_csv(loc, scratch_path(spark, "locations_out_csv"))
    back = RD.read_csv_text(spark, path)
    return back.select(F.col("sensor").cast("bigint").alias("sensor"), "name",
                       *[F.col(c).try_cast("double").alias(c) for c in ("lat", "lon", "width")])


ORACLE["write_csv"] = O.W("ploc") + "SELECT sensor, name, lat, lon, width FROM ploc"

# ---------------------------------------------------------------------------
# 2.10 stop classes (op 101)
# ---------------------------------------------------------------------------


@q("stop_class")
def q_stop_class(spark, d):
    st = SI.stops(spark, d)
    c = B.stop_class("mode", "name", "lines")
    return st.select("stop_id", c["colour"].alias("colour"), c["label"].alias("label"))


ORACLE["stop_class"] = O.W("stops") + """SELECT stop_id, CASE WHEN mode = 'Tram' THEN 'blue' ELSE 'red' END AS colour,
  '<b>' || name || '</b><br>Type: ' || mode || '<br>Lijnen: ' || lines AS label FROM stops"""
