"""Readers on hand-written files: BOM, CRLF, no-break spaces, separators, bad lines."""

import datetime as dt
import gzip
import json
import os

import pytest

from crowdlake.sources import readers as RD
from crowdlake.sources import sinks as SK


def _write(path, text, encoding="utf-8", bom=False):
    with open(path, "wb") as f:
        if bom:
            f.write(b"\xef\xbb\xbf")
        f.write(text.encode(encoding))
    return path


def test_read_locations_bom_crlf_nbsp(spark, tmp_dir):
    header = "Objectummer,Locatienaam,Lat/Long,Breedte,Effectieve  breedte"
    body = ['S-01,Dam,"52.3731, 4.8926",,"6,7"', 'S-02,Rokin,"52.37, 4.89",3,', "S-03,X,,,4"]
    p = _write(os.path.join(tmp_dir, "loc.csv"), "\r\n".join([header] + body) + "\r\n", bom=True)
    rows = {r.sensor_id: r for r in RD.read_locations(spark, p).collect()}
    assert rows["S-01"].width == 6.7 and rows["S-01"].lat == 52.3731 and rows["S-01"].lon == 4.8926
    assert rows["S-02"].width is None
    assert rows["S-03"].lat is None and rows["S-03"].width == 4.0


def test_read_weather_hourly_padded_header(spark, tmp_dir):
    text = "# STN,YYYYMMDD,   HH,    T,   TD,    P,   FF,   FX,   RH,   SQ,    U\n" \
           "  240,20250820,   24,  215,  150,10130,   40,   90,   -1,    3,   80\n"
    p = _write(os.path.join(tmp_dir, "st.txt"), text.replace("# STN", "STN"))
    r = RD.clean_station(RD.read_weather_hourly(spark, p)).first()
    assert r.datetime == dt.datetime(2025, 8, 21, 0, 0) and r.temperature == 21.5 and r.rainfall == -0.1


def test_read_weather_text_latin1(spark, tmp_dir):
    text = ("Date,Time,Temperature,Dew Point,Humidity,Wind Speed,Wind Gust,Pressure,Precip.,Condition\n"
            "20/08/25,1:20 PM,72 °F,60 °F,66 °%,W 9 mph,0 mph,29.92 in,0.0 in,Fair\n")
    p = _write(os.path.join(tmp_dir, "wu.csv"), text, encoding="latin-1")
    r = RD.clean_weather_text(RD.read_weather_text(spark, p)).first()
    assert r.timestamp == dt.datetime(2025, 8, 20, 13, 20)
    assert (r.temperature, r.humidity, r.wind_speed, r.pressure) == (72.0, 66.0, 9.0, 29.92)
    assert r["precip."] == 0.0 and r.condition == "Fair"


def test_read_carflow_nested_bom_multiline(spark, tmp_dir):
    text = 'TIME,Data\n2025-08-20T10:00:00.000+00:00,"id,traffic_level\n1,0.5\n2,0.75"\n' \
           '2025-08-20T10:03:00Z,"id;traffic_level\n3;0.1"\n'
    p = _write(os.path.join(tmp_dir, "cf.csv"), text, bom=True)
    from crowdlake.operators.flatten import carflow_flat
    got = sorted((r.id, r.traffic_level) for r in carflow_flat(RD.read_carflow_nested(spark, p)).collect())
    assert got == [(1, 0.5), (2, 0.75), (3, 0.1)]


def test_read_carflow_nested_requires_columns(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "bad.csv"), "when,what\n1,2\n")
    with pytest.raises(ValueError):
        RD.read_carflow_nested(spark, p)


def test_read_carflow_flat_gz_drops_incomplete(spark, tmp_dir):
    p = os.path.join(tmp_dir, "flat.csv.gz")
    with gzip.open(p, "wt") as f:
        f.write("time_utc,id,traffic_level\n2025-08-20T10:00:00Z,5,0.5\n,6,0.1\n2025-08-20T10:00:00Z,x,0.1\n")
    rows = RD.read_carflow_flat(spark, p).collect()
    assert [(r.id, r.traffic_level) for r in rows] == [(5, 0.5)]
    assert RD.read_carflow_any(spark, p).count() == 1


def test_read_vessels_semicolon_aliases_bad_lines(spark, tmp_dir):
    text = ("upload-timestamp;lon;lat;identifier-sensor;speed-in-centimeters-per-second\n"
            "2025-08-20T10:00:00Z;4,9001;52,3711;A;150\n"
            "2025-08-20T10:01:00Z;4,9;52,37;B\n"
            "2025-08-20T10:02:00Z;4,91;52,38;C;n/a\n")
    p = _write(os.path.join(tmp_dir, "v.csv"), text)
    rows = {r.id_str: r for r in RD.read_vessels(spark, p).collect()}
    assert set(rows) == {"A", "C"}
    assert rows["A"].lon == 4.9001 and rows["A"].lat == 52.3711 and rows["A"].speed_cm_s == 150.0
    assert rows["C"].speed_cm_s is None


def test_read_stops_and_roads_geojson(spark, tmp_dir):
    stops = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"Naam": "Dam", "Modaliteit": "Tram", "Lijn": "2|4"},
         "geometry": {"type": "Point", "coordinates": [4.89, 52.37]}}]}
    ps = _write(os.path.join(tmp_dir, "stops.geojson"), json.dumps(stops, indent=2))
    r = RD.read_stops(spark, ps).first()
    assert (r.name, r.mode, r.lon, r.lat) == ("Dam", "Tram", 4.89, 52.37)
    roads = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": 1, "properties": {"WVK_ID": 12.0, "name": "A10"},
         "geometry": {"type": "LineString", "coordinates": [[4.8, 52.3], [4.81, 52.31]]}}]}
    pr = _write(os.path.join(tmp_dir, "roads.geojson"), json.dumps(roads, indent=2))
    rd = RD.read_roads(spark, pr).first()
    assert rd.properties["WVK_ID"] in ("12.0", "12") and rd.geom_type == "LineString"
    assert [r.prop for r in RD.road_property_names(RD.read_roads(spark, pr)).collect()] == ["WVK_ID", "name"]


def test_flatten_api_pages(spark, tmp_dir):
    for i, recs in enumerate([[{"id": 1, "naam": "a", "loc": {"lat": 52.1, "lon": 4.1}}],
                              [{"id": 2, "naam": "b", "loc": {"lat": 52.2, "lon": 4.2}}]]):
        page = {"_embedded": {"sensor": recs}, "_links": {"next": {"href": f"p{i + 1}"}}}
        _write(os.path.join(tmp_dir, f"page{i}.json"), json.dumps(page, indent=1))
    out = RD.flatten_api_pages(spark, tmp_dir, "sensor")
    assert sorted(out.columns) == ["id", "loc.lat", "loc.lon", "naam"]
    assert sorted(r["loc.lat"] for r in out.collect()) == [52.1, 52.2]


def test_write_both_then_read_back(spark, tmp_dir):
    df = spark.createDataFrame([("2025-08-20T10:00:00Z", "1", "0.5")], "time_utc string, id string, traffic_level string")
    w = SK.write_both(df, os.path.join(tmp_dir, "o.parquet"), os.path.join(tmp_dir, "o.csv.gz"))
    assert set(w) == {"parquet", "csv"}
    assert RD.read_carflow_flat(spark, w["csv"]).count() == 1
    with pytest.raises(ValueError):
        SK.write_both(df, "x", "y", mode="zip")


def test_positions_from_grid_only_without_lon_lat(spark):
    grid = spark.createDataFrame([("a", "155000", "463000"), ("b", None, "463000"), ("c", "x", "1")],
                                 "id string, `position-x` string, `position-y` string")
    out = {r.id: (round(r.lon, 8), round(r.lat, 8)) for r in RD.positions_from_grid(grid).collect()}
    assert out == {"a": (5.38720621, 52.1551744)}
    has = spark.createDataFrame([("a", 4.9, 52.3, "1", "2")], "id string, LON double, Lat double, `position-x` string, `position-y` string")
    assert RD.positions_from_grid(has).collect() == has.collect()


def test_date_partitioned_flat_table_prunes(spark, tmp_dir):
    from pyspark.sql import functions as F

    rows = [(f"2025-08-{d:02d}T10:00:00Z", str(i), "0.5") for d in (20, 21, 22) for i in range(3)]
    df = spark.createDataFrame(rows, "time_utc string, id string, traffic_level string")
    flat = RD.normalise_flat(df, "string").withColumn("date", F.to_date("time_utc"))
    path = SK.write_parquet(flat, os.path.join(tmp_dir, "flat_by_date"), partition_by=["date"])
    q = spark.read.parquet(path).where(F.col("date") == F.lit("2025-08-21").cast("date"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and q.count() == 3


def test_read_carflow_any_requires_flat_columns(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.parquet")
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(p)
    with pytest.raises(ValueError):
        RD.read_carflow_any(spark, p)


def test_sniff_delimiter(spark, tmp_dir):
    a = _write(os.path.join(tmp_dir, "a.csv"), "x,y\n1,2\n", bom=True)
    b = _write(os.path.join(tmp_dir, "b.csv"), "x;y\n1;2\n")
    assert RD.sniff_delimiter(spark, a) == "," and RD.sniff_delimiter(spark, b) == ";"


def test_recent_window_on_date_partitions(spark, tmp_dir):
    from pyspark.sql import functions as F

    from crowdlake.operators.filters import recent_window

    rows = [(dt.datetime(2025, 8, d, h, m), d * 100 + h) for d in (18, 19, 20, 21) for h in (0, 12, 23) for m in (0, 40)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v int").withColumn("date", F.to_date("ts"))
    path = SK.write_parquet(df, os.path.join(tmp_dir, "by_day"), partition_by=["date"])
    table = spark.read.parquet(path)
    for minutes in (15, 600, 2000):
        got = sorted(r.v for r in recent_window(table, "ts", minutes, partition_col="date").collect())
        want = sorted(r.v for r in recent_window(table, "ts", minutes).collect())
        assert got == want and got
    plan = recent_window(table, "ts", 600, partition_col="date")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan


def test_read_weather_hourly_commented_header(spark, tmp_dir):
    text = ("# SOURCE: national weather service\n# YYYYMMDD = date\n#\n"
            "# STN,YYYYMMDD,   HH,    T,   TD,    P,   FF,   FX,   RH,   SQ,    U\n"
            "#\n"
            "  240,20250820,    1,  215,  150,10130,   40,   90,   -1,    3,   80\n"
            "  240,20250820,   24,  200,  140,10120,   30,   80,    2,    0,   85\n")
    p = _write(os.path.join(tmp_dir, "station_hourly.txt"), text)
    rows = RD.clean_station(RD.read_weather_hourly(spark, p)).orderBy("datetime").collect()
    assert [r.datetime for r in rows] == [dt.datetime(2025, 8, 20, 1, 0), dt.datetime(2025, 8, 21, 0, 0)]
    assert (rows[0].temperature, rows[1].relative_humidity, rows[0].rainfall) == (21.5, 85, -0.1)


def test_roads_one_feature_per_line(spark, tmp_dir):
    feats = [{"type": "Feature", "id": i, "properties": {"WVK_ID": i, "name": f"r{i}"},
              "geometry": {"type": "LineString", "coordinates": [[4.8, 52.3], [4.81, 52.31]]}} for i in range(5)]
    p = _write(os.path.join(tmp_dir, "roads.geojsonl"), "\n".join(json.dumps(f) for f in feats) + "\n")
    out = RD.read_roads(spark, p, one_per_line=True)
    assert sorted(r.feature_id for r in out.collect()) == list(range(5))
    assert {r.geom_type for r in out.collect()} == {"LineString"}


def test_read_vessels_from_grid_positions(spark, tmp_dir):
    text = ("upload-timestamp;position-x;position-y;identifier-sensor\n"
            "2025-08-20T10:00:00Z;155000;463000;A\n"
            "2025-08-20T10:01:00Z;;463000;B\n")
    p = _write(os.path.join(tmp_dir, "vgrid.csv"), text)
    rows = {r.id_str: r for r in RD.read_vessels(spark, p).collect()}
    assert set(rows) == {"A"}
    assert abs(rows["A"].lon - 5.38720621) < 1e-9 and abs(rows["A"].lat - 52.1551744) < 1e-9
