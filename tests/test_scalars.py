"""Scalar functions on the hand-written edge cases of FIXTURES.md §3."""

import datetime as dt
import random

from pyspark.sql import functions as F

from crowdlake.functions import scalars as S


def test_parse_iso_utc_variants(spark):
    df = spark.createDataFrame([("2025-08-20T00:00:00.123+02:00",), ("2025-08-20T00:03:00+0200",), ("bad",),
                                ("2025-08-20T00:03:00Z",), (None,)], "s string")
    got = [r.u for r in df.select(S.parse_iso_utc("s").alias("u")).collect()]
    assert got == [dt.datetime(2025, 8, 19, 22, 0, 0, 123000), dt.datetime(2025, 8, 19, 22, 3), None,
                   dt.datetime(2025, 8, 20, 0, 3), None]


def test_parse_iso_utc_is_session_zone_free(spark):
    df = spark.createDataFrame([("2025-08-20T00:03:00+0200",), ("2025-08-20 01:02:03",)], "s string")
    before = [r.u for r in df.select(S.parse_iso_utc("s").alias("u")).collect()]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        after = [r.u for r in df.select(S.parse_iso_utc("s").alias("u")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after == [dt.datetime(2025, 8, 19, 22, 3), dt.datetime(2025, 8, 20, 1, 2, 3)]


def test_hour_24_is_next_midnight(spark):
    df = spark.createDataFrame([(20250820, 24), (20250820, 1)], "d int, h int")
    got = [r.t for r in df.select(S.hour24_fix("d", "h").alias("t")).collect()]
    assert got == [dt.datetime(2025, 8, 21, 0, 0), dt.datetime(2025, 8, 20, 1, 0)]


def test_localize_gap_and_ambiguous(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 30, 2, 30),), (dt.datetime(2025, 10, 26, 2, 30),),
                                (dt.datetime(2025, 8, 20, 12, 0),)], "l timestamp_ntz")
    utc, amb = S.localize("l")
    rows = df.select(utc.alias("u"), amb.alias("a")).collect()
    assert rows[0].u == dt.datetime(2025, 3, 30, 1, 0) and not rows[0].a
    assert rows[1].a
    assert rows[2].u == dt.datetime(2025, 8, 20, 10, 0) and not rows[2].a


def test_decimal_comma(spark):
    df = spark.createDataFrame([("6,7",), ("4",), (" 3,1 ",), (None,)], "s string")
    assert [r.d for r in df.select(S.decimal_comma("s").alias("d")).collect()] == [6.7, 4.0, 3.1, None]


def test_split_lat_lon(spark):
    df = spark.createDataFrame([("52.37, 4.89",), ("x",)], "s string")
    lat, lon = S.split_lat_lon("s")
    rows = df.select(lat.alias("lat"), lon.alias("lon")).collect()
    assert (rows[0].lat, rows[0].lon) == (52.37, 4.89)
    assert (rows[1].lat, rows[1].lon) == (None, None)


def test_text_cleaning_and_numbers(spark):
    df = spark.createDataFrame([("  72 °F ",), ("W 12 mph",), ("-3.5",), ("none",), (".5 in",)], "s string")
    rows = df.select(S.clean_text("s").alias("c"), S.extract_number("s").alias("n")).collect()
    assert [r.c for r in rows] == ["72 F", "W 12 mph", "-3.5", "none", ".5 in"]
    assert [r.n for r in rows] == [72.0, 12.0, -3.5, None, 0.5]


def test_parse_date_ampm(spark):
    df = spark.createDataFrame([("20/08/25", "1:30 PM"), ("20/08/25", "12:05 AM"), ("x", "y")], "d string, t string")
    got = [r.t for r in df.select(S.parse_date_ampm("d", "t").alias("t")).collect()]
    assert got == [dt.datetime(2025, 8, 20, 13, 30), dt.datetime(2025, 8, 20, 0, 5), None]


def test_calendar_features_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 8, 18, 6, 0),), (dt.datetime(2025, 8, 24, 18, 0),)],
                               "t timestamp_ntz")
    cal = S.calendar_features("t")
    rows = df.select(cal["weekday"].alias("w"), cal["is_weekend"].alias("e"), cal["time_sin"].alias("s")).collect()
    assert [(r.w, r.e) for r in rows] == [(0, 0), (6, 1)]
    assert abs(rows[0].s - 1.0) < 1e-12


def test_crowd_flow_truncates_count(spark):
    df = spark.createDataFrame([(20.9, 6.7), (-2.5, 1.0)], "c double, w double")
    got = [r.f for r in df.select(S.crowd_flow("c", "w").alias("f")).collect()]
    assert abs(got[0] - 20 / 6.7 / 3) < 1e-12 and round(got[0], 5) == 0.99502
    assert got[1] == -2 / 3.0


def test_id_text(spark):
    df = spark.createDataFrame([("12.0",), ("abc",), ("7",), (None,)], "s string")
    assert [r.i for r in df.select(S.id_text("s").alias("i")).collect()] == ["12", "abc", "7", None]


def test_fixed_text_matches_python_rounding(spark):
    random.seed(7)
    vals = [0.125, 0.15, 2.675, 4.800655, -0.0001] + [round(random.uniform(0, 9), 6) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select("x", S.fixed_text(F.col("x"), 5).alias("f5"), S.fixed_text(F.col("x"), 2).alias("f2")).collect()
    for r in rows:
        assert r.f5 == f"{r.x:.5f}" and r.f2 == f"{r.x:.2f}"


def test_vessel_label(spark):
    df = spark.createDataFrame([("v1", dt.datetime(2025, 8, 20, 14, 3, 5), 4.8123456, 52.3, 125.0),
                                ("v2", dt.datetime(2025, 8, 20, 14, 3, 5), 4.8, 52.3, None)],
                               "id string, t timestamp_ntz, lon double, lat double, sp double")
    rows = df.select(S.vessel_label("id", "t", "lon", "lat", "sp").alias("l")).collect()
    assert rows[0].l == "ID: v1<br/>Time: 2025-08-20 14:03:05<br/>Lon: 4.81235<br/>Lat: 52.30000<br/>Speed: 1.25 m/s"
    assert rows[1].l.endswith("Speed: n/a")


def test_rd_origin_maps_to_reference_point(spark):
    df = spark.createDataFrame([(155000.0, 463000.0), (121000.0, 487000.0)], "x double, y double")
    lon, lat = S.rd_to_lonlat("x", "y")
    rows = df.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert abs(rows[0].lon - 5.38720621) < 1e-12 and abs(rows[0].lat - 52.15517440) < 1e-12
    # central Amsterdam lies near (4.9, 52.37)
    assert abs(rows[1].lon - 4.90) < 0.02 and abs(rows[1].lat - 52.37) < 0.02


def test_frame_floor_and_local_time(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 8, 20, 12, 4, 59),)], "t timestamp_ntz")
    r = df.select(S.frame_floor("t").alias("f"), S.to_local_time("t").alias("l")).first()
    assert r.f == dt.datetime(2025, 8, 20, 12, 3) and r.l == dt.datetime(2025, 8, 20, 14, 4, 59)


def test_tenths_and_imperial(spark):
    df = spark.createDataFrame([(20250820, 1, 215, 150, 10130, 40, 90, -1, -1, 80)],
                               "YYYYMMDD int, HH int, T int, TD int, P int, FF int, FX int, RH int, SQ int, U int")
    r = df.select(*S.tenths_to_units()).first()
    assert (r.temperature, r.air_pressure, r.rainfall, r.relative_humidity) == (21.5, 1013.0, -0.1, 80)
    r2 = df.select(*S.tenths_to_units(fix=True)).first()
    assert r2.rainfall == 0.0 and r2.sunshine_duration == 0.0
    w = spark.createDataFrame([(212.0, 32.0, 10.0, 10.0, 1.0, 1.0)],
                              "temperature double, dew_point double, wind_speed double, wind_gust double, "
                              "pressure double, precipitation double")
    conv = S.imperial_to_metric()
    m = w.select(*[conv[k].alias(k) for k in conv]).first()
    assert (m.temperature, m.dew_point) == (100.0, 0.0)
    assert abs(m.wind_speed - 4.4704) < 1e-12 and abs(m.pressure - 33.8639) < 1e-12 and m.precipitation == 25.4


def test_ids_are_exact(spark):
    rows = [("9007199254740993",), ("12.0",), ("0012",), ("1e3",), ("abc",), ("1.0E7",), ("nan",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(S.id_text("s"), S.whole_number(F.col("s"))).collect()]
    assert got == [("9007199254740993", 9007199254740993), ("12", 12), ("0012", 12), ("1e3", 1000), ("abc", None),
                   ("10000000", 10000000), ("nan", None), (None, None)]


def test_bad_clock_text_is_null(spark):
    df = spark.createDataFrame([("20250820", "24"), ("2025082", "x"), ("bad", "1"), (None, "3")], "d string, h string")
    got = [r.t for r in df.select(S.hour24_fix("d", "h").alias("t")).collect()]
    assert got[0] == dt.datetime(2025, 8, 21) and got[1:] == [None, None, None]


def test_am_pm_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("10/03/24", "2:30 AM"), ("10/03/24", "12:05 PM"), ("31/02/24", "1:00 AM"), ("10/03/24", "13:00 PM")], "d string, t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.x for r in df.select(S.parse_date_ampm("d", "t").alias("x")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 12, 5), None, None]
