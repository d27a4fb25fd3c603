"""Key detection, map tables, reshaping, forecast state, crowd reader."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from crowdlake.ml import forecast as FC
from crowdlake.operators import aggregates as A
from crowdlake.operators import filters as FL
from crowdlake.operators import joins as J
from crowdlake.operators import maps as M
from crowdlake.operators import reshape as R
from crowdlake.sources import readers as RD

T0 = dt.datetime(2025, 8, 20, 12, 0)


def _roads(spark, rows):
    return spark.createDataFrame(rows, "feature_id bigint, properties map<string,string>")


def test_detect_join_key_prefers_overlap(spark):
    roads = _roads(spark, [(1, {"a": "10", "seg": "1"}), (2, {"a": "11", "seg": "2.0"}), (3, {"a": "1", "seg": "3"})])
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id_str string")
    r = J.detect_join_key(roads, ids).first()
    assert (r.key_field, r.overlap) == ("seg", 3)


def test_detect_join_key_falls_back_to_named_field(spark):
    roads = _roads(spark, [(1, {"zzz": "x", "ROAD_ID": "y", "WVKID": "z"})])
    ids = spark.createDataFrame([("999",)], "id_str string")
    assert J.detect_join_key(roads, ids).first().key_field == "WVKID"


def test_roads_with_traffic_inner(spark):
    roads = _roads(spark, [(1, {"WVK_ID": "7.0"}), (2, {"WVK_ID": "8"}), (3, {"other": "9"})])
    traffic = spark.createDataFrame([("7", 0.5), ("9", 0.9)], "id_str string, mean_level double")
    out = J.roads_with_traffic(roads, traffic, "WVK_ID").collect()
    assert [(r.feature_id, r.rid_str, r.mean_level) for r in out] == [(1, "7", 0.5)]
    feats = M.traffic_features(J.roads_with_traffic(roads, traffic, "WVK_ID")).first()
    assert feats.width == 3.0 and feats.band == "yellow" and '"traffic_level":0.5' in feats.feature_json


def test_heat_points_and_incomplete_rows(spark):
    loc = spark.createDataFrame([(1, "a", 52.3, 4.8, 5.0), (2, "b", None, 4.8, 7.0), (3, "c", 52.3, 4.9, 0.0)],
                                "sensor bigint, name string, lat double, lon double, count double")
    pts = M.heat_points(loc, "count").collect()
    assert [(r.sensor, r.point) for r in pts] == [(1, [52.3, 4.8, 5.0])]
    bad = FL.incomplete_rows(loc, ["lat", "lon", "name", "sensor"], ["sensor", "name"]).collect()
    assert [(r.sensor, r.name) for r in bad] == [(2, "b")]


def test_locations_with_reading_fill_and_inner(spark):
    loc = spark.createDataFrame([(1, "a"), (2, "b")], "sensor bigint, name string")
    latest = spark.createDataFrame([(1, 9.0)], "sensor bigint, count double")
    left = {r.sensor: r["count"] for r in J.locations_with_reading(loc, latest, "sensor", "count").collect()}
    inner = J.locations_with_reading(loc, latest, "sensor", "count", how="inner", fill=None).count()
    assert left == {1: 9.0, 2: 0.0} and inner == 1


def test_merge_suffixes(spark):
    a = spark.createDataFrame([(1, "x", 5)], "sensorId int, name string, v int")
    b = spark.createDataFrame([(1, "y", 6)], "sensorId int, name string, w int")
    out = J.merge_suffixes(a, b, "sensorId")
    assert sorted(out.columns) == ["name_loc", "name_sensor", "sensorId", "v", "w"]


def test_map_center_lines_fallback(spark):
    empty = spark.createDataFrame([(1, None)], "feature_id bigint, coordinates string")
    r = A.map_center_lines(empty).first()
    assert (r.center_lat, r.center_lon) == A.FALLBACK_CENTER
    lines = spark.createDataFrame([(2, "[[4.91, 52.36], [4.92, 52.37]]"), (1, "[[[4.8, 52.3], [4.81, 52.31]]]")],
                                  "feature_id bigint, coordinates string")
    r = A.map_center_lines(lines).first()
    assert (r.center_lat, r.center_lon) == (52.3, 4.8)


def test_resample_hourly_fills_gaps(spark):
    df = spark.createDataFrame([(T0, 1.0), (T0 + dt.timedelta(hours=3), 3.0)], "ts timestamp_ntz, v double")
    out = A.resample_hourly(df, "ts", ["v"]).orderBy("hour").collect()
    assert [r.v for r in out] == [1.0, None, None, 3.0]


def test_melt_and_pivot_roundtrip(spark):
    wide = spark.createDataFrame([(T0, 1.0, None), (T0 + dt.timedelta(hours=1), 3.0, 4.0)],
                                 "hour timestamp_ntz, a double, b double")
    long = R.melt_counts(wide, ["hour"], ["a", "b"], "sensor", "actual")
    assert long.count() == 4                       # NULL counts kept, as pandas melt does
    scored = long.withColumn("pred", F.col("actual") * 2)
    p = R.pivot_predictions(scored, "hour", "sensor", "actual", "pred", ["a", "b"])
    assert sorted(p.columns) == ["a_actual", "a_xgb_pred", "b_actual", "b_xgb_pred", "hour"]
    kv = {r.sensor: r.value for r in R.latest_row_to_kv(wide, "hour", ["a", "b"]).collect()}
    assert kv == {"a": 3.0, "b": 4.0}


def test_split_past_now_future(spark):
    df = spark.createDataFrame([(T0 - dt.timedelta(minutes=3),), (T0,), (T0 + dt.timedelta(minutes=60),),
                                (T0 + dt.timedelta(minutes=61),)], "ts timestamp_ntz")
    got = [r.type for r in FL.split_past_now_future(df, "ts", T0, 20, 3).orderBy("ts").collect()]
    assert got == ["historic", "current", "actual_future"]


def test_forecast_state_is_bounded_and_newest_last(spark):
    rows = [(1, T0 + dt.timedelta(minutes=3 * i), float(i), 12, 2, 0) for i in range(100)]
    hist = spark.createDataFrame(rows, "sensor int, ts timestamp_ntz, count double, hour int, weekday int, "
                                       "is_weekend int")
    st = FC.initial_state(hist, "sensor", "ts", "count", ["hour"], [1, 2, 75], [3, 60]).first()
    assert len(st.counts) == 76 and st.counts[-1] == 99.0 and st.counts[0] == 24.0
    assert st.last_ts == T0 + dt.timedelta(minutes=297)


def test_read_crowd_wide(spark, tmp_dir):
    p = os.path.join(tmp_dir, "crowd.csv")
    with open(p, "w") as f:
        f.write("timestamp,S-01_0,S-01_180,hour,minute,day,month,weekday,is_weekend\n"
                "2025-08-20T14:03:00+02:00,12,7,14,3,20,8,2,0\n"
                "2025-08-20T14:06:00+02:00,,9,14,6,20,8,2,0\n")
    rows = RD.read_crowd(spark, p).orderBy("timestamp").collect()
    assert rows[0].timestamp == dt.datetime(2025, 8, 20, 14, 3) and rows[0]["S-01_0"] == 12.0
    assert rows[1]["S-01_0"] is None and rows[1].minute == 6


@pytest.mark.parametrize("col,expected", [("view", 1), ("hour", 0)])
def test_missing_profile(spark, col, expected):
    wide = spark.createDataFrame([(T0, 1.0), (T0 + dt.timedelta(hours=1), float("nan"))], "hour timestamp_ntz, view double")
    got = {r.column_name: r.nulls for r in FL.missing_profile(wide).collect()}
    assert got[col] == expected


def test_scale_conf_bounds():
    from crowdlake.session import scale_conf

    big = scale_conf(100 << 40, 8000)
    small = scale_conf(10 << 20, 8)
    assert big["spark.sql.shuffle.partitions"] == "100000" and big["spark.sql.files.maxPartitionBytes"] == str(512 << 20)
    assert small["spark.sql.shuffle.partitions"] == "16"


def test_station_ut_to_local(spark):
    st = spark.createDataFrame([(20250820, 12, 215, 150, 10130, 40, 90, 0, 3, 80)],
                               "YYYYMMDD int, HH int, T int, TD int, P int, FF int, FX int, RH int, SQ int, U int")
    assert RD.clean_station(st).first().datetime == dt.datetime(2025, 8, 20, 12, 0)
    assert RD.clean_station(st, ut_to_local=True).first().datetime == dt.datetime(2025, 8, 20, 14, 0)


def test_location_index_follows_column_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "location string")
    by_cols = {r.location: r.location_id for r in R.location_index(df, "location", order=["c", "a", "b"]).collect()}
    by_name = {r.location: r.location_id for r in R.location_index(df, "location").collect()}
    assert by_cols == {"c": 0, "a": 1, "b": 2} and by_name == {"a": 0, "b": 1, "c": 2}


def test_create_features_from_wide(spark):
    from crowdlake.ml.features import create_features

    rows = [(T0 + dt.timedelta(minutes=3 * i), float(i), float(2 * i), 20.0 + i) for i in range(8)]
    wide = spark.createDataFrame(rows, "timestamp timestamp_ntz, s2 double, s1 double, temperature double")
    out = create_features(wide, "timestamp", ["s2", "s1"], ["temperature"], lags=[1, 2], windows=[3])
    got = {(r.location, r.timestamp): r for r in out.collect()}
    assert len(got) == 2 * 6                          # first two rows per location lack lag_2
    last = got[("s1", T0 + dt.timedelta(minutes=21))]
    assert (last.location_id, last.lag_1, last.lag_2, last.roll_mean_3, last.temperature) == (1, 12.0, 10.0, 12.0, 27.0)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_exact_quantiles_match_numpy_with_hot_value(spark, parts):
    import numpy as np

    rnd = np.random.default_rng(parts)
    vals = np.concatenate([np.full(500, 7.0), rnd.normal(10, 3, 1000).round(2)])   # a third is one value
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = A.exact_quantiles(df, "v", probs, ranked=parts)
    want = np.percentile(vals, [p * 100 for p in probs])
    assert [round(got[p], 9) for p in probs] == [round(w, 9) for w in want]
    one = A.exact_quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.5])
    assert one == {0.5: 3.0}


def test_describe_profile_exact_default(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    r = FL.describe_profile(df, ["v"]).first()
    assert (r["count"], r.mean, r["min"], r.p25, r.p50, r.p75, r["max"]) == (10, 5.5, 1.0, 3.25, 5.5, 7.75, 10.0)


def test_read_crowd_skips_unnamed_index(spark, tmp_dir):
    p = os.path.join(tmp_dir, "crowd_idx.csv")
    with open(p, "w") as f:
        f.write(",timestamp,S1_0,hour,minute,day,month,weekday,is_weekend\n"
                "0,2025-08-20T14:03:00+02:00,5,14,3,20,8,2,0\n")
    out = RD.read_crowd(spark, p)
    assert [c for c in out.columns if c not in ("timestamp", "hour", "minute", "day", "month", "weekday",
                                                 "is_weekend")] == ["S1_0"]


def test_incomplete_rows_by_layer(spark):
    loc = spark.createDataFrame([(1, "a", 52.3, 4.8, None), (2, "b", None, 4.8, 90), (3, "c", 52.3, 4.9, 0)],
                                "sensor bigint, name string, lat double, lon double, direction int")
    got = FL.incomplete_rows_by_layer(loc, {"circles": M.CIRCLE_REQUIRED, "arrows": M.ARROW_REQUIRED},
                                      ["sensor", "name"]).collect()
    assert [(r.sensor, r.name) for r in got] == [(1, "a"), (2, "b")]


def test_concat_columns_keeps_unmatched_hours(spark):
    from crowdlake.operators import setops as SO

    a = spark.createDataFrame([(T0, 1.0), (T0 + dt.timedelta(hours=1), 2.0)], "hour timestamp_ntz, s double")
    b = spark.createDataFrame([(T0 + dt.timedelta(hours=1), 9.0), (T0 + dt.timedelta(hours=2), 8.0)],
                              "hour timestamp_ntz, w double")
    got = sorted((r.hour, r.s, r.w) for r in SO.concat_columns(a, b, "hour").collect())
    assert got == [(T0, 1.0, None), (T0 + dt.timedelta(hours=1), 2.0, 9.0), (T0 + dt.timedelta(hours=2), None, 8.0)]
