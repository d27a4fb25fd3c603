"""Landed tables: published whole or not at all, kept by day, read in one pass."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from crowdlake.operators import filters as FL
from crowdlake.operators import setops as SO
from crowdlake.plans import jobs
from crowdlake.sources import readers as RD
from crowdlake.sources import sinks as SK

T0 = dt.datetime(2025, 8, 20)
SF = "/root/testdata/sf0.001"


def broken(*args, **kwargs):
    raise OSError("disk full")


def feed(spark, tmp_dir, name, level):
    raw = spark.createDataFrame([("2025-08-20T10:00:00Z", f"id,traffic_level\n1,{level}\n2,{level}"), ("2025-08-21T10:00:00Z", f"3;{level}")], "time string, data string")
    return SK.write_csv(raw, os.path.join(tmp_dir, name))


def folders(tmp_dir):
    return sorted(x for x in os.listdir(tmp_dir) if not x.startswith("raw"))


def test_landing_without_parquet_keeps_the_csv_and_no_half_table(spark, tmp_dir, monkeypatch):
    pq, cz = os.path.join(tmp_dir, "p"), os.path.join(tmp_dir, "c")
    whole = SK.write_parquet

    def half(df, path, *args, **kwargs):
        whole(df, path, *args, **kwargs)
        raise OSError("disk full")

    monkeypatch.setattr(SK, "write_parquet", half)
    assert jobs.land_carflow(spark, feed(spark, tmp_dir, "raw", 0.5), pq, cz) == {"csv": cz}
    assert folders(tmp_dir) == ["c"] and RD.read_carflow_flat(spark, cz).count() == 2 + 1 - 0
    with pytest.raises(OSError):
        jobs.land_carflow(spark, feed(spark, tmp_dir, "raw2", 0.5), pq, cz, mode="parquet")
    assert folders(tmp_dir) == ["c"]


def test_landing_without_csv_leaves_both_old_tables(spark, tmp_dir, monkeypatch):
    pq, cz = os.path.join(tmp_dir, "p"), os.path.join(tmp_dir, "c")
    assert set(jobs.land_carflow(spark, feed(spark, tmp_dir, "raw", 0.5), pq, cz)) == {"parquet", "csv"}
    monkeypatch.setattr(SK, "write_csv_gz", broken)
    with pytest.raises(OSError):
        jobs.land_carflow(spark, feed(spark, tmp_dir, "raw2", 0.75), pq, cz)
    assert folders(tmp_dir) == ["c", "p"]
    levels = {r.traffic_level for path in (pq,) for r in spark.read.parquet(path).collect()} | {r.traffic_level for r in RD.read_carflow_flat(spark, cz).collect()}
    assert levels == {0.5}
    monkeypatch.undo()
    jobs.land_carflow(spark, feed(spark, tmp_dir, "raw3", 0.75), pq, cz)
    assert folders(tmp_dir) == ["c", "p"] and {r.traffic_level for r in spark.read.parquet(pq).collect()} == {0.75}


def test_failed_swap_puts_the_old_table_back(spark, tmp_dir):
    old = SK.write_parquet(spark.range(3), os.path.join(tmp_dir, "t"))
    with pytest.raises(OSError):
        SK._swap(spark, os.path.join(tmp_dir, "missing"), old, "x")
    assert spark.read.parquet(old).count() == 3


def test_recent_window_reads_the_newest_days_only(spark, tmp_dir):
    """Files of older days are spoilt: a plan that opened one would fail."""
    rows = [(f"v{i % 4}", i, T0 + dt.timedelta(hours=i), float(i)) for i in range(24 * 9)]
    df = spark.createDataFrame(rows, "id_str string, event_id long, time_utc timestamp_ntz, lon double")
    path = jobs.land_positions(df, os.path.join(tmp_dir, "days"))
    days = sorted(x for x in os.listdir(path) if x.startswith("date="))
    assert len(days) == 9
    for day in days[:-2]:
        for f in os.listdir(os.path.join(path, day)):
            os.remove(os.path.join(path, day, f))
        with open(os.path.join(path, day, "part-0.parquet"), "w") as f:
            f.write("no parquet")
    got = jobs.recent_positions(spark, path, 90)
    assert sorted(r.event_id for r in got.collect()) == [214, 215]
    assert len(got.inputFiles()) == sum(f.endswith(".parquet") for day in days[-2:] for f in os.listdir(os.path.join(path, day)))
    with pytest.raises(FileNotFoundError):
        jobs.recent_positions(spark, os.path.join(tmp_dir, "none"), 90)
    table = spark.read.schema(df.withColumn("date", F.lit(None).cast("date")).schema).parquet(path)
    last = [r.time_utc for r in spark.read.parquet(os.path.join(path, days[-1])).collect()]
    assert last == sorted(last)
    with pytest.raises(Exception, match="(?i)parquet"):
        FL.recent_window(table, "time_utc", 90).collect()


def test_station_file_without_a_header_is_refused(spark, tmp_dir):
    path = os.path.join(tmp_dir, "late.txt")
    with open(path, "w") as f:
        f.write("# comment\n" * 600 + "# STN,YYYYMMDD, HH\n370,20250820, 1\n")
    with pytest.raises(ValueError, match="header"):
        RD.read_weather_hourly(spark, path)
    assert RD.read_weather_hourly(spark, path, head_lines=700).first().HH == 1


def test_typed_series_equals_stacked_parts(spark):
    rows = [("a", T0 + dt.timedelta(minutes=m), float(m)) for m in (-6, -3, 0, 3, 60, 61)] + [("a", None, 1.0), ("b", T0, None)]
    df = spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, v double")
    got = sorted(map(str, map(tuple, SO.typed_series(df, T0, "ts", "v", ["sensor"]).collect())))
    parts = {"historic": df.where(F.col("ts") < F.lit(T0)), "current": df.where(F.col("ts") == F.lit(T0)),
             "actual_future": df.where((F.col("ts") > F.lit(T0)) & (F.col("ts") <= F.lit(T0 + dt.timedelta(minutes=60))))}
    assert got == sorted(map(str, map(tuple, SO.concat_typed_series(parts, "ts", "v", ["sensor"]).collect()))) and len(got) == 6


# as-of: each side's times for the windows, the blocks and the spans, and each side's rows; only times are read but for the last
SCANS = {"concat_typed_series": 1, "concat_history_current": 1, "incomplete_rows": 1, "detect_join_key": 2, "asof_nearest": 8, "pack_carflow": 1,
         "flatten_carflow_quoted": 1}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_number_of_scans(spark, name):
    """Scans in the plan as it is made, before adaptive execution merges any; nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("FileScan parquet") == SCANS[name], plan
    assert "Broadcast" not in plan
