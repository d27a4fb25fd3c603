"""Entry-flow jobs composed from the operators, end to end on sf0.001 stand-ins."""

import datetime as dt
import os

from pyspark.sql import functions as F

from crowdlake.ml.models import load_model
from crowdlake.plans import jobs
from crowdlake.plans import standins as SI
from crowdlake.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def test_train_then_score_and_forecast(spark, tmp_dir):
    counts = SI.counts_for_weather(spark, SF)
    weather = SI.weather(spark, SF)
    path = os.path.join(tmp_dir, "model")
    model, feats, cols = jobs.train_crowd_model(counts, weather, path, dt.datetime(2024, 1, 20),
                                                weather_order="w_id", lags=[1, 2, 3], windows=[3],
                                                n_trees=5, max_depth=3)
    assert "temperature" in cols and "w_id" not in cols
    assert load_model(path).stages[-1].getNumTrees == 5
    cut = feats.agg(F.max("ts")).first()[0] - dt.timedelta(days=3)
    now = feats.where(F.col("ts") <= F.lit(cut.isoformat(" ")).cast("timestamp_ntz")).agg(F.max("ts")).first()[0]
    out = jobs.score_and_forecast(model, feats, now, frozen=["location_id", "hour", "minute", "day", "month", "weekday", "is_weekend", "temperature"],
                                  lags=[1, 2, 3], windows=[3], steps=4)
    kinds = {r.type: r["count"] for r in out.groupBy("type").count().collect()}
    assert {"historic", "current", "prediction_multistep"} <= set(kinds)
    assert set(kinds) <= {"historic", "current", "prediction_multistep", "actual_future"}
    n_sensors = feats.where(F.col("ts") <= now).select("sensor").distinct().count()
    assert kinds["prediction_multistep"] == 4 * n_sensors


def test_land_carflow(spark, tmp_dir):
    raw = SI.carflow_raw(spark, SF)
    raw_path = SK.write_csv(raw, os.path.join(tmp_dir, "raw"))
    out = jobs.land_carflow(spark, raw_path, os.path.join(tmp_dir, "pq"), os.path.join(tmp_dir, "csv"))
    a = spark.read.parquet(out["parquet"])
    assert "date" in a.columns and a.count() == SI.table(spark, SF, "events").count()
    assert spark.read.option("header", True).csv(out["csv"]).count() == a.count()


def test_land_carflow_modes(spark, tmp_dir):
    import pytest

    raw = spark.createDataFrame([("2025-08-20T10:00:00Z", "id,traffic_level\n1,0.5\n2,0.7")], "time string, data string")
    raw_path = SK.write_csv(raw, os.path.join(tmp_dir, "raw2"))
    out = jobs.land_carflow(spark, raw_path, os.path.join(tmp_dir, "p2"), os.path.join(tmp_dir, "c2"), mode="csv")
    assert set(out) == {"csv"} and spark.read.option("header", True).csv(out["csv"]).count() == 2
    with pytest.raises(ValueError):
        jobs.land_carflow(spark, raw_path, os.path.join(tmp_dir, "p3"), os.path.join(tmp_dir, "c3"), mode="zip")
