"""Hourly training rows over all sensors, stored scalers and formula models, forecasts beside actuals."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdlake.ml import forecast as FC
from crowdlake.ml import models as MD
from crowdlake.ml import splits as SP
from crowdlake.operators import windows as W

T0 = dt.datetime(2025, 8, 22, 20)


def hourly_rows(readings, weather, cols, past, horizon, step):
    """The training rows of a pandas frame, hour by hour."""
    df = pd.DataFrame(readings, columns=["sensor", "ts", "v"]).dropna(subset=["sensor", "ts"])
    df["ts"] = df["ts"].dt.floor("h")
    wide = df.pivot_table(index="ts", columns="sensor", values="v", aggfunc="mean", dropna=False).asfreq("1h")
    wx = pd.DataFrame(weather, columns=["hour", *cols]).set_index("hour").groupby(level=0).mean().reindex(wide.index).fillna(0)
    out = []
    for end in range(past - 1, len(wide) - horizon, step):
        window = wide.iloc[end - past + 1: end + 1].fillna(0)
        at = wide.index[end]
        clock = [at.hour, at.dayofweek, int(at.dayofweek >= 5), np.sin(2 * np.pi * at.hour / 24), np.cos(2 * np.pi * at.hour / 24)]
        f = np.concatenate([window.values.flatten(), window.mean().values, window.std().fillna(0).values, wx.iloc[end].values, clock])
        out.append((at, f, wide.iloc[end + horizon].values, wide.index[end + horizon]))
    return out


@pytest.mark.parametrize("past,horizon,step", [(3, 1, 1), (1, 2, 1), (4, 1, 3)])
def test_hourly_rows_equal_pandas(spark, past, horizon, step):
    rnd = random.Random(past)
    readings = [(s, T0 + dt.timedelta(minutes=rnd.randrange(0, 40 * 60)), round(rnd.random() * 50, 2)) for s in ("b", "a", "c_9") for _ in range(50)]
    readings = [r for r in readings if r[1].hour != 3] + [("a", T0 + dt.timedelta(hours=41), None), ("z", T0, 4.0), (None, T0, 1.0)]  # an hour without readings
    cols = ["temperature", "rain"]
    weather = [(T0 + dt.timedelta(hours=h), float(h), None if h % 4 else 0.5) for h in range(-2, 30)] + [(T0, 9.0, 1.0)]
    df = spark.createDataFrame(readings, "sensor string, ts timestamp_ntz, v double").repartition(3)
    wx = spark.createDataFrame(weather, "hour timestamp_ntz, temperature double, rain double")
    got = W.hourly_window_vectors(df, "sensor", "ts", "v", wx, "hour", cols, past, horizon, step).orderBy("window_end").collect()
    want = hourly_rows(readings, weather, cols, past, horizon, step)
    assert [r.window_end for r in got] == [w[0].to_pydatetime() for w in want] and len(got) > 8
    for r, (_, f, target, at) in zip(got, want):
        assert np.allclose(r.features, f.astype(float)) and r.target_ts == at.to_pydatetime() and r.n_sensors == 4
        assert np.allclose(np.array(r.target, float), target.astype(float), equal_nan=True)
    plain = W.hourly_window_vectors(df, "sensor", "ts", "v", past_hours=past, horizon=horizon, step_hours=step).first()
    assert len(plain.features) == 4 * (past + 2) + 5


def test_hourly_rows_of_short_and_empty_tables(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=1), 2.0)], "sensor string, ts timestamp_ntz, v double")
    assert W.hourly_window_vectors(df, "sensor", "ts", "v", past_hours=3).count() == 0
    assert W.hourly_window_vectors(df.limit(0), "sensor", "ts", "v").count() == 0


def test_hourly_rows_are_dealt_out_one_by_one_from_filled_cells(spark, monkeypatch):
    """Rows as wide as a task may hold get a task each, empty cells are not stored or sent, and batches may end anywhere."""
    monkeypatch.setattr(W, "ROW_BYTES", 1, raising=False)
    readings = [(s, T0 + dt.timedelta(hours=h, minutes=m), float(s * h + m)) for s in range(40) for h in range(s % 3, 30, 7) for m in (0, 9)]
    readings += [(99, T0 + dt.timedelta(hours=2), None), (3, T0 + dt.timedelta(hours=28), float("nan"))]  # a sensor without values; not a number is no NULL
    df = spark.createDataFrame(readings, "sensor int, ts timestamp_ntz, v double").repartition(3)
    cells = {}
    for s, t, v in readings:
        cells.setdefault((s, t.replace(minute=0)), []).append(v)
    assert W.hourly_cells(df, "sensor", "ts", "v").count() == len(cells)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = W.hourly_window_vectors(df, "sensor", "ts", "v", past_hours=2, horizon=3, step_hours=2)
        got = out.select("*", F.spark_partition_id().alias("task")).orderBy("window_end").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    sensors = sorted({s for s, _ in cells})
    assert [r.window_end for r in got] == [T0 + dt.timedelta(hours=h) for h in range(1, 27, 2)] and len({r.task for r in got}) == len(got)
    mean = {k: None if None in x else sum(x) / len(x) for k, x in cells.items()}
    for r in got:
        past = [[mean.get((s, r.window_end - dt.timedelta(hours=k))) or 0.0 for s in sensors] for k in (1, 0)]
        want = [mean.get((s, r.target_ts)) for s in sensors]
        assert r.target_ts == r.window_end + dt.timedelta(hours=3) and r.n_sensors == len(r.target) == 41
        assert np.allclose(r.features[:164], np.concatenate([*past, np.mean(past, axis=0), np.std(past, axis=0, ddof=1)]))
        assert [x is None for x in r.target] == [x is None for x in want]
        assert np.allclose([x for x in r.target if x is not None], [x for x in want if x is not None], equal_nan=True)
    assert np.isnan(got[-1].target[3])


def test_scaler_is_stored_and_applied_in_another_session(spark, tmp_dir):
    rows = [(i, float(i * i), 3.0, None if i == 4 else 0.1 * i, "keep") for i in range(10)]
    schema = "id int, x double, constant double, `odd.name` double, note string"
    df = spark.createDataFrame(rows, schema)
    cols = ["x", "constant", "odd.name"]
    path = MD.save_model(SP.fit_standard_scaler(df.where("id < 6"), cols), os.path.join(tmp_dir, "scaler"))
    other = spark.newSession()
    again = other.createDataFrame(rows, schema)
    out = SP.apply_standard_scaler(again, MD.load_model(path))
    assert out.columns == df.columns
    pdf, train = pd.DataFrame(rows, columns=df.columns), pd.DataFrame(rows[:6], columns=df.columns)
    for c in cols:
        std = train[c].std(ddof=0)
        want = (pdf[c] - train[c].mean()) / (std if std else 1.0)
        got = [r[c] for r in out.orderBy("id").collect()]
        assert np.allclose(np.array(got, float), want, equal_nan=True), c
    sample = SP.standard_scale(df, df, ["x"], sample_std=True).orderBy("id").first().x
    assert sample == pytest.approx((0 - pdf.x.mean()) / pdf.x.std())
    empty = SP.standard_scale(df, df.limit(0), ["x"]).first().x
    assert empty is None


def test_scaler_in_front_of_trees_is_one_stored_model(spark, tmp_dir):
    rows = [(float(i % 13), float(i % 7) * 100, float(i % 13) * 2 + (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, count double").repartition(3)
    scaler = SP.fit_standard_scaler(df, ["a", "b"])
    trees = MD.train_global_model(SP.apply_standard_scaler(df, scaler), ["a", "b"], n_trees=5, max_depth=3)
    path = MD.save_model(MD.with_scaler(scaler, trees), os.path.join(tmp_dir, "model"))
    loaded = MD.load_model(path)
    one = sorted(r.prediction for r in loaded.transform(df).collect())
    two = sorted(r.prediction for r in trees.transform(SP.apply_standard_scaler(df, scaler)).collect())
    assert one == two and max(one) > min(one)


def test_formula_model_forecasts_step_by_step(spark, tmp_dir):
    model = MD.load_model(MD.save_model(MD.formula_model("0.5D * `count` + 0.25D * lag_2 + 0.25D * roll_mean_3 + hour"), os.path.join(tmp_dir, "m")))
    counts = {1: [3.0, 8.0, 1.0, 6.0], 2: [1.0, 1.0, 2.0, 5.0], 3: [1.0, 2.0], 4: [1.0, None, 2.0, 3.0]}
    rows = [(s, T0 + dt.timedelta(minutes=3 * i, seconds=20), v, 7) for s, vs in counts.items() for i, v in enumerate(vs)]
    hist = spark.createDataFrame(rows, "sensor int, ts timestamp_ntz, count double, hour int")
    fc = FC.recursive_forecast(model, hist, "sensor", "ts", "count", ["hour"], steps=6, lags=[1, 2], windows=[3], checkpoint_every=1)
    got = {(r.sensor, r.step): r.prediction for r in fc.collect()}
    assert len(got) == 24 and all(got[(s, k)] is None for s in (3, 4) for k in range(1, 7))
    for s in (1, 2):
        v = list(counts[s])
        for k in range(1, 7):
            v.append(0.5 * v[-1] + 0.25 * v[-3] + 0.25 * sum(v[-3:]) / 3 + 7)
            assert got[(s, k)] == pytest.approx(v[-1])
    actual = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=12), 5.0), (1, T0 + dt.timedelta(minutes=14, seconds=59), 7.0), (2, T0, 1.0)],
                                   "sensor int, ts timestamp_ntz, count double")
    versus = {(r.sensor, r.step): r.actual for r in FC.forecast_vs_actual(fc, actual, "sensor", "ts", "count", 3).collect()}
    assert len(versus) == 24 and versus[(1, 1)] == 6.0 and versus[(1, 2)] is None and versus[(2, 1)] is None


def test_fitting_and_scoring_read_one_stored_table(spark, monkeypatch):
    """A query that has to fit the model computes its table once: it is stored, and the scored rows come from the file."""
    from crowdlake.plans import ml_queries as MQ

    at = dt.datetime(2024, 1, 29, 22)
    rows = [(1, at + dt.timedelta(hours=h), h, float(h)) for h in range(5)]
    table = spark.createDataFrame(rows, "sensor bigint, ts timestamp_ntz, event_id bigint, count double")
    table = table.withColumns({c: F.lit(1.0) for c in MQ.FEATURES if c != "lag_1"}).withColumn("lag_1", F.col("count") - 1)
    seen = []

    def fit(train, features, label):
        seen.append((train.count(), train.inputFiles()))
        return MD.formula_model("lag_1")

    monkeypatch.setattr(MQ, "model_table", lambda *_: table)
    monkeypatch.setattr(MQ, "_SAVED", {})
    monkeypatch.setattr(MD, "train_global_model", fit)
    for query, n in ((MQ.q_train_global_model, 3), (MQ.q_predict, 5), (MQ.q_save_load_model, 3)):
        MQ._SAVED.clear()
        out = query(spark, "/made/up")
        assert out.inputFiles() and set(seen[-1][1]) == set(out.inputFiles())
        assert sorted(r["prediction"] for r in out.collect()) == [float(h - 1) for h in range(5 - n, 5)]
    assert [n for n, _ in seen] == [2, 2, 2]
    assert MQ.q_predict(spark, "/made/up").count() == 5 and len(seen) == 3


@pytest.mark.parametrize("query", ["recursive_forecast", "prediction_series"])
def test_forecast_queries_make_their_inputs_once(spark, monkeypatch, query):
    """History, fit, forecast and shown rows come from one stored table: every input row is made once."""
    from crowdlake.plans import ml_queries as ML

    end = ML.FORECAST_NOW - dt.timedelta(minutes=3)
    rows = [(s, i, end - dt.timedelta(minutes=3 * i), float(i % 7 + s)) for s, n in ((1, 80), (2, 76), (3, 5)) for i in range(n)]
    plain = spark.createDataFrame(rows, "sensor long, event_id long, ts timestamp_ntz, `count` double")
    plain = plain.withColumns({c: F.lit(1) for c in ["location_id", *ML.CALENDAR]} | {c: F.lit(2.0) for c in ML.WEATHER})
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(ML, "inputs_table", lambda spark, d: plain.mapInArrow(counted, plain.schema))
    out = ML.QUERIES[query](spark, "").collect()
    assert made.value == len(rows)
    told = [r for r in out if (r.prediction if query == "recursive_forecast" else r.value) is not None]
    assert len(out) == (60 if query == "recursive_forecast" else len(rows) + 60) and len(told) == len(out) - 20
