"""Registered ML queries (ops 104-115, 89).

The global model follows the reference's process boundary: ``train_global_model``
fits the boosted trees and saves the pipeline under the shared checkpoint
folder; scoring queries load the saved pipeline (and fit it first only when
none has been saved in this session).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os

from pyspark.sql import functions as F

from crowdlake.functions.scalars import ntz_lit
from crowdlake.ml import features as FT
from crowdlake.ml import forecast as FC
from crowdlake.ml import models as MD
from crowdlake.ml import splits as SP
from crowdlake.ml.features import CALENDAR, with_calendar
from crowdlake.operators import joins as J
from crowdlake.operators import reshape as R
from crowdlake.operators import topk as TK
from crowdlake.operators import windows as W
from crowdlake.plans import oracle as O
from crowdlake.plans import queries as Q
from crowdlake.plans import standins as SI
from crowdlake.session import ensure_checkpoint_dir, scratch_path

QUERIES: dict = {}
ORACLE: dict = {}

# Rows with a full 75-row history start late in the month: about half of them lie before this day.
CUTOFF = dt.datetime(2024, 1, 30)
# The forecast starts when some sensors have that history.
FORECAST_NOW = dt.datetime(2024, 1, 30, 12)
WEATHER = ["temperature", "dew_point", "air_pressure", "wind_speed", "max_gust", "rainfall", "sunshine_duration", "relative_humidity"]
#: Inputs that stay as they are over the forecast's steps.
FROZEN = ["location_id"] + CALENDAR + WEATHER
#: The reference model's 32 inputs.
FEATURES = FROZEN + [f"lag_{k}" for k in Q.LAGS] + [f"roll_mean_{n}" for n in Q.ROLLING]
SCALE_COLS = ["count", "lag_1", "lag_2", "roll_mean_3"]


def q(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# splits and scaling
# ---------------------------------------------------------------------------

@q("chronological_split")
def q_chronological_split(spark, d):
    f = Q.features_table(spark, d)
    return SP.chronological_split(f, "ts", CUTOFF).select("sensor", "ts", "event_id", "split")


ORACLE["chronological_split"] = O.W("featd") + """SELECT sensor, ts, event_id,
  CASE WHEN ts < TIMESTAMP '2024-01-30 00:00:00' THEN 'train' ELSE 'test' END AS split FROM featd"""


@q("ordered_fraction_split")
def q_ordered_fraction_split(spark, d):
    wide = SI.readings_wide(spark, d).select("hour")
    return SP.ordered_fraction_split(wide, "hour", 0.80, 0.15)


ORACLE["ordered_fraction_split"] = O.W("readings_wide") + """, p AS (
  SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS pos, count(*) OVER () AS n FROM readings_wide)
SELECT hour, CASE WHEN pos < floor(0.8 * n) THEN 'train' WHEN pos < floor(0.8 * n) + floor(0.15 * n) THEN 'calib'
  ELSE 'test' END AS split FROM p"""


@q("random_split")
def q_random_split(spark, d):
    rd = SI.readings(spark, d)
    return SP.random_split(rd, ["sensor", "event_id"], seed=42, train_pct=80).select("sensor", "event_id", "split")


ORACLE["random_split"] = O.W("readings") + """SELECT sensor, event_id,
  CASE WHEN CAST('0x' || substr(md5('42:' || CAST(sensor AS VARCHAR) || ':' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80
       THEN 'train' ELSE 'test' END AS split FROM readings"""


@q("rolling_folds")
def q_rolling_folds(spark, d):
    hours = SI.readings_wide(spark, d).select("hour")
    return SP.rolling_folds(hours, "hour", 200, 200, 10)


ORACLE["rolling_folds"] = O.W("readings_wide") + """, p AS (
  SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS pos FROM readings_wide),
n AS (SELECT count(*) AS n, (count(*) - 400) // 9 AS step FROM p),
k AS (SELECT range AS fold, range * (SELECT step FROM n) AS start FROM range(0, (SELECT (n - 400) // step + 1 FROM n))
      WHERE range * (SELECT step FROM n) < (SELECT n - 400 FROM n))
SELECT p.hour, CAST(k.fold AS INTEGER) AS fold, CASE WHEN p.pos < k.start + 200 THEN 'train' ELSE 'test' END AS role
FROM p JOIN k ON p.pos >= k.start AND p.pos < k.start + 400"""


@q("standard_scale")
def q_standard_scale(spark, d):
    f = Q.features_table(spark, d)
    train = f.where(F.col("ts") < ntz_lit(CUTOFF))
    path = MD.save_model(SP.fit_standard_scaler(train, SCALE_COLS), scratch_path(spark, "scaler"))
    out = SP.apply_standard_scaler(f, MD.load_model(path))
    return out.select("sensor", "event_id", *[r6(F.col(c)).alias(c) for c in SCALE_COLS])


ORACLE["standard_scale"] = O.W("featd") + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
    for c in ['"count"', "lag_1", "lag_2", "roll_mean_3"]).replace('m_"count"', "m_count").replace(
    's_"count"', "s_count") + " FROM featd WHERE ts < TIMESTAMP '2024-01-30 00:00:00')\nSELECT sensor, event_id, " + \
    ", ".join(f"round(({c} - m_{n}) / s_{n}, 6) AS {c}" for c, n in
              [('"count"', "count"), ("lag_1", "lag_1"), ("lag_2", "lag_2"), ("roll_mean_3", "roll_mean_3")]) + \
    " FROM featd, st"

# ---------------------------------------------------------------------------
# global model
# ---------------------------------------------------------------------------


@SI.per_session
def inputs_table(spark, d):
    """Readings with the nearest hour's weather, the location's number and the calendar."""
    wx = Q.station_clean(spark, d).groupBy(F.col("datetime").alias("ts")).agg(*[F.avg(c).alias(c) for c in WEATHER])
    merged = J.asof_nearest(SI.readings(spark, d), wx, "ts", "ts", 60, suffix_ts="weather_ts").drop("weather_ts")
    return with_calendar(R.location_index(merged, "sensor"), "ts")


def _stored_inputs(spark, d):
    """The readings with their inputs, written once: the fit, the forecast and the shown rows read them, none joins them again."""
    path = scratch_path(spark, "model_inputs")
    inputs_table(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def _complete_rows(inputs):
    feats = W.lag_and_rolling(inputs, "sensor", ["ts", "event_id"], "count", Q.LAGS, Q.ROLLING)
    return feats.dropna(subset=FEATURES)


@SI.per_session
def model_table(spark, d):
    """The 32 inputs and the count of every reading, complete rows only."""
    return _complete_rows(inputs_table(spark, d))


def _model_dir(spark, d) -> str:
    tag = hashlib.sha1(os.path.abspath(d).encode()).hexdigest()[:10]
    return os.path.join(ensure_checkpoint_dir(spark), "models", f"global-{tag}")


# Pipelines saved by this process (the checkpoint folder is private to the SparkContext).
_SAVED: dict = {}


def _model_and_rows(spark, d, fit: bool = False, inputs=None):
    """The model and its table, which is made of ``inputs`` where the caller has them stored.

    Where the model has to be fitted, the table is stored first: fitting and scoring read it, neither computes it again."""
    rows = model_table(spark, d) if inputs is None else _complete_rows(inputs)
    path = _model_dir(spark, d)
    if path in _SAVED and not fit:
        return MD.load_model(path), rows
    stored = scratch_path(spark, "model_rows")
    rows.select("sensor", "ts", "event_id", "count", *FEATURES).write.parquet(stored)
    rows = spark.read.parquet(stored)
    model = MD.train_global_model(rows.where(F.col("ts") < ntz_lit(CUTOFF)), FEATURES, "count")
    _SAVED[MD.save_model(model, path)] = True
    return model, rows


def _model(spark, d, inputs=None):
    return _model_and_rows(spark, d, inputs=inputs)[0]


def _held_out(rows):
    return rows.where(F.col("ts") >= ntz_lit(CUTOFF))


@q("train_global_model")
def q_train_global_model(spark, d):
    model, rows = _model_and_rows(spark, d, fit=True)
    return MD.predict(model, _held_out(rows), ["sensor", "ts", "count"])


@q("predict")
def q_predict(spark, d):
    model, rows = _model_and_rows(spark, d)
    return MD.predict(model, rows, ["sensor", "ts", "count"])


@q("feature_importance")
def q_feature_importance(spark, d):
    return MD.feature_importance(spark, _model(spark, d), FEATURES)


@q("top_importances")
def q_top_importances(spark, d):
    return TK.top_importances(MD.feature_importance(spark, _model(spark, d), FEATURES), 8)


@q("model_check")
def q_model_check(spark, d):
    """What the trees must hold: rows scored, the error of lag 1 on them, an error below it, 32 importances that sum to one."""
    model, table = _model_and_rows(spark, d)
    rows = MD.predict(model, _held_out(table), ["count", "lag_1"])
    sq = lambda c: F.sqrt(F.avg((F.col("count") - F.col(c)) ** 2))
    errors = rows.agg(F.count("prediction").alias("scored"), r6(sq("lag_1")).alias("lag_1_rmse"), (sq("prediction") <= sq("lag_1")).alias("better_than_lag_1"))
    imp = MD.feature_importance(spark, model, FEATURES)
    total = imp.agg(F.round(F.sum("importance"), 6)).scalar()
    return errors.withColumns({"importances": imp.agg(F.count("*")).scalar(), "importance_sum": total})


@q("save_load_model")
def q_save_load_model(spark, d):
    model, rows = _model_and_rows(spark, d)
    path = MD.save_model(model, scratch_path(spark, "model_copy"))
    return MD.predict(MD.load_model(path), _held_out(rows), ["sensor", "ts", "count"])


def _history(inputs):
    return inputs.where(F.col("ts") <= ntz_lit(FORECAST_NOW))


# A formula is plain expressions, which the optimizer would nest step into step: the state is cut after every step.
#: The baseline beside the boosted trees: weighted persistence with a little weather and clock.
BASELINE = ("0.4D * `count` + 0.2D * lag_1 + 0.1D * lag_75 + 0.2D * roll_mean_3 + 0.1D * roll_mean_60"
            " + 0.01D * temperature + 0.05D * hour")


def _baseline(spark):
    """The baseline as it comes back from storage."""
    return MD.load_model(MD.save_model(MD.formula_model(BASELINE), scratch_path(spark, "baseline")))


def _forecast(model, inputs, checkpoint_every=5):
    return FC.recursive_forecast(model, _history(inputs), "sensor", "ts", "count",
                                 FROZEN, steps=20, interval_minutes=3,
                                 lags=Q.LAGS, windows=Q.ROLLING, checkpoint_every=checkpoint_every)


def _versus(spark, d, model, inputs, checkpoint_every=5):
    actual = SI.readings(spark, d).where(F.col("ts") > ntz_lit(FORECAST_NOW))
    return FC.forecast_vs_actual(_forecast(model, inputs, checkpoint_every), actual, "sensor", "ts", "count", 3)


def _series(model, inputs, checkpoint_every=5):
    from crowdlake.plans import jobs

    return jobs.score_and_forecast(model, inputs, FORECAST_NOW, frozen=FROZEN,
                                   lags=Q.LAGS, windows=Q.ROLLING, steps=20, interval_minutes=3, checkpoint_every=checkpoint_every)


@q("recursive_forecast")
def q_recursive_forecast(spark, d):
    """20 steps of every sensor by the stored baseline formula, which SQL recomputes step by step."""
    return _forecast(_baseline(spark), _stored_inputs(spark, d), 1).withColumn("prediction", r6(F.col("prediction")))


_CONDITION = "abs(epoch_us(x.datetime) - epoch_us(r.ts)) <= 3600000000"
_FORECAST_SQL = O.W("readings", "station_clean").replace("WITH ", "WITH RECURSIVE ", 1) + f""", wx AS (
  SELECT datetime, avg(temperature) AS temperature FROM station_clean GROUP BY 1),
inputs AS (
  SELECT r.sensor, r.ts, r.event_id, r."count", hour(r.ts) AS hour, x.temperature
  FROM readings r LEFT JOIN wx x ON {_CONDITION}
  QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY abs(epoch_us(x.datetime) - epoch_us(r.ts)), x.datetime) = 1),
hist AS (
  SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts DESC, "count" DESC) AS rn FROM inputs
  WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'),
state AS (
  SELECT sensor, max(ts) AS last_ts, list("count" ORDER BY ts, "count") AS counts,
         max(hour) FILTER (rn = 1) AS hour, max(temperature) FILTER (rn = 1) AS temperature,
         count("count") = 76 AS whole
  FROM hist WHERE rn <= 76 GROUP BY sensor),
fc AS (
  SELECT sensor, last_ts, hour, temperature, counts, 0 AS step, CAST(NULL AS DOUBLE) AS prediction FROM state WHERE whole
  UNION ALL
  SELECT sensor, last_ts, hour, temperature, list_append(counts[2:], p), step + 1, p
  FROM (SELECT *, 0.4::DOUBLE * counts[76] + 0.2::DOUBLE * counts[75] + 0.1::DOUBLE * counts[1]
               + 0.2::DOUBLE * list_sum(counts[74:76]) / 3.0::DOUBLE + 0.1::DOUBLE * list_sum(counts[17:76]) / 60.0::DOUBLE
               + 0.01::DOUBLE * temperature + 0.05::DOUBLE * hour AS p
        FROM fc WHERE step < 20)),
forecast AS (
  SELECT sensor, step, last_ts + to_minutes(3 * step) AS ts, prediction FROM fc WHERE step > 0
  UNION ALL
  SELECT sensor, k, last_ts + to_minutes(3 * k), NULL FROM state, (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS k) WHERE NOT whole)"""

ORACLE["model_check"] = _FORECAST_SQL[:_FORECAST_SQL.index(",\nhist AS")] + ",\n" + O._feat_sql(Q.LAGS, Q.ROLLING, "mf") + """,
held AS (SELECT mf."count", mf.lag_1 FROM mf JOIN inputs i USING (event_id)
         WHERE mf.ts >= TIMESTAMP '2024-01-30 00:00:00' AND i.temperature IS NOT NULL AND """ + " AND ".join(
    f"mf.{c} IS NOT NULL" for c in O._FEAT_COLS) + """)
SELECT count(*) AS scored, round(sqrt(avg(("count" - lag_1) * ("count" - lag_1))), 6) AS lag_1_rmse, true AS better_than_lag_1,
       CAST(32 AS BIGINT) AS importances, 1.0::DOUBLE AS importance_sum FROM held"""

ORACLE["recursive_forecast"] = _FORECAST_SQL + "\nSELECT sensor, CAST(step AS INTEGER) AS step, ts, round(prediction, 6) AS prediction FROM forecast"


@q("forecast_vs_actual")
def q_forecast_vs_actual(spark, d):
    out = _versus(spark, d, _baseline(spark), _stored_inputs(spark, d), 1)
    return out.withColumns({c: r6(F.col(c)) for c in ("prediction", "actual", "error", "abs_error")})


ORACLE["forecast_vs_actual"] = _FORECAST_SQL + """, act AS (
  SELECT sensor, time_bucket(INTERVAL 3 MINUTE, ts) AS frame, avg("count") AS actual FROM readings
  WHERE ts > TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1, 2)
SELECT f.sensor, CAST(f.step AS INTEGER) AS step, f.ts, round(prediction, 6) AS prediction, round(actual, 6) AS actual,
       round(prediction - actual, 6) AS error, round(abs(prediction - actual), 6) AS abs_error
FROM forecast f LEFT JOIN act a ON f.sensor = a.sensor AND time_bucket(INTERVAL 3 MINUTE, f.ts) = a.frame"""


@q("prediction_series")
def q_prediction_series(spark, d):
    """The prediction page's table (op 91 with the forecast): historic, current,
    20-step forecast and actual future per sensor, via ``jobs.score_and_forecast``."""
    return _series(_baseline(spark), _stored_inputs(spark, d), 1).withColumn("value", r6(F.col("value")))


ORACLE["prediction_series"] = _FORECAST_SQL + """
SELECT sensor, ts, round("count", 6) AS value, CASE WHEN ts < TIMESTAMP '2024-01-30 12:00:00' THEN 'historic'
         WHEN ts = TIMESTAMP '2024-01-30 12:00:00' THEN 'current' ELSE 'actual_future' END AS type
FROM readings WHERE ts <= TIMESTAMP '2024-01-30 13:00:00'
UNION ALL SELECT sensor, ts, round(prediction, 6), 'prediction_multistep' FROM forecast"""


@q("recursive_forecast_boosted")
def q_recursive_forecast_boosted(spark, d):
    """The same forecast by the boosted trees."""
    inputs = _stored_inputs(spark, d)
    return _forecast(_model(spark, d, inputs), inputs)


@q("forecast_vs_actual_boosted")
def q_forecast_vs_actual_boosted(spark, d):
    inputs = _stored_inputs(spark, d)
    return _versus(spark, d, _model(spark, d, inputs), inputs)


@q("prediction_series_boosted")
def q_prediction_series_boosted(spark, d):
    inputs = _stored_inputs(spark, d)
    return _series(_model(spark, d, inputs), inputs)


# ---------------------------------------------------------------------------
# training inputs in wide form
# ---------------------------------------------------------------------------


@q("create_features_wide")
def q_create_features_wide(spark, d):
    """The wide table's own path: sensors by column order, weather and calendar per time, incomplete rows kept.

    Means of hourly means have up to nine digits before they end, so rounding to six would meet halves."""
    wx = Q.station_clean(spark, d).groupBy(F.col("datetime").alias("timestamp")).agg(*[F.avg(c).alias(c) for c in WEATHER])
    wide = with_calendar(SI.readings_wide(spark, d).withColumnRenamed("hour", "timestamp"), "timestamp").join(wx, "timestamp", "left")
    out = FT.create_features(wide, "timestamp", SI.WIDE_SENSORS, CALENDAR + WEATHER, Q.LAGS, Q.ROLLING, dropna=False)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c in ("count", *WEATHER) or c.startswith(("lag_", "roll_mean_"))})


ORACLE["create_features_wide"] = O.W("readings_wide", "station_clean") + """, wx AS (
  SELECT datetime AS "timestamp", """ + ", ".join(f"avg({c}) AS {c}" for c in WEATHER) + """ FROM station_clean GROUP BY 1),
long AS (
""" + "\n  UNION ALL ".join(f"""SELECT hour AS "timestamp", '{s}' AS location, CAST({i} AS INTEGER) AS location_id, {s} AS "count" FROM readings_wide"""
                            for i, s in enumerate(SI.WIDE_SENSORS)) + """)
SELECT l."timestamp", location, location_id, round("count", 9) AS "count",
  CAST(hour(l."timestamp") AS INTEGER) AS hour, CAST(minute(l."timestamp") AS INTEGER) AS minute, CAST(day(l."timestamp") AS INTEGER) AS day,
  CAST(month(l."timestamp") AS INTEGER) AS month, CAST(isodow(l."timestamp") - 1 AS INTEGER) AS weekday,
  CAST(CASE WHEN isodow(l."timestamp") >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  """ + ", ".join(f"round({c}, 9) AS {c}" for c in WEATHER) + ",\n  " +     ", ".join(f'round(lag("count", {k}) OVER w, 9) AS lag_{k}' for k in Q.LAGS) + ",\n  " +     ", ".join(f'CASE WHEN count("count") OVER w{n} = {n} THEN round(avg("count") OVER w{n}, 9) END AS roll_mean_{n}' for n in Q.ROLLING) + """
FROM long l LEFT JOIN wx ON wx."timestamp" = l."timestamp"
WINDOW w AS (PARTITION BY location_id ORDER BY l."timestamp"), """ + ", ".join(
    f'w{n} AS (PARTITION BY location_id ORDER BY l."timestamp" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in Q.ROLLING)


@q("hourly_window_vectors")
def q_hourly_window_vectors(spark, d):
    """One training row per hour over all sensors, with weather and clock."""
    out = W.hourly_window_vectors(SI.readings(spark, d), "sensor", "ts", "count", Q.station_clean(spark, d), "datetime", WEATHER,
                                  past_hours=3, horizon=1)
    return out.withColumns({c: F.transform(c, lambda x: F.round(x, 6)) for c in ("features", "target")})


ORACLE["hourly_window_vectors"] = O.W("readings", "station_clean") + """, means AS (
  SELECT date_trunc('hour', ts) AS hour, sensor, avg("count") AS v FROM readings GROUP BY 1, 2),
sensors AS (SELECT sensor, row_number() OVER (ORDER BY sensor) AS s FROM (SELECT DISTINCT sensor FROM readings)),
grid AS (
  SELECT h.hour, s.sensor, s.s FROM (SELECT unnest(generate_series((SELECT min(hour) FROM means), (SELECT max(hour) FROM means), INTERVAL 1 HOUR)) AS hour) h, sensors s),
cells AS (SELECT g.hour, g.s, m.v, coalesce(m.v, 0.0) AS v0 FROM grid g LEFT JOIN means m ON g.hour = m.hour AND g.sensor = m.sensor),
win AS (
  SELECT hour, s, lag(v0, 2) OVER w AS p1, lag(v0, 1) OVER w AS p2, v0 AS p3, avg(v0) OVER f AS mean, stddev_samp(v0) OVER f AS std,
         lead(v, 1) OVER w AS target, lead(hour, 1) OVER w AS target_ts
  FROM cells WINDOW w AS (PARTITION BY s ORDER BY hour), f AS (PARTITION BY s ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
vec AS (
  SELECT hour, target_ts, count(*) AS n, list(round(target, 6) ORDER BY s) AS target,
         list(round(p1, 6) ORDER BY s) || list(round(p2, 6) ORDER BY s) || list(round(p3, 6) ORDER BY s)
           || list(round(mean, 6) ORDER BY s) || list(round(std, 6) ORDER BY s) AS f
  FROM win WHERE p1 IS NOT NULL AND target_ts IS NOT NULL GROUP BY 1, 2),
wx AS (SELECT datetime, """ + ", ".join(f"avg({c}) AS {c}" for c in WEATHER) + """ FROM station_clean GROUP BY 1)
SELECT hour AS window_end, target_ts, CAST(n AS INTEGER) AS n_sensors, target,
       f || [""" + ", ".join(f"round(coalesce({c}, 0.0), 6)::DOUBLE" for c in WEATHER) + """]
         || [hour(hour)::DOUBLE, (isodow(hour) - 1)::DOUBLE, (CASE WHEN isodow(hour) >= 6 THEN 1 ELSE 0 END)::DOUBLE,
             round(sin(2.0 * pi() * hour(hour) / 24.0), 6), round(cos(2.0 * pi() * hour(hour) / 24.0), 6)] AS features
FROM vec LEFT JOIN wx ON wx.datetime = vec.hour"""


@q("predict_current")
def q_predict_current(spark, d):
    """The score of every sensor's newest complete row."""
    model, rows = _model_and_rows(spark, d)
    return MD.predict(model, W.latest_per_key(rows, "sensor", ["ts", "event_id"]), ["sensor", "ts", "count"])
