"""Recursive multi-step forecast for all locations at once (ops 114-115).

State per location is the last ``history`` counts as an ARRAY (bounded: 76
values for the reference's lag 75), gathered with a per-key top-N
(WindowGroupLimit) and ``collect_list`` — never a whole series. Each step
derives the lag / rolling features from the array with native array
functions, scores every location with one ``model.transform``, and appends the
prediction to both the counts and the state's prediction array. Calendar and
weather inputs stay frozen at the last observed row (the reference's
behaviour; ``fix=True`` advances the hour of day with each step).

The plan grows with each step, so the first state and that of every ``checkpoint_every`` steps
are written once under ``spark.checkpoint.dir`` and read back (reliable storage: the job
survives executor loss).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.ml.features import array_features
from crowdlake.operators.windows import DEFAULT_LAGS, DEFAULT_ROLLING
from crowdlake.session import scratch_path


def _written(state: DataFrame) -> DataFrame:
    """The state read back from storage: one job that scores each row once (an eager checkpoint runs its last stage twice)."""
    path = scratch_path(state.sparkSession, "forecast_state")
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def initial_state(history: DataFrame, key: str, ts: str, value: str, frozen: list[str],
                  lags: list[int], windows: list[int]) -> DataFrame:
    """(key, last_ts, counts ARRAY oldest->newest, frozen columns of the newest row)."""
    need = max(lags + windows) + 1
    # a total order (time, then value) so a recomputed task keeps the same rows
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(value).desc())
    tail = history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= need)
    items = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v"),
                                                 *[F.col(c).alias(c) for c in frozen])))
    st = tail.groupBy(key).agg(items.alias("_items"))
    last = F.try_element_at("_items", F.lit(-1))
    return st.select(key, last["t"].alias("last_ts"),
                     F.transform("_items", lambda x: x["v"]).alias("counts"),
                     *[last[c].alias(c) for c in frozen])


def recursive_forecast(model: PipelineModel, history: DataFrame, key: str, ts: str, value: str,
                       frozen: list[str], steps: int = 20, interval_minutes: int = 3,
                       lags: list[int] | None = None, windows: list[int] | None = None,
                       checkpoint_every: int = 5, fix: bool = False) -> DataFrame:
    """(key, step, ts, prediction) for ``steps`` future intervals of every location.

    Reference semantics: the features of the *latest* row (rolling means
    including that row) produce the value labelled ``last_ts + k*interval``,
    and each prediction is appended as the next count. Locations whose
    recent history is too short, or holds a NULL count, get NULL predictions.

    Each step is one ``model.transform`` and a projection over the state (no
    join, no shuffle); predictions accumulate in an array column of the state
    and are exploded once at the end.
    """
    lags = DEFAULT_LAGS if lags is None else list(lags)
    windows = DEFAULT_ROLLING if windows is None else list(windows)
    need = max(lags + windows) + 1
    state = _written(initial_state(history, key, ts, value, frozen, lags, windows))
    complete = (F.size("counts") >= F.lit(need)) & F.forall("counts", lambda x: x.isNotNull() & ~F.isnan(x))
    short = state.where(~complete)
    state = state.where(complete).withColumn("preds", F.array().cast("array<double>"))
    keep = [key, "last_ts", "counts", "preds"] + list(frozen)
    for step in range(1, steps + 1):
        feats = array_features(state, "counts", lags, windows)
        if fix and "hour" in frozen:
            feats = feats.withColumn("hour", F.hour(F.timestamp_add(
                "MINUTE", F.lit(interval_minutes * (step - 1)), F.col("last_ts"))))
        scored = model.transform(feats.drop(*[c for c in ("features", "prediction") if c in feats.columns]))
        appended = F.concat(F.col("counts"), F.array(F.col("prediction")))
        state = scored.select(
            *[F.col(c) for c in keep if c not in ("counts", "preds")],
            F.slice(appended, F.size(appended) - F.lit(need - 1), need).alias("counts"),
            F.concat(F.col("preds"), F.array(F.col("prediction"))).alias("preds"))
        if checkpoint_every and step % checkpoint_every == 0 and step < steps:
            state = _written(state)
    out = state.select(key, "last_ts", F.posexplode("preds").alias("_i", "prediction"))
    out = out.select(key, (F.col("_i") + 1).alias("step"),
                     F.timestamp_add("MINUTE", (F.col("_i") + 1) * F.lit(interval_minutes), F.col("last_ts")).alias(ts),
                     "prediction")
    missing = short.select(key, "last_ts", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    missing = missing.select(key, "step",
                             F.timestamp_add("MINUTE", F.col("step") * F.lit(interval_minutes),
                                             F.col("last_ts")).alias(ts),
                             F.lit(None).cast("double").alias("prediction"))
    return out.unionByName(missing)


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, key: str, ts: str, value: str,
                       interval_minutes: int = 3) -> DataFrame:
    """Forecast beside the mean actual of the interval its time falls in; error columns added (left join)."""
    from crowdlake.functions.scalars import frame_floor

    act = actual.groupBy(key, frame_floor(ts, interval_minutes).alias("_frame")).agg(F.avg(value).alias("actual"))
    j = forecast.withColumn("_frame", frame_floor(ts, interval_minutes)).join(act, [key, "_frame"], "left").drop("_frame")
    return j.withColumn("error", F.col("prediction") - F.col("actual")).withColumn("abs_error", F.abs("error"))
