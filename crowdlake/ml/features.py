"""Model features (op 80) and their array form for the forecast state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.functions.scalars import calendar_features
from crowdlake.operators.reshape import location_index, melt_with_features
from crowdlake.operators.windows import DEFAULT_LAGS, DEFAULT_ROLLING, lag_and_rolling


def create_features(wide: DataFrame, ts: str, sensors: list[str], feature_cols: list[str],
                    lags: list[int] | None = None, windows: list[int] | None = None,
                    dropna: bool = True, include_current: bool = True) -> DataFrame:
    """Wide counts -> long (location, count, features) with location id, lags and rolling means."""
    long = melt_with_features(wide, ts, sensors, feature_cols, "location", "count")
    long = location_index(long, "location", order=list(sensors))
    feats = lag_and_rolling(long, "location_id", [ts], "count", lags, windows, include_current=include_current)
    return feats.dropna() if dropna else feats


#: The model's calendar inputs.
CALENDAR = ["hour", "minute", "day", "month", "weekday", "is_weekend"]


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """The six calendar columns of the time column."""
    cal = calendar_features(ts)
    return df.withColumns({"hour": cal["hour"], "minute": F.minute(ts), "day": F.dayofmonth(ts), "month": F.month(ts),
                           "weekday": cal["weekday"], "is_weekend": cal["is_weekend"]})


def create_features_long(long: DataFrame, key: str, ts: str, value: str, order_tie: str | None = None,
                         lags: list[int] | None = None, windows: list[int] | None = None,
                         dropna: bool = True) -> DataFrame:
    """Same features from an already-long table, with calendar columns from ``ts``."""
    order = [ts] + ([order_tie] if order_tie else [])
    feats = lag_and_rolling(with_calendar(long, ts), key, order, value, lags, windows)
    return feats.dropna() if dropna else feats


def array_features(state: DataFrame, counts_col: str, lags: list[int] | None = None,
                   windows: list[int] | None = None) -> DataFrame:
    """Features of the newest element of an oldest->newest ARRAY of counts.

    ``count`` is the last element, ``lag_k`` the element k before it and
    ``roll_mean_w`` the mean of the last ``w`` elements (NULL when fewer).
    """
    lags = DEFAULT_LAGS if lags is None else list(lags)
    windows = DEFAULT_ROLLING if windows is None else list(windows)
    arr = F.col(counts_col)
    n = F.size(arr)
    cols = {"count": F.try_element_at(arr, F.lit(-1))}
    for k in lags:
        cols[f"lag_{k}"] = F.when(n > F.lit(k), F.try_element_at(arr, F.lit(-(k + 1))))
    for w in windows:
        tail = F.slice(arr, -w, w)
        total = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x)
        cols[f"roll_mean_{w}"] = F.when(n >= F.lit(w), total / F.lit(float(w)))
    return state.withColumns(cols)
