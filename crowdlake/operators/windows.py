"""Row-count windows per key: lags, rolling means, latest/tail per key (ops 78-84).

A plain ``Window.partitionBy(sensor)`` puts a whole sensor's history in one
task; if one sensor holds a third of all rows that task holds a third of the
data. ``lag_and_rolling`` therefore works on bounded buckets:

1. ``sequence_index`` numbers rows per key without a per-key partition: rows
   are numbered inside (key, time chunk) partitions, and a small per-chunk
   count table (prefix-summed per key) supplies each chunk's offset.
2. Rows are cut into buckets of ``bucket_rows`` consecutive positions; the
   last ``context`` rows of each bucket are copied into the next bucket as
   read-only context. With ``bucket_rows >= context`` every lag / rolling
   frame of a row lies inside its own bucket, so the result is exact.
3. One window over (key, bucket) computes all lags and rolling means;
   context copies are dropped afterwards.

Partition sizes are bounded by ``bucket_rows + context`` whatever the skew.
The numbering step holds one (key, chunk) per task: the default chunk is an
hour (20 rows for a 3-minute sensor); for feeds with more rows in an hour of one key than
a task should hold, pass a finer ``chunk`` (a minute).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.operators.reshape import location_index
from crowdlake.session import scratch_path

# The feature lists used by the reference's model.
DEFAULT_LAGS = [1, 2, 3, 5, 10, 20, 30, 40, 50, 60, 75]
DEFAULT_ROLLING = [3, 5, 10, 20, 40, 60]
#: A task of the hourly training rows makes about this many bytes of them (one row at least).
ROW_BYTES = 32 << 20


def sequence_index(df: DataFrame, key: str, order_cols: list[str], chunk=None,
                   out: str = "_pos") -> DataFrame:
    """0-based position of each row within its key, ordered by ``order_cols``.

    ``chunk`` is a coarse, order-preserving Column of the first order column
    (default: the hour of a timestamp) used to split a key's rows.
    """
    chunk_col = chunk if chunk is not None else F.date_trunc("hour", F.col(order_cols[0]))
    # Null-safe key columns, so that the window and the join deal rows out alike: a NULL key or time keeps
    # its place (NULLs sort first, as in a plain window).
    part = {"_k": F.coalesce(F.col(key).cast("string"), F.lit("")), "_kn": F.col(key).isNull(),
            "_c": F.coalesce(chunk_col.cast("string"), F.lit("")), "_cn": chunk_col.isNull()}
    d = df.withColumns({**part, "_chunk": chunk_col})
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order_cols)))
    counts = d.groupBy(*part).agg(F.count("*").alias("_n"), F.first("_chunk").alias("_at"))
    prefix = Window.partitionBy("_k", "_kn").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(prefix), F.lit(0))).drop("_n", "_at")
    d = d.join(offsets, list(part))
    return d.withColumn(out, F.col("_off") + F.col("_rn") - 1).drop(*part, "_chunk", "_rn", "_off")


def lag_and_rolling(df: DataFrame, key: str, order_cols: list[str], value: str,
                    lags: list[int] | None = None, windows: list[int] | None = None,
                    bucket_rows: int = 4096, chunk=None, include_current: bool = True) -> DataFrame:
    """Add ``lag_k`` and ``roll_mean_w`` columns per key.

    ``roll_mean_w`` is the mean of the last ``w`` rows including the current
    one (the reference's default, which leaks the target); it is NULL unless
    all ``w`` values are present. ``include_current=False`` shifts the frame
    one row back (the documented fix).
    """
    lags = DEFAULT_LAGS if lags is None else list(lags)
    windows = DEFAULT_ROLLING if windows is None else list(windows)
    shift = 0 if include_current else 1
    context = max(lags + [w + shift - 1 for w in windows] + [1])
    bucket_rows = max(bucket_rows, context)

    d = sequence_index(df, key, order_cols, chunk)
    d = d.withColumn("_bucket", F.floor(F.col("_pos") / F.lit(bucket_rows)))
    tail = F.col("_pos") - F.col("_bucket") * F.lit(bucket_rows) >= F.lit(bucket_rows - context)
    d = d.withColumn("_copies", F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    d = d.withColumn("_ctx", F.explode("_copies")).drop("_copies")
    d = d.withColumn("_bucket", F.col("_bucket") + F.col("_ctx"))

    w = Window.partitionBy(key, "_bucket").orderBy("_pos")
    cols = {}
    for k in lags:
        cols[f"lag_{k}"] = F.lag(value, k).over(w)
    for n in windows:
        frame = w.rowsBetween(-(n - 1) - shift, -shift)
        mean = F.avg(value).over(frame)
        full = F.count(value).over(frame) == F.lit(n)
        cols[f"roll_mean_{n}"] = F.when(full, mean)
    d = d.withColumns(cols)
    return d.where(F.col("_ctx") == 0).drop("_ctx", "_bucket", "_pos")


def lag_and_rolling_simple(df: DataFrame, key: str, order_cols: list[str], value: str,
                           lags: list[int] | None = None, windows: list[int] | None = None,
                           include_current: bool = True) -> DataFrame:
    """Same result with one window per key (one exchange; for keys of bounded length)."""
    lags = DEFAULT_LAGS if lags is None else list(lags)
    windows = DEFAULT_ROLLING if windows is None else list(windows)
    shift = 0 if include_current else 1
    w = Window.partitionBy(key).orderBy(*order_cols)
    cols = {f"lag_{k}": F.lag(value, k).over(w) for k in lags}
    for n in windows:
        frame = w.rowsBetween(-(n - 1) - shift, -shift)
        cols[f"roll_mean_{n}"] = F.when(F.count(value).over(frame) == F.lit(n), F.avg(value).over(frame))
    return df.withColumns(cols)


def latest_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """The last row per key by (time, tie-breaker): a ``max_by`` aggregate.

    Partial aggregation keeps one candidate per key per task before the
    shuffle, so a hot key costs nothing extra.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_m"))
    return agg.select(key, *[F.col(f"_m.{c}").alias(c) for c in others])


def tail_n_per_key(df: DataFrame, key: str, order_cols: list[str], n: int = 20) -> DataFrame:
    """The last ``n`` rows per key.

    ``row_number() <= n`` is planned as WindowGroupLimit before and after the
    shuffle, so each task ships at most ``n`` rows per key.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_cols])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sliding_window_vectors(hourly_long: DataFrame, key: str, ts: str, value: str,
                           past_hours: int = 3, horizon: int = 1, step_hours: int = 1) -> DataFrame:
    """Per sensor and window end hour: past values (NULL -> 0), mean, std (ddof 1, NULL -> 0)
    and the target ``horizon`` hours ahead.

    ``hourly_long`` must hold every hour of the grid for every sensor
    (``resample_hourly`` with gap filling). Rows whose window is incomplete
    at the start, or whose target lies past the end, are dropped, as in the
    reference's index range. After hourly resampling a sensor has one row
    per hour, so a per-sensor window is bounded by the time span, not by the
    raw row count.
    """
    filled = hourly_long.withColumn("_v0", F.coalesce(F.col(value), F.lit(0.0)))
    w = Window.partitionBy(key).orderBy(ts)
    frame = w.rowsBetween(-(past_hours - 1), 0)
    d = filled.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy(key)))
    out = d.select(
        key, F.col(ts).alias("window_end"),
        F.collect_list("_v0").over(frame).alias("past_values"),
        F.avg("_v0").over(frame).alias("past_mean"),
        F.coalesce(F.stddev_samp("_v0").over(frame), F.lit(0.0)).alias("past_std"),
        F.lead(value, horizon).over(w).alias("target"),
        F.lead(ts, horizon).over(w).alias("target_ts"),
        "_i", "_n")
    keep = ((F.col("_i") >= past_hours - 1) & (F.col("_i") < F.col("_n") - horizon)
            & ((F.col("_i") - (past_hours - 1)) % step_hours == 0))
    return out.where(keep).drop("_i", "_n")


def hourly_cells(readings: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The filled cells of the hour-by-sensor table (hour, sensor number, hourly mean), stored once: an hour without readings of
    a sensor has no row. Sensors are numbered in sorted order."""
    hour = F.date_trunc("hour", F.col(ts)).alias("hour")
    means = readings.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).groupBy(hour, key).agg(F.avg(value).cast("double").alias("v"))
    cells = location_index(means, key, "s").select("hour", "s", "v")
    path = scratch_path(cells.sparkSession, "hourly_cells")
    cells.write.parquet(path)
    return cells.sparkSession.read.schema(cells.schema).parquet(path)


def _hour_rows(n: int, past: int, behind: int):
    """Values (w, at, v) in the order of their window w -> one row of arrays per window; one window is held at a time.

    ``at`` counts through the ``past`` hours' cells of ``n`` sensors, the target's cells and the ``behind`` features that follow
    the sensors' ones. All columns are plain numbers and times: Spark measures nested ones again with every row it sends.
    """
    import numpy as np
    import pyarrow as pa

    def one(values, nulls=None):
        flat = pa.array(values) if nulls is None or not nulls.any() else pa.Array.from_buffers(
            pa.float64(), n, [pa.py_buffer(np.packbits(~nulls, bitorder="little")), pa.py_buffer(values)])
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), flat)

    def row(times, features, target, nulls):
        mean, std = features[past * n: (past + 1) * n], features[(past + 1) * n: (past + 2) * n]
        m2, centre = np.zeros(n), np.zeros(n)
        with np.errstate(all="ignore"):
            for k in range(past):  # Spark's own steps of avg and stddev_samp
                x = features[k * n: (k + 1) * n]
                mean += x
                delta = x - centre
                step = delta / (k + 1.0)
                centre += step
                m2 += delta * (delta - step)
            mean /= past
            if past > 1:
                np.sqrt(m2 / (past - 1.0), out=std)
        return pa.RecordBatch.from_arrays([times[0], one(features), one(target, nulls), times[1]], ["window_end", "features", "target", "target_ts"])

    def rows(batches):
        now = made = None
        for batch in batches:
            w, at, v = (batch.column(c).to_numpy() for c in ("w", "at", "v"))
            cuts = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:  # an empty batch
                    continue
                if w[lo] != now:
                    if now is not None:
                        yield row(*made)
                    times = [batch.column(c).slice(lo, 1) for c in ("window_end", "target_ts")]
                    now, made = w[lo], (times, np.zeros((past + 2) * n + behind), np.zeros(n), np.ones(n, bool))
                _, features, target, nulls = made
                own, values = at[lo:hi], v[lo:hi]
                seen, last = own < past * n, own >= (past + 1) * n
                features[own[seen]] = values[seen]
                features[own[last] + n] = values[last]
                ahead = ~(seen | last)
                target[own[ahead] - past * n], nulls[own[ahead] - past * n] = values[ahead], False
        if now is not None:
            yield row(*made)

    return rows


def hourly_window_vectors(readings: DataFrame, key: str, ts: str, value: str, weather: DataFrame | None = None,
                          weather_hour: str = "hour", weather_cols: list[str] | None = None,
                          past_hours: int = 3, horizon: int = 1, step_hours: int = 1) -> DataFrame:
    """One training row per hour over all sensors: ``window_end, features, target, target_ts, n_sensors``.

    ``features`` holds, in this order: the sensors' values of every window hour (hour after hour, oldest first,
    sensors in sorted order, NULL -> 0); their means and standard deviations (ddof 1) over the window;
    the weather of the last hour (NULL -> 0); hour, weekday, weekend flag, sine and cosine of the hour. ``target`` is every
    sensor's value ``horizon`` hours later (NULL stays). Windows that reach before the first or whose target lies behind the
    last hour are left out; windows end every ``step_hours`` hours.

    Only filled cells are dealt out: each goes to the windows it lies in and the one it is the target of, sorted by window.
    A task fills one window's arrays at a time, so it holds one row whatever the number of hours, and it makes about
    ``ROW_BYTES`` of rows, as writers hold rows too. The cells are stored and counted when this is called.
    """
    weather_cols = list(weather_cols or [])
    cells = hourly_cells(readings, key, ts, value)
    span = cells.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), (F.max("s") + 1).alias("n"))
    hours = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour")).union(cells.select("hour")).distinct()
    order = Window.orderBy("hour")
    at = F.row_number().over(order) - past_hours
    windows = hours.select(
        F.col("hour").alias("window_end"), F.collect_list("hour").over(order.rowsBetween(1 - past_hours, 0)).alias("past"),
        F.lead("hour", horizon).over(order).alias("target_ts"), at.alias("i"))
    windows = windows.where((F.col("i") >= 0) & F.col("target_ts").isNotNull() & (F.col("i") % step_hours == 0))
    described = windows
    if weather is not None:
        hourly = weather.groupBy(F.col(weather_hour).alias("window_end")).agg(*[F.avg(c).alias(f"w_{c}") for c in weather_cols])
        described = windows.join(hourly, "window_end", "left")
    hour, weekday = F.hour("window_end"), F.weekday("window_end")
    angle = F.lit(2.0) * F.pi() * hour / F.lit(24.0)
    there = [F.coalesce(F.col(f"w_{c}").cast("double"), F.lit(0.0)) for c in weather_cols] if weather is not None else []
    tail = F.array(*there, *[x.cast("double") for x in (hour, weekday, (weekday >= 5).cast("int"), F.sin(angle), F.cos(angle))])

    known = span.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.timestamp_diff("HOUR", "lo", "hi"), F.lit(0)).alias("hours")).first()
    n, rows = known["n"], known["hours"] // step_hours + 1
    tasks = min(rows, max(readings.sparkSession.sparkContext.defaultParallelism, -(-rows * n * (past_hours + 3) * 8 // ROW_BYTES)))
    base = F.lit(n).cast("long")
    follow = described.select("i", "window_end", "target_ts", F.posexplode(tail).alias("k", "v")).select(
        "i", "window_end", "target_ts", (base * (past_hours + 1) + F.col("k")).alias("at"), "v")
    uses = windows.select("i", "window_end", "target_ts", F.posexplode(F.concat("past", F.array("target_ts"))).alias("k", "hour"))
    filled = cells.where(F.col("v").isNotNull()).join(uses, "hour").select("i", "window_end", "target_ts", (base * F.col("k") + F.col("s")).alias("at"), "v")
    dealt = (follow.unionByName(filled).withColumn("w", (F.col("i") / step_hours).cast("int"))
             .repartitionById(tasks, F.col("w") % tasks).sortWithinPartitions("w").select("w", "window_end", "target_ts", "at", "v"))
    when = cells.schema["hour"].dataType.simpleString()
    out = dealt.mapInArrow(_hour_rows(n, past_hours, len(there) + 5), f"window_end {when}, features array<double> not null, target array<double> not null, target_ts {when}")
    return out.withColumn("n_sensors", F.lit(n).cast("int"))
