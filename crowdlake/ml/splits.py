"""Train / test splits and feature scaling (ops 104-108).

Global orderings (fraction split, rolling folds) run on the table of
*distinct times* — bounded by the time span, not by the row count — and the
resulting position is joined back to the rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.functions.scalars import ntz_lit


def chronological_split(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """``split`` = train for ``ts < cutoff``, test otherwise."""
    return df.withColumn("split", F.when(F.col(ts) < ntz_lit(cutoff), F.lit("train")).otherwise(F.lit("test")))


def time_positions(df: DataFrame, ts: str) -> tuple[DataFrame, int]:
    """Distinct times with their 0-based order position, and how many there are.

    Positions are numbered inside day chunks (partitioned window) and shifted
    by a prefix sum over the per-day counts (one row per day), so no single
    task ever orders all times.
    """
    times = df.select(ts).where(F.col(ts).isNotNull()).distinct().withColumn("_chunk", F.date_trunc("day", ts))
    times = times.withColumn("_rn", F.row_number().over(Window.partitionBy("_chunk").orderBy(ts)))
    counts = times.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = int(offsets.agg(F.sum("_n")).first()[0] or 0)
    pos = times.join(offsets.drop("_n"), "_chunk").select(ts, (F.col("_off") + F.col("_rn") - 1).alias("_pos"))
    return pos, n


def ordered_fraction_split(df: DataFrame, ts: str, train_frac: float = 0.80,
                           calib_frac: float = 0.15) -> DataFrame:
    """First ``floor(train*n)`` times train, next ``floor(calib*n)`` calib, the rest test.

    Raises ``ValueError`` when no time is left for the test split.
    """
    pos, n = time_positions(df, ts)
    n_train = int(train_frac * n)
    n_calib = int(calib_frac * n)
    if n - n_train - n_calib <= 0:
        raise ValueError("Not enough samples to split into requested sizes.")
    role = (F.when(F.col("_pos") < n_train, F.lit("train"))
            .when(F.col("_pos") < n_train + n_calib, F.lit("calib")).otherwise(F.lit("test")))
    return df.join(pos.withColumn("split", role).drop("_pos"), ts)


def random_split(df: DataFrame, keys: list[str], seed: int = 42, train_pct: int = 80) -> DataFrame:
    """Seeded 80/20 split by a hash of the row keys: repeatable under any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(h < train_pct, F.lit("train")).otherwise(F.lit("test")))


def fold_plan(n: int, window: int = 200, test: int = 200, n_splits: int = 10) -> tuple[int, int]:
    """(step, fold count) of the rolling scheme: every start that the step reaches, so a remainder adds folds beyond ``n_splits``."""
    max_start = n - (window + test)
    step = max_start // (n_splits - 1) if n_splits > 1 else max_start
    if step < 1:
        raise ValueError(f"rolling folds need at least {window + test + n_splits - 1} points, got {n}")
    count = -(-max_start // step)
    return step, count


def rolling_folds(df: DataFrame, ts: str, window: int = 200, test: int = 200, n_splits: int = 10) -> DataFrame:
    """Rows tagged with every (fold, role) they belong to.

    Fold ``k`` trains on positions ``[k*step, k*step+window)`` and tests on the
    next ``test`` positions. A row's folds follow from its position by
    arithmetic (``explode(sequence(lo, hi))``), so there is no join against a
    fold table and no pair enumeration.
    """
    pos, n = time_positions(df, ts)
    step, count = fold_plan(n, window, test, n_splits)
    span = window + test
    p = F.col("_pos")
    lo = F.greatest(F.lit(0), F.ceil((p - F.lit(span - 1)) / F.lit(step)).cast("int"))
    hi = F.least(F.lit(count - 1), F.floor(p / F.lit(step)).cast("int"))
    tagged = (pos.where(hi >= lo).withColumn("fold", F.explode(F.sequence(lo, hi)))
              .withColumn("role", F.when(p < F.col("fold") * step + window, F.lit("train")).otherwise(F.lit("test"))))
    return df.join(tagged.drop("_pos"), ts)


def fit_standard_scaler(train: DataFrame, cols: list[str], sample_std: bool = False) -> PipelineModel:
    """Fit mean and deviation of each column over ``train`` in one aggregation; the fitted scaler is a pipeline stage.

    The statistics (two numbers per column) stand in the stage itself as exact double literals, so it is
    saved, loaded, and put in front of a model like any other stage, and applying it is a plain projection. A
    column that does not vary, or has no values, is divided by 1; the population deviation is used unless ``sample_std``
    (MLlib's own scaler uses the sample deviation and maps such columns to 0).
    """
    std_fn = F.stddev_samp if sample_std else F.stddev_pop
    row = train.agg(*[e for i, c in enumerate(cols) for e in (F.avg(f"`{c}`").alias(f"m{i}"), std_fn(f"`{c}`").alias(f"s{i}"))]).first()
    scaled = []
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        std = std if std and std == std else 1.0
        mean = "CAST(NULL AS DOUBLE)" if mean is None else f"CAST('{mean!r}' AS DOUBLE)"
        scaled.append(f"(`{c}` - {mean}) / CAST('{std!r}' AS DOUBLE) AS `{c}`")
    listed = ", ".join(f"`{c}`" for c in cols)
    return PipelineModel([SQLTransformer(statement=f"SELECT * EXCEPT ({listed}), {', '.join(scaled)} FROM __THIS__")])


def apply_standard_scaler(df: DataFrame, scaler: PipelineModel) -> DataFrame:
    """``(x - mean) / std`` with the fitted statistics, columns in their old order."""
    return scaler.transform(df).select(*[F.col(f"`{c}`") for c in df.columns])


def standard_scale(df: DataFrame, train: DataFrame, cols: list[str], sample_std: bool = False) -> DataFrame:
    """Centre and scale ``cols`` with statistics fitted on ``train`` only (population std by default)."""
    return apply_standard_scaler(df, fit_standard_scaler(train, cols, sample_std))
