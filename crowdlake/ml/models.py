"""Boosted-tree models (ops 109, 111-113).

The global model is an MLlib ``Pipeline(VectorAssembler, GBTRegressor)``, trained distributed over all locations.

MLlib trees are not XGBoost (no second-order term, no regularisation, column
sampling per node rather than per tree, no missing-value branch): scores are
close, not bit-equal, and rows with NULL features must be dropped first.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession

# The reference's global model configuration.
GLOBAL_PARAMS = dict(n_trees=300, max_depth=6, learning_rate=0.05, subsample=0.9, colsample=0.8)


#: Training rows of one partition: the trees' thousands of small stages cost more than rows do below that.
ROWS_PER_PARTITION = 100_000


def global_model_spec(feature_cols: list[str], label: str = "count", n_trees: int = 300, max_depth: int = 6,
                    learning_rate: float = 0.05, subsample: float = 0.9, colsample: float = 0.8,
                    seed: int = 42) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="error")
    gbt = GBTRegressor(labelCol=label, featuresCol="features", maxIter=n_trees, maxDepth=max_depth,
                       stepSize=learning_rate, subsamplingRate=subsample,
                       featureSubsetStrategy=str(colsample), seed=seed, lossType="squared")
    return Pipeline(stages=[assembler, gbt])


def train_global_model(train: DataFrame, feature_cols: list[str], label: str = "count", partitions: int | None = None,
                       **params) -> PipelineModel:
    """Fit the global model on complete training rows.

    Boosting samples rows per partition, so the layout follows the rows alone: they are dealt by a hash of their
    values into ``partitions`` (default: one for every ``ROWS_PER_PARTITION`` rows, two at least) and sorted. The same rows give
    the same model on any number of cores and under any session setting.
    """
    p = dict(GLOBAL_PARAMS)
    p.update(params)
    cols = [*feature_cols, label]
    rows = train.dropna(subset=cols).select(*cols).persist()
    n = partitions or max(2, -(-rows.count() // ROWS_PER_PARTITION))
    laid = rows.repartition(n, *cols).sortWithinPartitions(*cols).persist()
    try:
        return global_model_spec(feature_cols, label, **p).fit(laid)
    finally:
        laid.unpersist()
        rows.unpersist()


def formula_model(expression: str, prediction: str = "prediction") -> PipelineModel:
    """A model that is one SQL expression over the input columns: scored, saved and loaded like the trees.

    Use it for baselines (weighted persistence and the like) whose results anyone can recompute.
    """
    return PipelineModel([SQLTransformer(statement=f"SELECT *, CAST({expression} AS DOUBLE) AS {prediction} FROM __THIS__")])


def with_scaler(scaler: PipelineModel, model: PipelineModel) -> PipelineModel:
    """One model to save: the fitted scaler in front of a model that was trained on scaled columns."""
    return PipelineModel([*scaler.stages, *model.stages])


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Score rows; ``prediction`` is added (NULL-feature rows must be removed beforehand)."""
    out = model.transform(df)
    cols = (keep or [c for c in df.columns]) + ["prediction"]
    return out.select(*cols)


def feature_importance(spark: SparkSession, model: PipelineModel, feature_cols: list[str]) -> DataFrame:
    """(feature, importance) from the fitted trees (model metadata, one row per feature)."""
    gbt = model.stages[-1]
    imp = gbt.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feature_cols, imp)],
                                 "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
