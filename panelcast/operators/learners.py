"""Pooled learners of the next log step: trees, forests and linear models."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise
from panelcast.functions.ordering import position_within
from panelcast.operators.baselines import as_forecast
from panelcast.operators.encoding import CodeMaps, nominal_indexers
from panelcast.operators.features import reconstruct, scoring_frame
from panelcast.spec import PanelSpec

LABEL = "target_d"

# The tuned boosted-tree settings, as far as they exist here.
# 15 leaves correspond to depth 4.
GBT_DEFAULTS = {
    "maxIter": 500,
    "stepSize": 0.02,
    "maxDepth": 4,
    "minInstancesPerNode": 10,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.9",
    "seed": 42,
}


def _trees(codes: CodeMaps, estimator: Estimator, spec: PanelSpec) -> Pipeline:
    indexers = nominal_indexers(codes, spec)
    # trees need a bin for every category
    bins = max(estimator.getMaxBins(), *[len(i.labels) for i in indexers])
    assembler = VectorAssembler(inputCols=spec.feature_order, outputCol="features")
    return Pipeline(stages=[*indexers, assembler, estimator.setMaxBins(bins)])


def boosted_trees(codes: CodeMaps, spec: PanelSpec = PanelSpec(), **params) -> Pipeline:
    return _trees(codes, GBTRegressor(labelCol=LABEL, **{**GBT_DEFAULTS, **params}), spec)


def random_forest(codes: CodeMaps, spec: PanelSpec = PanelSpec(), **params) -> Pipeline:
    settings = {"numTrees": 100, "maxDepth": 8, "seed": 42, **params}
    return _trees(codes, RandomForestRegressor(labelCol=LABEL, **settings), spec)


def linear(
    codes: CodeMaps,
    spec: PanelSpec = PanelSpec(),
    lasso: bool = False,
    regParam: float = 0.001,
    **params,
) -> Pipeline:
    """Ridge, or lasso: train-fitted scaling and one-hot categories."""
    one_hot = [f"{c}_onehot" for c in spec.codes]
    return Pipeline(
        stages=[
            *nominal_indexers(codes, spec),
            VectorAssembler(inputCols=spec.numeric_features, outputCol="numeric"),
            StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True),
            OneHotEncoder(inputCols=spec.codes, outputCols=one_hot),
            VectorAssembler(inputCols=["scaled", *one_hot], outputCol="features"),
            LinearRegression(
                labelCol=LABEL,
                elasticNetParam=1.0 if lasso else 0.0,
                regParam=regParam,
                standardization=False,
                **params,
            ),
        ]
    )


# Train rows of one task of a fit. Subsampling depends on which rows share a partition, so the
# number of tasks follows the number of rows: the same rows give the same trees whatever the
# session, and more rows use more of a cluster.
ROWS_PER_TASK = 20_000


def fit_order(
    train: DataFrame, spec: PanelSpec = PanelSpec(), parts: int | None = None
) -> DataFrame:
    """Rows in a layout that they alone decide, written once, as every boosting round rereads them.

    Hashing the whole key spreads rows evenly and, unlike sampled ranges, places them the
    same way in every run. ``train`` is counted first, so it should be written already;
    ``parts`` overrides the number of tasks.
    """
    if parts is None:
        parts = max(1, -(-train.count() // ROWS_PER_TASK))
    laid_out = train.repartition(parts, *spec.key).sortWithinPartitions(*spec.key)
    return materialise(laid_out)


def predict_level(model: PipelineModel, frame: DataFrame, name: str) -> DataFrame:
    """Add the predicted level as ``name``; the pipeline's own columns are dropped."""
    scored = model.transform(frame)
    level = reconstruct(F.col("ly_l1"), F.col("prediction"))
    return scored.select(*frame.columns, level.alias(name))


def forecast_model(
    panel: DataFrame,
    model: PipelineModel,
    spec: PanelSpec = PanelSpec(),
    on_incomplete: str = "error",
) -> DataFrame:
    """Next month per series from a fitted pipeline."""
    rows = scoring_frame(panel, spec, on_incomplete=on_incomplete)
    return as_forecast(model.transform(rows), F.col("prediction"), spec)


def split_importance(model: PipelineModel, spec: PanelSpec = PanelSpec()) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(
        list(zip(spec.feature_order, values)), "feature string, importance double"
    )


def shuffled_within_month(
    rows: DataFrame, columns: list[str], spec: PanelSpec = PanelSpec(), seed: int = 42
) -> DataFrame:
    """Add ``<c>__s``: the column's value of another row of the same month.

    Rows of a month are put in hash order and each takes its successor's values, the last
    one those of the first. Places are global positions, so a month with a large part of
    all rows is not gathered in one task; the join is on (month, place).
    """
    ident = [F.col(c) for c in spec.series]
    hashed = rows.withColumn("_h", F.xxhash64(*ident, F.lit(seed)))
    order = [F.col("_h"), *ident]
    placed = materialise(position_within(hashed, [spec.date], order, position="_place"))
    sizes = placed.groupBy(spec.date).agg(F.max("_place").alias("_n"))
    # the value at a place goes to the place before it, the first one's to the last place
    given = placed.join(sizes, spec.date).select(
        spec.date,
        F.when(F.col("_place") == 1, F.col("_n")).otherwise(F.col("_place") - 1).alias("_place"),
        *[F.col(c).alias(f"{c}__s") for c in columns],
    )
    return placed.join(given, [spec.date, "_place"]).drop("_h", "_place")


def permutation_importance(
    model: PipelineModel, test: DataFrame, spec: PanelSpec = PanelSpec(), seed: int = 42
) -> DataFrame:
    """Per model input, the wMAPE gained by shuffling it within its month.

    All inputs are scored in one pass: each row is expanded once per input, with that
    input replaced, and the error is summed per input with map-side combining.
    """
    inputs = spec.numeric_features + spec.series
    used = test.select(*spec.key, *spec.numeric_features, "ly_l1", "y")
    shuffled = shuffled_within_month(used, inputs, spec, seed)
    variants = F.explode(F.array(F.lit(""), *[F.lit(c) for c in inputs]))
    expanded = shuffled.withColumn("variant", variants)
    replaced = expanded.withColumns(
        {
            c: F.when(F.col("variant") == c, F.col(f"{c}__s")).otherwise(F.col(c))
            for c in inputs
        }
    )
    scored = predict_level(model, replaced.select(*used.columns, "variant"), "pred")
    errors = scored.groupBy("variant").agg(
        (F.sum(F.abs(F.col("y") - F.col("pred"))) / F.sum("y") * 100.0).alias("wmape")
    )
    errors = materialise(errors)
    base = errors.where("variant = ''").agg(F.max("wmape")).scalar()
    feature = F.create_map(
        *[
            x
            for c in inputs
            for x in (F.lit(c), F.lit(dict(zip(spec.series, spec.codes)).get(c, c)))
        ]
    )
    return errors.where("variant != ''").select(
        feature[F.col("variant")].alias("feature"),
        F.col("wmape").alias("permuted_wmape"),
        (F.col("wmape") - base).alias("wmape_increase"),
    )
