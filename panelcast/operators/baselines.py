"""Forecasts that need no learner: persistence, seasonal, drift, AR(1), blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import log_positive, next_month, pct_change
from panelcast.operators.features import as_of_month, reconstruct, series_window
from panelcast.spec import SPLIT, TRAIN, PanelSpec

FORECAST_VALUES = ["target_month", "last_actual", "prediction", "pct_change"]


def with_baselines(features: DataFrame, spec: PanelSpec = PanelSpec(), season: int = 12):
    """Add the one-step predictions ``naive``, ``seasonal_naive`` and ``drift``.

    The drift is the mean step of the history up to the previous row. All of them
    share the window of the features.
    """
    w = series_window(spec)
    row = F.row_number().over(w)
    previous = F.lag("y", 1).over(w)
    first = F.first("y").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stepped = features.withColumns(
        {"_row": row, "_prev": previous, "_first": first, "seasonal_naive": F.lag("y", season).over(w)}
    )
    drift = F.when(
        F.col("_row") > 2,
        F.col("_prev") + (F.col("_prev") - F.col("_first")) / (F.col("_row") - 2),
    )
    return stepped.withColumns({"naive": F.exp("ly_l1"), "drift": drift}).drop(
        "_row", "_prev", "_first"
    )


def ar1_coefficients(features: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per series, least squares of the log step on the step before, train rows only."""
    train = features.where(F.col(SPLIT) == TRAIN)
    return train.groupBy(*spec.series).agg(
        F.regr_count("target_d", "d_l1").alias("n_steps"),
        F.regr_intercept("target_d", "d_l1").alias("intercept"),
        F.regr_slope("target_d", "d_l1").alias("slope"),
    )


def with_ar1(features: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Add ``ar1``: the one-step prediction with coefficients fitted on train rows.

    The fit is a window over the whole series, which is already partitioned that way,
    so fitting and predicting need no further shuffle and no join.
    """
    whole = Window.partitionBy(*spec.series)
    in_train = F.col(SPLIT) == TRAIN
    step, before = F.when(in_train, F.col("target_d")), F.when(in_train, F.col("d_l1"))
    fitted = features.withColumns(
        {
            "_a": F.regr_intercept(step, before).over(whole),
            "_b": F.regr_slope(step, before).over(whole),
        }
    )
    delta = F.col("_a") + F.col("_b") * F.col("d_l1")
    return fitted.withColumn("ar1", reconstruct(F.col("ly_l1"), delta)).drop("_a", "_b")


def blend(a: str, b: str, weight: float) -> Column:
    """Weighted mean of two predictions."""
    return F.col(a) * weight + F.col(b) * (1.0 - weight)


def as_forecast(df: DataFrame, delta: Column, spec: PanelSpec) -> DataFrame:
    """Forecast rows from ``ly_l1``, ``target_month`` and a predicted log step."""
    rows = df.select(
        *spec.series,
        "target_month",
        F.exp("ly_l1").alias("last_actual"),
        reconstruct(F.col("ly_l1"), delta).alias("prediction"),
    )
    return rows.withColumn("pct_change", pct_change(F.col("prediction"), F.col("last_actual")))


def forecast_ar1(
    panel: DataFrame, train_end: str, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Next month per series from its AR(1) of log steps, in one shuffle of the panel.

    A series whose train part is too short for a fit gets a NULL prediction.
    """
    w = series_window(spec)
    whole = Window.partitionBy(*spec.series)
    month = next_month(as_of_month(panel, spec))
    levels = panel.select(*spec.key, log_positive(spec.target).alias("ly"))
    steps = levels.withColumns(
        {
            "step": F.col("ly") - F.lag("ly", 1).over(w),
            "before": F.lag("ly", 1).over(w) - F.lag("ly", 2).over(w),
            "_is_last": F.lead(F.lit(1)).over(w).isNull(),
        }
    )
    in_train = F.col(spec.date) <= F.to_date(F.lit(train_end))
    y, x = F.when(in_train, F.col("step")), F.when(in_train, F.col("before"))
    fitted = steps.withColumns(
        {"_a": F.regr_intercept(y, x).over(whole), "_b": F.regr_slope(y, x).over(whole)}
    )
    last = fitted.where("_is_last").withColumnRenamed("ly", "ly_l1")
    return as_forecast(
        last.withColumn("target_month", month), F.col("_a") + F.col("_b") * F.col("step"), spec
    )


def fallback_forecast(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Persistence for series that have a row in the latest month."""
    as_of = as_of_month(panel, spec)
    current = panel.where(F.col(spec.date) == as_of)
    rows = current.groupBy(*spec.key).agg(
        F.max(F.col(spec.target).cast("double")).alias("last_actual")
    )
    return rows.select(
        *spec.series,
        next_month(F.col(spec.date)).alias("target_month"),
        "last_actual",
        F.col("last_actual").alias("prediction"),
        F.when(F.col("last_actual").isNotNull(), F.lit(0.0)).alias("pct_change"),
    )
