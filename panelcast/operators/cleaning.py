"""Train-fitted imputation, caps, flags and scaling.

Each statistic is fitted on rows stamped as train and applied to all rows. Fitted
tables hold one row per series and are joined back; quartiles are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.spec import SPLIT, TRAIN, PanelSpec


def _train(stamped: DataFrame) -> DataFrame:
    return stamped.where(F.col(SPLIT) == TRAIN)


def fit_medians(stamped: DataFrame, columns: list[str], spec: PanelSpec) -> DataFrame:
    return _train(stamped).groupBy(*spec.series).agg(
        *[F.percentile(c, F.lit(0.5)).alias(f"{c}__median") for c in columns]
    )


def impute(
    stamped: DataFrame, columns: list[str] | None = None, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Missing metrics become the series' train median."""
    columns = columns or list(spec.exog)
    joined = stamped.join(fit_medians(stamped, columns, spec), spec.series, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}__median")) for c in columns}
    return joined.withColumns(filled).select(*stamped.columns)


def fit_fences(
    stamped: DataFrame, columns: list[str], multiplier: float, spec: PanelSpec
) -> DataFrame:
    """(series, c__lo, c__hi) at ``multiplier`` interquartile ranges beyond the quartiles."""
    quartiles = _train(stamped).groupBy(*spec.series).agg(
        *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"{c}__q") for c in columns]
    )
    bounds = []
    for c in columns:
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[1]
        bounds += [
            (q1 - (q3 - q1) * multiplier).alias(f"{c}__lo"),
            (q3 + (q3 - q1) * multiplier).alias(f"{c}__hi"),
        ]
    return quartiles.select(*spec.series, *bounds)


def cap_exog(
    stamped: DataFrame, multiplier: float = 3.0, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Exogenous metrics pulled to their train fences; the target is never capped."""
    columns = list(spec.exog)
    joined = stamped.join(fit_fences(stamped, columns, multiplier, spec), spec.series, "left")
    capped = {
        c: F.when(F.col(c) < F.col(f"{c}__lo"), F.col(f"{c}__lo"))
        .when(F.col(c) > F.col(f"{c}__hi"), F.col(f"{c}__hi"))
        .otherwise(F.col(c))
        for c in columns
    }
    return joined.withColumns(capped).select(*stamped.columns)


def flag_target(
    stamped: DataFrame, multiplier: float = 1.5, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Rows with ``is_outlier``: target outside the series' train fences, left intact."""
    t = spec.target
    joined = stamped.join(fit_fences(stamped, [t], multiplier, spec), spec.series, "left")
    outside = (F.col(t) < F.col(f"{t}__lo")) | (F.col(t) > F.col(f"{t}__hi"))
    return joined.withColumn("is_outlier", outside).select(*stamped.columns, "is_outlier")


def flags_by_month(flagged: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return flagged.groupBy(F.month(spec.date).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_outlier").alias("n_outliers")
    )


def scale_features(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the mean and population deviation of the train rows."""
    stats = _train(cleaned).agg(
        F.struct(
            *[F.avg(c).alias(f"{c}__m") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}__s") for c in columns],
        )
    )
    joined = cleaned.withColumn("_stats", stats.scalar())
    scaled = {
        c: F.try_divide(
            F.col(c).cast("double") - F.col(f"_stats.{c}__m"), F.col(f"_stats.{c}__s")
        )
        for c in columns
    }
    return joined.withColumns(scaled).drop("_stats")
