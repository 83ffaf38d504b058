"""Leakage, identity and envelope checks on data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import longer
from panelcast.operators.features import series_window, transform
from panelcast.operators.stats import series_swing
from panelcast.spec import PanelSpec


def degeneracy(features: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Largest gap between rm3 and the combination of d_l1 and d_l2 it must equal."""
    gap = F.abs(F.col("rm3") + (F.col("d_l1") * 2.0 + F.col("d_l2")) / 3.0)
    known = features.na.drop(subset=["rm3", "d_l1", "d_l2"])
    return known.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(gap).alias("max_abs_gap"),
        (F.max(gap) < tolerance).alias("holds"),
    )


def warmup_nulls(features: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per feature, nulls on rows whose index in the series passed the warm-up."""
    index = F.row_number().over(series_window(spec)) - 1
    mature = features.withColumn("_index", index).where(F.col("_index") >= spec.min_history)
    names = spec.numeric_features
    one = mature.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return longer(one, [], names, "feature", "n_null")


def perturb_month(
    panel: DataFrame, month: Column, spec: PanelSpec, factor: float = 7.3, shift: float = 11.0
) -> DataFrame:
    """Corrupt every metric of one month."""
    hit = F.col(spec.date) == month
    return panel.withColumns(
        {m: F.when(hit, F.col(m) * factor + shift).otherwise(F.col(m)) for m in spec.metrics}
    )


def leakage_perturbation(
    panel: DataFrame, spec: PanelSpec = PanelSpec(), tolerance: float = 1e-12
) -> DataFrame:
    """Per feature, how far it moves in the month whose own metrics were corrupted."""
    last = panel.agg(F.max(spec.date)).scalar()
    names = spec.numeric_features

    def at_last(p: DataFrame, tag: str) -> DataFrame:
        rows = transform(p, spec).where(F.col(spec.date) == last)
        return rows.select(
            *spec.series, *[F.col(c).cast("double").alias(f"{c}__{tag}") for c in names]
        )

    both = at_last(panel, "a").join(at_last(perturb_month(panel, last, spec), "b"), spec.series)
    one = both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.max(F.abs(F.col(f"{c}__a") - F.col(f"{c}__b"))).alias(c) for c in names],
    )
    return longer(one, ["n_rows"], names, "feature", "max_abs_diff").withColumn(
        "leaks", F.coalesce(F.col("max_abs_diff") >= tolerance, F.lit(False))
    )


def leakage_equality(
    features: DataFrame, names: list[str], metrics: list[str]
) -> DataFrame:
    """For each (feature, metric): are they the same on every row?

    A row's answers for one feature are bits of a number, one per metric; the bits
    left after ``bit_and`` are the metrics it always equals.
    """

    def same(f: str) -> Column:
        bits = F.lit(0)
        for i, m in enumerate(metrics):
            hit = F.col(f).cast("double").eqNullSafe(F.col(m))
            bits = bits.bitwiseOR(F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)))
        return bits

    one = features.agg(*[F.bit_and(same(f)).alias(f) for f in names])
    per_feature = longer(one, [], names, "feature", "bits")
    answers = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                (F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias("same"),
            )
            for i, m in enumerate(metrics)
        ]
    )
    return per_feature.select("feature", F.inline(answers))


def leakage_shift(features: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Largest gap between ly_l1 and the log target of the calendar month before.

    Compared where that month exists; a positional lag agrees with it there.
    """
    shifted = features.select(
        *spec.series,
        F.add_months(spec.date, 1).alias(spec.date),
        F.col("ly").alias("ly_before"),
    )
    both = features.select(*spec.key, "ly_l1").join(shifted, spec.key)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.abs(F.col("ly_l1") - F.col("ly_before"))).alias("max_abs_gap"),
    )


def partial_segment_effect(
    panel: DataFrame, entity: str, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """How far share_l1 of the others moves when one entity is left out everywhere."""
    full = transform(panel, spec).select(*spec.key, F.col("share_l1").alias("full"))
    rest = panel.where(F.col(spec.entity) != entity)
    part = transform(rest, spec).select(*spec.key, F.col("share_l1").alias("part"))
    both = full.join(part, spec.key).where("full IS NOT NULL AND part IS NOT NULL")
    gap = F.abs(F.col("full") - F.col("part"))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(gap > 1e-9).alias("n_moved"),
        F.max(gap).alias("max_abs_gap"),
    )


def forecast_envelope(
    forecast: DataFrame,
    panel: DataFrame,
    spec: PanelSpec = PanelSpec(),
    low: float = 0.2,
    high: float = 5.0,
    stable_pct: float = 30.0,
) -> DataFrame:
    """Per series: is the forecast within bounds of the last value, and calm if history was?"""
    joined = forecast.join(series_swing(panel, spec), spec.series, "left")
    level = F.try_divide(F.col("prediction"), F.col("last_actual"))
    stable = F.coalesce(F.col("max_swing_pct") < stable_pct, F.lit(False))
    return joined.select(
        *spec.series,
        level.alias("level_ratio"),
        "max_swing_pct",
        stable.alias("is_stable"),
        level.between(low, high).alias("in_envelope"),
        (~stable | (F.abs("pct_change") < stable_pct)).alias("calm_enough"),
    )
