"""Segment forecasts and their bottom-up totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import pct_change, ratio
from panelcast.functions.ordering import position_within
from panelcast.operators.baselines import FORECAST_VALUES
from panelcast.spec import CONTRACT_VERSION, PanelSpec


def _whole_sum(c: str):
    """The sum, or NULL when a value is missing: part of a total is not the total."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)


def reconcile_total(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per entity, the sum over segments, labelled as the total.

    A total with a missing segment value is NULL; ``missing_segments`` counts them.
    """
    summed = forecast.groupBy(spec.entity, "target_month").agg(
        _whole_sum("last_actual"), _whole_sum("prediction")
    )
    return summed.withColumns(
        {
            spec.segment: F.lit(spec.total_label),
            "pct_change": pct_change(F.col("prediction"), F.col("last_actual")),
        }
    ).select(*spec.series, *FORECAST_VALUES)


def with_total(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Segment rows and the total rows of ``reconcile_total``, in one pass.

    Each row counts for its own segment and for the total, so the forecast behind it
    is not computed a second time for the totals.
    """
    label = F.explode(F.array(F.col(spec.segment), F.lit(spec.total_label)))
    both = forecast.withColumn(spec.segment, label)
    summed = both.groupBy(*spec.series, "target_month").agg(
        _whole_sum("last_actual"), _whole_sum("prediction")
    )
    change = pct_change(F.col("prediction"), F.col("last_actual"))
    return summed.withColumn("pct_change", change).select(*spec.series, *FORECAST_VALUES)


def missing_segments(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per entity, how many segments there are and how many lack a prediction."""
    segments = forecast.where(F.col(spec.segment) != spec.total_label)
    return segments.groupBy(spec.entity, "target_month").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("prediction").isNull()).alias("n_missing"),
    )


def tag(
    forecast: DataFrame,
    source: str,
    model_version: str,
    run_id: str | None = None,
    contract_version: int = CONTRACT_VERSION,
) -> DataFrame:
    """Provenance on every row, so a fallback never looks like a model forecast."""
    if source not in ("model", "fallback"):
        raise ValueError(f"source must be 'model' or 'fallback', not {source!r}")
    tags = {
        "source": F.lit(source),
        "model_version": F.lit(model_version),
        "contract_version": F.lit(contract_version),
    }
    if run_id is not None:
        tags["run_id"] = F.lit(run_id)
    return forecast.withColumns(tags)


def forecast_ranked(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Rank by prediction inside each segment, largest first; ties by entity."""
    order = [F.desc_nulls_last("prediction"), F.col(spec.entity)]
    rows = forecast.select(*spec.series, *FORECAST_VALUES)
    return position_within(rows, [spec.segment], order, position="rank")


def forecast_summary(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Headline of the total rows: sum, change, entities, largest entity."""
    totals = forecast.where(F.col(spec.segment) == spec.total_label)
    head = totals.agg(
        _whole_sum("prediction").alias("total_prediction"),
        _whole_sum("last_actual").alias("total_last_actual"),
        F.count(F.lit(1)).alias("n_entities"),
        # equal predictions: the first name wins
        F.min(
            F.struct((-F.col("prediction")).alias("p"), F.col(spec.entity).alias("name"))
        ).alias("_top"),
    )
    return head.select(
        "total_prediction",
        "total_last_actual",
        pct_change(F.col("total_prediction"), F.col("total_last_actual")).alias("total_pct_change"),
        "n_entities",
        F.col("_top.name").alias("largest_entity"),
    )


def additivity(panel_with_total: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Largest relative gap between the total rows and the sum of the segments.

    One pass: both sides are conditional sums of the same group.
    """
    is_total = F.col(spec.segment) == spec.total_label
    cells = panel_with_total.groupBy(spec.entity, spec.date).agg(
        F.sum(F.when(is_total, F.col(spec.target))).alias("total"),
        F.sum(F.when(~is_total, F.col(spec.target))).alias("parts"),
    )
    gap = ratio(F.abs(F.col("total") - F.col("parts")), F.abs("total"))
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.max(gap).alias("max_relative_error"))


def parity_diff(
    got: DataFrame, expected: DataFrame, spec: PanelSpec = PanelSpec(), tolerance: float = 1e-6
) -> DataFrame:
    """One row: keys missing or extra, and the largest difference with its key.

    Keys are series and target month. A key without a prediction counts like an absent
    one, on either side.
    """
    keys = [*spec.series, "target_month"]
    left = got.select(*keys, F.col("prediction").alias("got"))
    right = expected.select(*keys, F.col("prediction").alias("want"))
    both = left.join(right, keys, "full_outer")
    key = F.concat(F.col(spec.entity), F.lit("|"), F.col(spec.segment))
    diff = F.abs(F.col("got") - F.col("want"))
    one = both.agg(
        F.count(diff).alias("n_compared"),
        F.count_if(F.col("got").isNull()).alias("n_missing"),
        F.count_if(F.col("want").isNull()).alias("n_extra"),
        F.max(diff).alias("max_abs_diff"),
        F.min(
            F.when(diff.isNotNull(), F.struct((-diff).alias("d"), key.alias("key")))
        ).alias("_worst"),
    )
    return one.select(
        "n_compared",
        "n_missing",
        "n_extra",
        "max_abs_diff",
        F.col("_worst.key").alias("worst_key"),
        (
            (F.col("n_missing") == 0)
            & (F.col("n_extra") == 0)
            & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance)
        ).alias("within_tolerance"),
    )
