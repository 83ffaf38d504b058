"""Series on the calendar: missing months filled in as rows, gaps counted, lags by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.features import series_window
from panelcast.spec import PanelSpec


def densify(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Every month between a series' first and last, with ``is_gap`` and ``gap_length``.

    A missing month is a row with NULL metrics; ``gap_length`` is the number of months
    missing in a row at that place, 0 on rows that were there. Each row brings the gap
    after it, so one window by series is all: no spine is joined.
    """
    w = series_window(spec)
    following = F.lead(spec.date).over(w)
    months = F.months_between(F.coalesce("_next", F.add_months(spec.date, 1)), spec.date).cast("int")
    others = [c for c in panel.columns if c not in spec.key]
    rows = panel.withColumn("_next", following).select("*", F.posexplode(F.sequence(F.lit(0), months - 1)).alias("_i", "_step"), (months - 1).alias("_gap"))
    there = F.col("_i") == 0
    return rows.select(
        *spec.series,
        F.add_months(spec.date, F.col("_i")).alias(spec.date),
        *[F.when(there, F.col(c)).alias(c) for c in others],
        (~there).alias("is_gap"),
        F.when(there, 0).otherwise(F.col("_gap")).alias("gap_length"),
    )


def calendar_lags(
    panel: DataFrame, column: str, lags: list[int], spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """The panel's own rows with ``<column>_m<k>``, the value k months before; NULL in a gap.

    Positional lags (``features.transform``) take the k-th row before, whatever its month.
    """
    w = series_window(spec)
    dense = densify(panel, spec).withColumns({f"{column}_m{k}": F.lag(column, k).over(w) for k in lags})
    return dense.where(~F.col("is_gap")).drop("is_gap", "gap_length")


def gap_report(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per series: months, missing months, gaps, and the longest one."""
    dense = densify(panel, spec)
    before = F.lag("is_gap").over(Window.partitionBy(*spec.series).orderBy(spec.date))
    starts = dense.withColumn("_starts", F.col("is_gap") & ~before)
    return starts.groupBy(*spec.series).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.count_if("is_gap").alias("n_missing"),
        F.count_if("_starts").alias("n_gaps"),
        F.max("gap_length").alias("longest_gap"),
    )
