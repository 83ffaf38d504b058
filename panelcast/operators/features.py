"""Leakage-safe features: everything at month t is a function of months before t.

All history columns of a series come from one window (one shuffle, one sort). The
cross-section total is an aggregate joined back, so a segment-month with very many
entities is summed map-side instead of being gathered in one window group. The totals
are written before they are joined: their real size decides about the broadcast, and a
panel that must be shuffled for them is dealt by (segment, month, salt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.columns import calendar_columns, log_positive, next_month, series_id
from panelcast.functions.lineage import materialise
from panelcast.functions.ordering import salted_join
from panelcast.operators.encoding import CodeMaps, apply_codes
from panelcast.spec import SPLIT, TEST, TRAIN, PanelSpec


def series_window(spec: PanelSpec) -> WindowSpec:
    return Window.partitionBy(*spec.series).orderBy(spec.date)


def over_series(spec: PanelSpec, frame: str = "") -> str:
    """The same window as SQL text; long column lists are cheaper to build that way."""
    return f"OVER (PARTITION BY `{spec.entity}`, `{spec.segment}` ORDER BY `{spec.date}` {frame})"


def segment_totals(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """(segment, date, total, lzt): the whole cross-section's target and its log."""
    totals = panel.groupBy(spec.segment, spec.date).agg(F.sum(spec.target).alias("total"))
    return totals.withColumn("lzt", log_positive("total"))


def _levels(panel: DataFrame, totals: DataFrame, spec: PanelSpec) -> DataFrame:
    levels = panel.withColumns(
        {"y": F.col(spec.target).cast("double"), "ly": log_positive(spec.target)}
    )
    written = materialise(totals.drop("total"))
    return salted_join(levels, written, [spec.segment, spec.date], F.col(spec.entity), "left")


def with_levels(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add ``y``, ``ly`` and the cross-section's log total ``lzt``."""
    return _levels(panel, segment_totals(panel, spec), spec)


def history_columns(spec: PanelSpec, newest: int) -> list[str]:
    """Window columns over a series, as SQL text.

    ``newest`` is how many rows back the most recent usable month lies: 1 describes
    an observed row (its own month is not usable), 0 describes the row that would
    come next, so the last row of a series yields next month's features directly.
    """

    def back(c: str, k: int) -> str:
        steps = k - 1 + newest
        return f"lag(`{c}`, {steps}) {over_series(spec)}" if steps else f"`{c}`"

    def over_last(n: int) -> str:
        def end(rows: int) -> str:
            return f"{rows} PRECEDING" if rows else "CURRENT ROW"

        return over_series(spec, f"ROWS BETWEEN {end(n - 1 + newest)} AND {end(newest)}")

    cols = [f"{back('ly', k)} AS ly_l{k}" for k in range(1, spec.max_lag + 2)]
    # frame aggregates skip missing months, so a short history still yields a value
    cols += [
        f"avg(ly) {over_last(3)} AS _mean3",
        f"avg(ly) {over_last(spec.max_lag)} AS _mean6",
        f"stddev_samp(ly) {over_last(spec.max_lag)} AS sd6",
        f"{back('lzt', 1)} AS zt_l1",
        f"{back('lzt', 2)} AS _zt_l2",
    ]
    for c in spec.exog:
        cols += [f"{back(c, 1)} AS `{c}_l1`", f"{back(c, 2)} AS `_{c}_l2`"]
    return cols


def derived_columns(spec: PanelSpec) -> list[str]:
    """Arithmetic on the window columns, as SQL text."""
    return [
        *[f"ly_l{k} - ly_l{k + 1} AS d_l{k}" for k in (1, 2, 3)],
        "_mean3 - ly_l1 AS rm3",
        "_mean6 - ly_l1 AS rm6",
        "zt_l1 - _zt_l2 AS zt_d1",
        "ly_l1 - zt_l1 AS share_l1",
        *[f"`{c}_l1` - `_{c}_l2` AS `{c}_d1`" for c in spec.exog],
    ]


def _finish(df: DataFrame, date: str, spec: PanelSpec, codes: CodeMaps | None) -> DataFrame:
    helpers = {"_mean3", "_mean6", "_zt_l2", *[f"_{c}_l2" for c in spec.exog]}
    kept = [f"`{c}`" for c in df.columns if c not in helpers]
    out = df.selectExpr(*kept, *derived_columns(spec)).withColumns(
        {**calendar_columns(F.col(date), spec), "series_id": series_id(spec)}
    )
    return apply_codes(out, codes, spec) if codes else out


def transform(
    panel: DataFrame, spec: PanelSpec = PanelSpec(), codes: CodeMaps | None = None
) -> DataFrame:
    """Every feature beside the panel's own columns, one row in and one row out.

    A lag is the series' row before, whatever months lie between. Early rows of a series
    have NULLs. Nothing is fitted here; with ``codes`` the code columns are looked up too.
    """
    seen = with_levels(panel, spec).selectExpr("*", *history_columns(spec, newest=1))
    return _finish(seen, spec.date, spec, codes)


def as_of_month(panel: DataFrame, spec: PanelSpec) -> Column:
    """Latest month of the whole panel, as a scalar subquery."""
    return panel.agg(F.max(spec.date)).scalar()


def target_month(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One row: the latest month and the month to forecast."""
    return panel.agg(F.max(spec.date).alias("as_of")).withColumn(
        "target_month", next_month("as_of")
    )


def series_last(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per series, the last non-missing value of each metric and the last date."""
    known = {m: F.when(F.col(m).isNotNull(), F.col(spec.date)) for m in spec.metrics}
    return panel.groupBy(*spec.series).agg(
        F.max(spec.date).alias(spec.date),
        *[F.max_by(m, known[m]).alias(m) for m in spec.metrics],
    )


def extended_panel(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The panel and one row per series for the month to forecast.

    The appended metrics are the last known ones; no feature of that month reads them.
    """
    tail = series_last(panel, spec).withColumn(spec.date, next_month(as_of_month(panel, spec)))
    return panel.select(*spec.columns).unionByName(tail.select(*spec.columns))


def scoring_frame(
    panel: DataFrame,
    spec: PanelSpec = PanelSpec(),
    codes: CodeMaps | None = None,
    on_incomplete: str = "error",
) -> DataFrame:
    """Next month's features, one row per series.

    Equal to transforming the extended panel and keeping the target month, but the
    features are read off each series' last row, so nothing is appended. Only the
    last rows a feature can reach are kept; that limit is applied before the shuffle
    as well. It counts rows, not months, so series with gaps keep the right ones.
    A series that ended early is still scored from its own last rows.
    ``on_incomplete='error'`` fails the job on a missing feature, ``'keep'`` leaves
    it NULL.
    """
    month = next_month(as_of_month(panel, spec))
    newest_first = Window.partitionBy(*spec.series).orderBy(F.desc(spec.date))
    recent = panel.withColumn("_age", F.row_number().over(newest_first)).where(
        F.col("_age") <= spec.max_lag + 1
    )
    # the cross-section is summed over the whole panel, not over the kept rows
    ahead = (
        _levels(recent, segment_totals(panel, spec), spec)
        .selectExpr("*", *history_columns(spec, newest=0))
        .where("_age = 1")
        .withColumn("target_month", month)
    )
    out = _finish(ahead, "target_month", spec, codes)
    if on_incomplete == "error":
        out = require_features(out, spec.feature_order if codes else spec.numeric_features)
    elif on_incomplete != "keep":
        raise ValueError(f"on_incomplete must be 'error' or 'keep', not {on_incomplete!r}")
    names = spec.feature_order if codes else spec.numeric_features
    return out.select(*spec.series, "series_id", "target_month", "ly_l1", "d_l1", *names)


def require_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Fail when a row lacks a feature, inside the plan rather than by a driver check.

    The check is a filter, which no choice of columns and no count can prune away.
    """
    lacking = F.expr(" OR ".join(f"`{name}` IS NULL" for name in names))
    message = F.concat(F.lit("series too short for its features: "), F.col("series_id"))
    return df.where(F.when(lacking, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def stamp_split(panel: DataFrame, train_end: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Temporal split, decided once; later steps only read the stamp."""
    in_train = F.col(spec.date) <= F.to_date(F.lit(train_end))
    return panel.withColumn(SPLIT, F.when(in_train, TRAIN).otherwise(TEST))


def add_training_target(features: DataFrame) -> DataFrame:
    return features.withColumn("target_d", F.col("ly") - F.col("ly_l1"))


def clean_for_training(
    features: DataFrame, spec: PanelSpec = PanelSpec(), names: list[str] | None = None
) -> DataFrame:
    """Rows with all features and a target; no other step leaves rows out."""
    if names is None:
        names = [c for c in spec.feature_order if c in features.columns]
    return features.na.drop(subset=[*names, "target_d", "ly_l1", "y"])


def training_frame(
    panel: DataFrame,
    train_end: str,
    spec: PanelSpec = PanelSpec(),
    codes: CodeMaps | None = None,
) -> DataFrame:
    """Split stamp, features and target on the rows usable for fitting and scoring."""
    stamped = stamp_split(panel, train_end, spec)
    return clean_for_training(add_training_target(transform(stamped, spec, codes)), spec)


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly ``names``, in that order; absent features are an error, extras go."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"features missing from the frame: {absent}")
    return df.select(*names)


def reconstruct(ly_l1: Column, delta: Column) -> Column:
    """Log difference back to the level."""
    return F.exp(ly_l1 + delta)
