"""Every operator as a named query over the star-schema tables.

A query takes (spark, folder of Parquet tables) and returns a DataFrame over the
whole tables. Values that went through a logarithm, an exponential or a sum of
doubles are rounded, so that engines which add in another order agree; values that
did not are left as computed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import calendar_columns, longer, standard_label
from panelcast.functions.lineage import materialise, shared_folder
from panelcast.operators import baselines as B
from panelcast.operators import (
    arima,
    attribution,
    checks,
    cleaning,
    contract,
    drift,
    encoding,
    intervals,
    learners,
    levels,
    linear,
    reconcile,
    spine,
    stats,
)
from panelcast.operators import evaluate as E
from panelcast.operators import features as X
from panelcast.plans import training
from panelcast.sources import crosstab, sinks
from panelcast.sources import panel as P
from panelcast.sources.star import (
    closed_months,
    last_closed_month,
    monthly_panel,
    read_table,
    town_panel,
)
from panelcast.spec import SPLIT, TEST, TRAIN, PanelSpec
from panelcast.streaming import labels

SPEC = PanelSpec()
HOLDOUT_MONTHS = 6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _lazy_panel(spark: SparkSession, folder: str) -> DataFrame:
    return monthly_panel(spark, folder, SPEC)


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    """All months, written: for plans with several branches."""
    return materialise(_lazy_panel(spark, folder))


def _closed(spark: SparkSession, folder: str) -> DataFrame:
    """Whole months only, for forecasts, their payloads and backtests."""
    return materialise(closed_months(_lazy_panel(spark, folder), last_closed_month(spark, folder)))


def train_end(spark: SparkSession, folder: str) -> str:
    """The holdout is the last closed months of the data."""
    last = last_closed_month(spark, folder)
    month = last.year * 12 + last.month - 1 - HOLDOUT_MONTHS
    return date(month // 12, month % 12 + 1, 1).isoformat()


def _stamped(spark: SparkSession, folder: str) -> DataFrame:
    return X.stamp_split(_panel(spark, folder), train_end(spark, folder), SPEC)


def _train_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _stamped(spark, folder).where(F.col(SPLIT) == TRAIN)


def payload(panel: DataFrame, last: date) -> DataFrame:
    """The panel up to ``last`` with one deliberate violation of each contract rule."""

    def is_(brand: str, zone: str | None = None):
        hit = F.col("brand") == brand
        return hit & (F.col("zone") == zone) if zone else hit

    in_last = F.col("date") == F.lit(last)
    copies = F.when(is_("Brand#6", "MIDDLE EAST") & in_last, F.array(F.lit(1), F.lit(2)))
    return (
        panel.where(~is_("Brand#2", "EUROPE"))
        .where(~(is_("Brand#3", "AFRICA") & (F.col("date") < F.add_months(F.lit(last), -2))))
        .withColumns(
            {
                "brand": F.when(is_("Brand#1", "ASIA"), "Brand#X").otherwise(F.col("brand")),
                "value_lakhs": F.when(is_("Brand#4", "AMERICA") & in_last, 0.0).otherwise(
                    F.col("value_lakhs")
                ),
                "sah": F.when(~(is_("Brand#5") & in_last), F.col("sah")),
                "_copy": F.explode(F.coalesce(copies, F.array(F.lit(1)))),
            }
        )
        .drop("_copy")
    )


def _payload(spark: SparkSession, folder: str) -> DataFrame:
    return payload(_closed(spark, folder), last_closed_month(spark, folder))


# Sources


@query
def panel_monthly(spark, folder):
    return _lazy_panel(spark, folder)


@query
def panel_from_files(spark, folder):
    """The panel written as text and read back."""
    path = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    _lazy_panel(spark, folder).write.option("header", True).csv(path)
    return P.read_panel(spark, path, "csv")


@query
def panel_without_total(spark, folder):
    return P.drop_total(P.with_total_rows(_panel(spark, folder), SPEC), SPEC)


@query
def labels_standardised(spark, folder):
    part = read_table(spark, folder, "part")
    messy = F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_type"), F.lit(" "))
    return part.select(
        "p_partkey",
        standard_label(messy).alias("label"),
        standard_label("p_brand").alias("brand"),
    )


@query
def crosstab_roundtrip(spark, folder):
    panel = _panel(spark, folder)
    w = X.series_window(SPEC)
    growth = panel.withColumns(
        {
            "val_growth_ya": F.col("value_lakhs") / F.lag("value_lakhs", 12).over(w) - 1.0,
            "vol_growth_ya": F.col("volume_tonnes") / F.lag("volume_tonnes", 12).over(w) - 1.0,
        }
    )
    blocks = [(m, m.upper()) for m in SPEC.metrics]
    blocks[1:1] = [("val_growth_ya", "% Grwth YA")]
    blocks[4:4] = [("vol_growth_ya", "% Grwth YA")]
    months = crosstab.months_of(panel, SPEC)
    wide = crosstab.to_crosstab(growth, blocks, months, SPEC)
    wide = wide.withColumn(" MAT TY", F.col(crosstab.month_label(months[-1])))
    kept = crosstab.drop_leakage(wide)
    flat = crosstab.flatten_crosstab(kept, [c for c, _ in blocks], SPEC)
    return crosstab.drop_leakage(flat, ["val_growth_ya", "vol_growth_ya"]).select(*SPEC.columns)


@query
def segment_subset(spark, folder):
    return P.segment_subset(_lazy_panel(spark, folder), ["ASIA", "EUROPE"], SPEC)


@query
def latest_n_months(spark, folder):
    return P.latest_months(_panel(spark, folder), 10, SPEC)


@query
def panel_profile(spark, folder):
    return P.panel_profile(_stamped(spark, folder), SPEC)


@query
def data_fingerprint(spark, folder):
    return P.data_fingerprint(_panel(spark, folder))


@query
def split_counts(spark, folder):
    return _stamped(spark, folder).groupBy(F.col(SPLIT).alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_month"),
        F.max("date").alias("last_month"),
    )


# Features

LAGS = [f"ly_l{k}" for k in range(1, SPEC.max_lag + 2)]
ROUNDED_FEATURES = ["d_l3", "rm6", "sd6", "zt_d1", "share_l1"]


@query
def calendar_features(spark, folder):
    panel = _lazy_panel(spark, folder).select(*SPEC.key)
    return panel.withColumns(calendar_columns(F.col("date"), SPEC))


@query
def lag_features(spark, folder):
    out = X.transform(_panel(spark, folder), SPEC)
    return rounded(out.select(*SPEC.key, "ly", *LAGS), ["ly", *LAGS])


@query
def momentum_features(spark, folder):
    cols = ["d_l1", "d_l2", "d_l3"]
    return rounded(X.transform(_panel(spark, folder), SPEC).select(*SPEC.key, *cols), cols)


@query
def rolling_features(spark, folder):
    cols = ["rm3", "rm6", "sd6"]
    return rounded(X.transform(_panel(spark, folder), SPEC).select(*SPEC.key, *cols), cols)


@query
def exog_lags(spark, folder):
    return X.transform(_panel(spark, folder), SPEC).select(*SPEC.key, *SPEC.exog_features)


@query
def segment_totals(spark, folder):
    totals = X.segment_totals(_panel(spark, folder), SPEC)
    return rounded(rounded(totals, ["total"], 9), ["lzt"])


@query
def cross_section_features(spark, folder):
    cols = ["zt_l1", "zt_d1", "share_l1"]
    return rounded(X.transform(_panel(spark, folder), SPEC).select(*SPEC.key, *cols), cols)


@query
def encoder_map(spark, folder):
    codes = encoding.fit_codes(_panel(spark, folder), SPEC)
    return codes.entity.select(F.lit("brand").alias("kind"), "value", "code").unionByName(
        codes.segment.select(F.lit("zone").alias("kind"), "value", "code")
    )


@query
def encoded_panel(spark, folder):
    panel = _panel(spark, folder)
    codes = encoding.fit_codes(panel, SPEC)
    return encoding.apply_codes(panel.select(*SPEC.key), codes, SPEC)


@query
def restored_codes(spark, folder):
    """A payload of one segment, with the codes of the whole vocabulary, from the model's own stages."""
    panel = _panel(spark, folder)
    stages = encoding.nominal_indexers(encoding.fit_codes(panel, SPEC), SPEC)
    rows = panel.where("zone = 'EUROPE'").select(*SPEC.key)
    for stage in stages:
        rows = stage.transform(rows)
    return rows.withColumns({c: F.col(c).cast("int") for c in SPEC.codes})


@query
def reference_snapshot(spark, folder):
    """The train rows and codes that a run leaves for drift checks, read back."""
    panel = _closed(spark, folder)
    cleaned = X.training_frame(panel, train_end(spark, folder), SPEC)
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    sinks.write_reference(encoding.apply_codes(cleaned, encoding.fit_codes(panel, SPEC), SPEC), path)
    return spark.read.parquet(path).select(*SPEC.key, "y", *SPEC.codes, "sah_l1", "num_stores_d1")


@query
def prediction_log(spark, folder):
    """A logged forecast with its totals, read back from its folders by day."""
    panel, day = _closed(spark, folder), last_closed_month(spark, folder).isoformat()
    forecast = reconcile.with_total(B.fallback_forecast(panel, SPEC), SPEC)
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    sinks.append_prediction_log(reconcile.tag(forecast, "fallback", "none", "run-1", 0), path, day)
    rows = spark.read.schema(labels.log_schema(SPEC)).json(path)
    return rounded(rounded(rows, ["pct_change"]), ["last_actual", "prediction"], 9)


@query
def metrics_log(spark, folder):
    """Metrics of two runs, appended to one table."""
    frame = materialise(_frame(spark, folder))
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    for run_id, candidate in (("run-1", "naive"), ("run-2", "ar1")):
        sinks.append_metrics(E.evaluate(frame, [candidate], SPEC), path, run_id)
    return rounded(spark.read.parquet(path), ["value"])


@query
def feature_table(spark, folder):
    panel = _panel(spark, folder)
    out = X.transform(panel, SPEC, encoding.fit_codes(panel, SPEC))
    return rounded(X.align(out, SPEC.key + SPEC.feature_order), ROUNDED_FEATURES)


@query
def training_frame(spark, folder):
    panel = _panel(spark, folder)
    out = X.training_frame(panel, train_end(spark, folder), SPEC, encoding.fit_codes(panel, SPEC))
    cols = [*SPEC.key, F.col(SPLIT).alias("split"), "y", "ly_l1", "target_d", *SPEC.feature_order]
    return rounded(out.select(*cols), ["ly_l1", "target_d", *ROUNDED_FEATURES])


@query
def part_features(spark, folder):
    """The same features on a panel of single parts, whose rows grow with the lines."""
    panel = monthly_panel(spark, folder, SPEC, entity="p_partkey")
    cols = ["rm6", "sd6", "zt_d1", "share_l1", "sah_l1", "num_stores_d1"]
    return rounded(X.transform(panel, SPEC).select(*SPEC.key, *cols), cols[:4])


@query
def series_ids(spark, folder):
    return X.transform(_panel(spark, folder), SPEC).select("series_id").groupBy("series_id").count()


@query
def target_month(spark, folder):
    return X.target_month(_closed(spark, folder), SPEC)


@query
def series_last(spark, folder):
    return X.series_last(_lazy_panel(spark, folder), SPEC)


@query
def extended_panel(spark, folder):
    return X.extended_panel(_closed(spark, folder), SPEC)


@query
def scoring_frame(spark, folder):
    panel = _closed(spark, folder)
    out = X.scoring_frame(panel, SPEC, encoding.fit_codes(panel, SPEC))
    cols = [*SPEC.series, "target_month", "ly_l1", *SPEC.feature_order]
    return rounded(out.select(*cols), ["ly_l1", *ROUNDED_FEATURES])


# Contract


@query
def history_depth(spark, folder):
    return contract.history_depth(_payload(spark, folder), SPEC)


def _summary(spark, folder) -> DataFrame:
    return contract.series_summary(_payload(spark, folder), SPEC)


@query
def contract_shallow(spark, folder):
    return contract.short_history(_summary(spark, folder), SPEC)


@query
def contract_incomplete(spark, folder):
    return contract.incomplete_segments(_summary(spark, folder), SPEC)


@query
def contract_nulls(spark, folder):
    return contract.null_counts(_summary(spark, folder), SPEC)


@query
def contract_nonpositive(spark, folder):
    return contract.nonpositive_target(_summary(spark, folder))


@query
def contract_unknown(spark, folder):
    panel = _closed(spark, folder)
    codes = encoding.fit_codes(panel, SPEC)
    summary = contract.series_summary(payload(panel, last_closed_month(spark, folder)), SPEC)
    return contract.unknown_members(summary, codes.entity, "brand").unionByName(
        contract.unknown_members(summary, codes.segment, "zone")
    )


@query
def contract_report(spark, folder):
    panel = _closed(spark, folder)
    return contract.contract_report(payload(panel, last_closed_month(spark, folder)), encoding.fit_codes(panel, SPEC), SPEC)


@query
def contract_required(spark, folder):
    """A payload without two of its columns is refused for them, before any row is read."""
    short = _closed(spark, folder).drop("sah", "str_days")
    return contract.contract_report(short, encoding.fit_codes(_closed(spark, folder), SPEC), SPEC)


@query
def contract_offenders(spark, folder):
    codes = encoding.fit_codes(_closed(spark, folder), SPEC)
    report = materialise(contract.contract_report(_payload(spark, folder), codes, SPEC))
    return contract.first_offenders(report, 3)


@query
def contract_ranges(spark, folder):
    return contract.fit_ranges(_stamped(spark, folder), SPEC)


@query
def contract_allowed(spark, folder):
    return contract.fit_allowed(_stamped(spark, folder), SPEC)


@query
def contract_range_violations(spark, folder):
    return contract.range_violations(_stamped(spark, folder), SPEC)


# Forecasts

FORECAST = ["prediction", "pct_change"]


def _forecast(df: DataFrame) -> DataFrame:
    # the last actual is exp(ln(y)): nine digits give back the stored value
    return rounded(rounded(df, ["last_actual"], 9), FORECAST)


def _ar1(spark, folder) -> DataFrame:
    return B.forecast_ar1(_closed(spark, folder), train_end(spark, folder), SPEC)


@query
def forecast_ar1(spark, folder):
    return _forecast(_ar1(spark, folder))


@query
def reconcile_total(spark, folder):
    return _forecast(reconcile.reconcile_total(_ar1(spark, folder), SPEC))


@query
def forecast_with_total(spark, folder):
    return _forecast(reconcile.with_total(_ar1(spark, folder), SPEC))


@query
def totals_with_gaps(spark, folder):
    """Totals and missing counts where some segment predictions are deliberately missing."""
    gap = (F.col("zone") == "ASIA") & F.col("brand").isin("Brand#1", "Brand#2")
    holes = _ar1(spark, folder).withColumn("prediction", F.when(~gap, F.col("prediction")))
    totals = reconcile.reconcile_total(holes, SPEC).select("brand", "target_month", "prediction")
    counts = reconcile.missing_segments(holes, SPEC)
    return rounded(totals.join(counts, ["brand", "target_month"]), ["prediction"])


@query
def forecast_ranked(spark, folder):
    ranked = reconcile.forecast_ranked(reconcile.with_total(_ar1(spark, folder), SPEC), SPEC)
    return _forecast(ranked)


@query
def forecast_summary(spark, folder):
    out = reconcile.forecast_summary(reconcile.with_total(_ar1(spark, folder), SPEC), SPEC)
    return rounded(
        rounded(out, ["total_last_actual"], 9), ["total_prediction", "total_pct_change"]
    )


@query
def fallback_forecast(spark, folder):
    rows = B.fallback_forecast(_closed(spark, folder), SPEC)
    return reconcile.tag(rows, "fallback", "none", contract_version=0)


@query
def forecast_envelope(spark, folder):
    panel = _closed(spark, folder)
    forecast = B.forecast_ar1(panel, train_end(spark, folder), SPEC)
    return rounded(checks.forecast_envelope(forecast, panel, SPEC), ["level_ratio"])


@query
def parity_diff(spark, folder):
    panel = _closed(spark, folder)
    expected = reconcile.with_total(B.forecast_ar1(panel, train_end(spark, folder), SPEC), SPEC)
    got = B.fallback_forecast(panel, SPEC)
    return rounded(reconcile.parity_diff(got, expected, SPEC), ["max_abs_diff"])


@query
def ar1_coefficients(spark, folder):
    stamped = _stamped(spark, folder).select(*SPEC.columns, SPLIT)
    steps = X.add_training_target(X.transform(stamped, SPEC))
    return rounded(B.ar1_coefficients(steps, SPEC), ["intercept", "slope"])


# Backtests


def _frame(spark, folder) -> DataFrame:
    return training.backtest_frame(_closed(spark, folder), train_end(spark, folder), SPEC)


def _test_rows(spark, folder) -> DataFrame:
    return _frame(spark, folder).where(F.col(SPLIT) == TEST)


@query
def mase_scale(spark, folder):
    cleaned = X.training_frame(_closed(spark, folder), train_end(spark, folder), SPEC)
    return rounded(E.mase_scale(cleaned, SPEC), ["scale"])


@query
def naive_backtest(spark, folder):
    return rounded(_test_rows(spark, folder).select(*SPEC.key, "y", "naive"), ["naive"], 9)


@query
def seasonal_naive(spark, folder):
    return _test_rows(spark, folder).select(*SPEC.key, "y", "seasonal_naive")


@query
def drift_walk(spark, folder):
    return rounded(_test_rows(spark, folder).select(*SPEC.key, "y", "drift"), ["drift"])


@query
def blend_forecast(spark, folder):
    rows = _test_rows(spark, folder).withColumns(
        {
            "blend_70_30": B.blend("ar1", "seasonal_naive", 0.7),
            "blend_50_50": B.blend("ar1", "seasonal_naive", 0.5),
        }
    )
    cols = ["ar1", "blend_70_30", "blend_50_50"]
    return rounded(rows.select(*SPEC.key, "y", *cols), cols)


@query
def eval_naive(spark, folder):
    return rounded(E.evaluate(_frame(spark, folder), ["naive"], SPEC), ["value"])


@query
def eval_ar1(spark, folder):
    return rounded(E.evaluate(_frame(spark, folder), ["ar1"], SPEC), ["value"])


@query
def eval_extended(spark, folder):
    candidates = ["naive", "seasonal_naive", "drift", "ar1"]
    out = E.evaluate(_frame(spark, folder), candidates, SPEC, E.EXTENDED)
    return rounded(out, ["value"])


@query
def quality_gate(spark, folder):
    metrics = E.evaluate(
        _frame(spark, folder), ["ar1", "naive"], SPEC, [*E.METRICS, E.COVERAGE]
    )
    return rounded(E.quality_gate(metrics, "ar1"), ["value"])


def _rows(spark, folder, candidates: list[str]) -> DataFrame:
    return E.candidate_rows(_test_rows(spark, folder), candidates, SPEC)


@query
def eval_with_gaps(spark, folder):
    """Metrics and coverage where a candidate deliberately lacks predictions."""
    frame = _frame(spark, folder).withColumn(
        "partial", F.when(F.col("zone") != "ASIA", F.col("ar1"))
    )
    metrics = [*E.METRICS, E.COVERAGE]
    out = E.evaluate(frame, ["partial", "naive"], SPEC, metrics)
    return rounded(out, ["value"])


@query
def beats_naive(spark, folder):
    out = E.beats_naive(_rows(spark, folder, ["ar1", "naive"]), "ar1", spec=SPEC)
    return rounded(out, ["value_share_pct"])


@query
def monthly_bias(spark, folder):
    out = E.monthly_bias(_rows(spark, folder, ["ar1", "naive"]), SPEC)
    return rounded(rounded(out, ["actual"], 9), ["forecast", "error_pct"])


@query
def entity_wmape(spark, folder):
    return rounded(
        E.entity_wmape(_rows(spark, folder, ["ar1", "naive"]), SPEC), ["zone_wmape"]
    )


ARIMA = {
    "arima_111": arima.Order(1, 1),
    "arima_212": arima.Order(2, 2),
    "sarima": arima.Order(1, 1, seasonal=1),
}


def _arima(spark, folder) -> DataFrame:
    panel = _closed(spark, folder)
    return arima.arima_backtest(panel, train_end(spark, folder), ARIMA, SPEC)


@query
def arima_backtest(spark, folder):
    end = F.to_date(F.lit(train_end(spark, folder)))
    rows = _arima(spark, folder).where(F.col("date") > end).drop("ly_l1")
    return rounded(rows, list(ARIMA))


@query
def arima_coefficients(spark, folder):
    steps = arima.log_steps(_closed(spark, folder), SPEC)
    in_fit = F.col("date") <= F.to_date(F.lit(train_end(spark, folder)))
    fits = arima.arma(steps, SPEC.series, "date", ARIMA["arima_212"], in_fit)
    names = ["constant", "ar1", "ar2", "ma1", "ma2"]
    one = fits.groupBy(*SPEC.series).agg(F.max("n_fit").alias("n_fit"), F.max("coefficients").alias("c"))
    values = {name: F.get("c", F.lit(i)) for i, name in enumerate(names)}
    return rounded(one.withColumns(values).drop("c"), names)


@query
def eval_arima(spark, folder):
    levels = _arima(spark, folder).drop("y", "ly_l1")
    rows = _frame(spark, folder).join(levels, SPEC.key, "left")
    out = E.evaluate(rows, [*ARIMA, "naive"], SPEC, [*E.METRICS, E.COVERAGE])
    return rounded(out, ["value"])


@query
def arima_refitted(spark, folder):
    """Every holdout month from a fit on all months before it."""
    first = date.fromisoformat(train_end(spark, folder))
    months = [first.year * 12 + first.month + i for i in range(HOLDOUT_MONTHS)]
    origins = [date(m // 12, m % 12 + 1, 1).isoformat() for m in months]
    out = arima.arima_refitted(_closed(spark, folder), origins, ARIMA["arima_111"], SPEC)
    return rounded(out, ["prediction"])


@query
def forecast_sarima(spark, folder):
    out = arima.forecast_arima(_closed(spark, folder), train_end(spark, folder), ARIMA["sarima"], SPEC)
    return _forecast(reconcile.with_total(out, SPEC))


@query
def cv_folds(spark, folder):
    train = _frame(spark, folder).where(F.col(SPLIT) == TRAIN).select(*SPEC.key)
    return E.fold_sizes(E.expanding_folds(train, train_end(spark, folder), spec=SPEC), SPEC)


@query
def cv_selection_naive(spark, folder):
    out = training.cross_validate(
        _frame(spark, folder), train_end(spark, folder), ["naive", "seasonal_naive", "drift"], spec=SPEC
    )
    return rounded(out, ["cv_wmape"])


# Learners. The number of trees is a parameter; these keep it small.
TREES = 60


def _gbt(codes):
    return learners.boosted_trees(codes, SPEC, maxIter=TREES, stepSize=0.1)


@query
def backtest_gbt(spark, folder):
    run = training.train_and_backtest(_closed(spark, folder), train_end(spark, folder), _gbt, SPEC, "gbt")
    return run.metrics


@query
def backtest_linear(spark, folder):
    panel = _closed(spark, folder)
    codes = encoding.fit_codes(panel, SPEC)
    frame = materialise(training.backtest_frame(panel, train_end(spark, folder), SPEC))
    train = learners.fit_order(frame.where(F.col(SPLIT) == TRAIN), SPEC)
    scored = frame.where(F.col(SPLIT) == TEST)
    for name, lasso in (("ridge", False), ("lasso", True)):
        model = learners.linear(codes, SPEC, lasso=lasso).fit(train)
        scored = learners.predict_level(model, scored, name)
    return E.evaluate(scored, ["ridge", "lasso", "naive"], SPEC, E.EXTENDED)


@query
def backtest_rf(spark, folder):
    run = training.train_and_backtest(
        _closed(spark, folder),
        train_end(spark, folder),
        lambda codes: learners.random_forest(codes, SPEC, numTrees=TREES, maxDepth=6),
        SPEC,
        "rf",
    )
    return run.metrics


SEARCH = {"maxDepth": [2, 3], "minInstancesPerNode": [5, 20]}


def _small_gbt(codes, **params):
    return learners.boosted_trees(codes, SPEC, **{"maxIter": 5, "stepSize": 0.1, **params})


@query
def random_search(spark, folder):
    """Draws of settings on the folds: how many were compared on how many folds, and chosen."""
    panel = _closed(spark, folder)
    frame = materialise(training.backtest_frame(panel, train_end(spark, folder), SPEC))
    codes = encoding.fit_codes(panel, SPEC)
    out = training.random_search(frame, train_end(spark, folder), _small_gbt, codes, SEARCH, draws=3)
    return out.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.min("n_folds").alias("n_folds"),
        F.count_if("selected").alias("n_selected"),
        F.count_if(F.col("selected") & (F.col("cv_wmape") == out.agg(F.min("cv_wmape")).scalar())).alias("n_best"),
    )


@query
def seed_stability(spark, folder):
    """How far the holdout metrics move over seeds, a row for each metric."""
    panel = _closed(spark, folder)
    frame = materialise(training.backtest_frame(panel, train_end(spark, folder), SPEC))
    out = training.seed_stability(frame, _small_gbt, encoding.fit_codes(panel, SPEC), (1, 2, 3))
    spread = F.col("max_value") - F.col("min_value")
    # seeds change which rows a tree sees, so they move each metric, but not by much
    return out.select("metric", "n_seeds", ((spread > 0) & (spread < 0.2 * F.col("max_value"))).alias("is_stable"))


CV_LEARNERS = {
    "gbt": _small_gbt,
    "rf": lambda codes: learners.random_forest(codes, SPEC, numTrees=10, maxDepth=5),
    "ridge": lambda codes: learners.linear(codes, SPEC),
}


def _cv_table(spark, folder) -> DataFrame:
    panel = _closed(spark, folder)
    frame = materialise(training.backtest_frame(panel, train_end(spark, folder), SPEC))
    blends = {"gbt_70_ar1_30": ("gbt", "ar1", 0.7), "ar1_50_seasonal_50": ("ar1", "seasonal_naive", 0.5)}
    return training.cross_validate_learners(
        frame, train_end(spark, folder), CV_LEARNERS, encoding.fit_codes(panel, SPEC),
        ("naive", "seasonal_naive", "drift"), blends, spec=SPEC,
    )


@query
def cv_learners(spark, folder):
    """The one table from which a candidate is chosen: learners, blends, baselines."""
    return _cv_table(spark, folder)


@query
def cv_learners_checked(spark, folder):
    """The same, as far as it does not depend on a fit: baselines have the errors they have alone."""
    table = materialise(_cv_table(spark, folder))
    baseline = F.col("candidate").isin("naive", "seasonal_naive", "drift")
    least = table.agg(F.min("cv_wmape")).scalar()
    return rounded(
        table.select(
            "candidate",
            "n_folds",
            F.when(baseline, F.col("cv_wmape")).alias("cv_wmape"),
            (F.col("selected") == (F.col("cv_wmape") == least)).alias("chosen_by_error"),
        ),
        ["cv_wmape"],
    )


@query
def forecast_gbt(spark, folder):
    panel = _closed(spark, folder)
    run = training.train_and_backtest(panel, train_end(spark, folder), _gbt, SPEC, "gbt")
    return reconcile.with_total(learners.forecast_model(panel, run.model, SPEC), SPEC)


@query
def gbt_invariants(spark, folder):
    """What must hold of boosted trees whatever the fit: one row per check."""
    panel = _closed(spark, folder)
    run = training.train_and_backtest(panel, train_end(spark, folder), _gbt, SPEC, "gbt")
    forecast = materialise(reconcile.with_total(learners.forecast_model(panel, run.model, SPEC), SPEC))
    is_total = F.col("zone") == SPEC.total_label
    sums = forecast.groupBy("brand").agg(
        F.sum(F.when(is_total, F.col("prediction"))).alias("total"),
        F.sum(F.when(~is_total, F.col("prediction"))).alias("parts"),
    )
    rows = forecast.agg(
        F.count(F.lit(1)).cast("double").alias("n_forecasts"),
        F.count_if(F.col("prediction") > 0).cast("double").alias("n_positive"),
    )
    gaps = sums.agg(
        F.count_if(F.abs(F.col("total") / F.col("parts") - 1) > 1e-9).cast("double").alias("n_gaps")
    )
    weights = learners.split_importance(run.model, SPEC).agg(
        F.round(F.sum("importance"), 9).alias("importance"),
        F.count(F.lit(1)).cast("double").alias("n_features"),
    )
    naive = run.metrics.where("candidate = 'naive' AND value IS NOT NULL")
    checks_ = [
        longer(one, [], one.columns, "name", "value") for one in (rows, gaps, weights)
    ] + [naive.select(F.concat(F.lit("naive_"), "metric").alias("name"), F.round("value", 6).alias("value"))]
    out = checks_[0]
    for one in checks_[1:]:
        out = out.unionByName(one)
    return out


@query
def gbt_gate(spark, folder):
    """The gate of a whole run: its limits, and that each verdict follows from its value."""
    run = training.train_and_backtest(_closed(spark, folder), train_end(spark, folder), _gbt, SPEC, "gbt")
    value, threshold = F.col("value"), F.col("threshold")
    follows = (
        F.when(F.col("gate") == "naive_rel_mase", value < threshold)
        .when(F.col("gate") == "coverage", value >= threshold)
        .otherwise(value <= threshold)
    )
    return run.gate.select("gate", "threshold", (F.col("passed") == follows).alias("follows"))


@query
def rf_invariants(spark, folder):
    """A forest averages train targets: no prediction leaves their range, and importances sum to 1."""
    panel, end = _closed(spark, folder), train_end(spark, folder)
    run = training.train_and_backtest(
        panel, end, lambda codes: learners.random_forest(codes, SPEC, numTrees=TREES, maxDepth=6), SPEC, "rf"
    )
    span = run.frame.where(F.col(SPLIT) == TRAIN).agg(F.struct(F.min("target_d").alias("lo"), F.max("target_d").alias("hi")))
    step = F.ln(F.col("rf")) - F.col("ly_l1")
    rows = run.test.select(step.alias("step"), span.scalar().alias("span"))
    inside = (F.col("step") >= F.col("span.lo") - 1e-9) & (F.col("step") <= F.col("span.hi") + 1e-9)
    weights = learners.split_importance(run.model, SPEC).agg(F.round(F.sum("importance"), 9)).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(inside).alias("n_inside"), weights.alias("importance")
    )


@query
def feature_importance(spark, folder):
    run = training.train_and_backtest(_closed(spark, folder), train_end(spark, folder), _gbt, SPEC, "gbt")
    gain = learners.permutation_importance(run.model, run.test, SPEC)
    return learners.split_importance(run.model, SPEC).join(gain, "feature")


# Intervals, drift, levels, calendar

INTERVAL = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def _intervals(spark, folder) -> DataFrame:
    panel, end = _closed(spark, folder), train_end(spark, folder)
    errors = intervals.fold_errors(panel, end, arima.Order(1), SPEC)
    quantiles = intervals.error_quantiles(errors, ["brand"], list(INTERVAL.values()))
    rows = arima.arima_backtest(panel, end, {"prediction": arima.Order(1)}, SPEC)
    holdout = rows.where(F.col("date") > F.to_date(F.lit(end))).drop("ly_l1")
    return intervals.with_intervals(holdout, quantiles, ["brand"], list(INTERVAL))


@query
def prediction_intervals(spark, folder):
    return rounded(_intervals(spark, folder), ["prediction", *INTERVAL])


@query
def interval_scores(spark, folder):
    out = intervals.interval_scores(_intervals(spark, folder), INTERVAL, ["zone"])
    return rounded(out, ["value"])


def _reference_and_holdout(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The snapshot of the train rows, as a training run writes it, and the rows after them."""
    cleaned = materialise(X.training_frame(_closed(spark, folder), train_end(spark, folder), SPEC))
    path = f"{shared_folder(spark)}/reference-{uuid.uuid4().hex}"
    sinks.write_reference(cleaned, path)
    return spark.read.parquet(path), cleaned.where(F.col(SPLIT) == TEST)


@query
def drift_holdout(spark, folder):
    """The reference's histogram is merged from those of two parts."""
    reference, holdout = _reference_and_holdout(spark, folder)
    festive = F.month("date").isin(*SPEC.festive_months)
    parts = [drift.histograms(reference.where(c), SPEC.numeric_features) for c in (festive, ~festive)]
    out = drift.drift(drift.merge(*parts), drift.histograms(holdout, SPEC.numeric_features))
    return rounded(out, ["psi", "max_gap"])


@query
def drift_shifted(spark, folder):
    reference, holdout = _reference_and_holdout(spark, folder)
    moved = holdout.withColumns(
        {
            "num_stores_l1": F.col("num_stores_l1") * 1.5,
            "sah_d1": -F.col("sah_d1") - 1.0,
            "str_days_l1": F.when(F.col("zone") != "ASIA", F.col("str_days_l1")),
        }
    )
    names = SPEC.numeric_features
    out = drift.drift(drift.histograms(reference, names), drift.histograms(moved, names))
    return rounded(out, ["psi", "max_gap"])


LEVELS = {"town": ["brand", "zone", "town"], "zone": ["brand", "zone"], "brand": ["brand"], "all": []}


def _lattice(spark, folder) -> DataFrame:
    """Actuals and persistence of every town, summed at four levels."""
    towns = town_panel(spark, folder, SPEC)
    w = Window.partitionBy("brand", "zone", "town").orderBy("date")
    rows = towns.withColumn("naive", F.lag("value_lakhs", 1).over(w))
    return levels.lattice(rows, LEVELS, ["value_lakhs", "naive"], ["date"])


@query
def level_lattice(spark, folder):
    return rounded(_lattice(spark, folder), ["value_lakhs", "naive"], 9)


@query
def level_coherence(spark, folder):
    table = materialise(_lattice(spark, folder))
    rows = [
        levels.coherence(table, LEVELS, m, ["date"]).withColumn("measure", F.lit(m))
        for m in ("value_lakhs", "naive")
    ]
    return rounded(rows[0].unionByName(rows[1]), ["max_relative_gap"], 9)


def _with_gaps(spark, folder) -> DataFrame:
    """The panel without some months of its series."""
    return _panel(spark, folder).where((F.month("date") * 7 + F.length("brand")) % 5 != 0)


@query
def densified_panel(spark, folder):
    dense = spine.densify(_with_gaps(spark, folder), SPEC)
    return dense.select(*SPEC.key, "value_lakhs", "is_gap", "gap_length")


@query
def gap_report(spark, folder):
    return spine.gap_report(_with_gaps(spark, folder), SPEC)


@query
def calendar_lags(spark, folder):
    """Lags by calendar month beside the positional one."""
    w = X.series_window(SPEC)
    rows = _with_gaps(spark, folder).withColumn("row_before", F.lag("value_lakhs", 1).over(w))
    out = spine.calendar_lags(rows, "value_lakhs", [1, 2, 12], SPEC)
    return out.select(*SPEC.key, "row_before", *[f"value_lakhs_m{k}" for k in (1, 2, 12)])


def _months_before(day: date, n: int) -> date:
    month = day.year * 12 + day.month - 1 - n
    return date(month // 12, month % 12 + 1, 1)


def _realised(spark, folder) -> DataFrame:
    """Two runs of persistence, the first logged twice, collected as they come."""
    panel, last = _closed(spark, folder), last_closed_month(spark, folder)
    root = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    for back in (1, 0, 1):
        month = _months_before(last, back)
        run = B.fallback_forecast(closed_months(panel, month), SPEC)
        tagged = reconcile.tag(run, "fallback", "none", f"run-{month}", contract_version=0)
        sinks.append_prediction_log(tagged, f"{root}/log", month.isoformat())
        labels.collect_log(spark, f"{root}/log", f"{root}/store", f"{root}/checkpoint")
    return labels.realised_errors(labels.collected(spark, f"{root}/store"), panel)


@query
def realised_errors(spark, folder):
    return rounded(_realised(spark, folder), ["error_pct"])


@query
def realised_summary(spark, folder):
    return rounded(labels.error_summary(_realised(spark, folder)), ["wmape", "bias_pct"])


def _part_steps(spark, folder) -> DataFrame:
    """Log steps of every part, with the mean step of the part in the other folds of the train rows."""
    panel = monthly_panel(spark, folder, SPEC, "p_partkey")
    steps = arima.log_steps(closed_months(panel, last_closed_month(spark, folder)), SPEC)
    before = F.lag("step", 1).over(X.series_window(SPEC)).alias("step_l1")
    rows = X.stamp_split(steps.select(*SPEC.key, "step", before), train_end(spark, folder), SPEC)
    rows = materialise(rows.where("step IS NOT NULL"))
    train = rows.where(F.col(SPLIT) == TRAIN)
    fold = (F.year("date") * 12 + F.month("date")) % 5
    table = encoding.target_encoding(train, "brand", "step", fold)
    own = F.when(F.col(SPLIT) == TRAIN, fold).otherwise(encoding.NEW_ROWS)
    return encoding.apply_target_encoding(rows, table, "brand", "encoded", own)


@query
def part_encoding(spark, folder):
    return rounded(_part_steps(spark, folder).select(*SPEC.key, "encoded"), ["encoded"], 9)


@query
def part_ridge(spark, folder):
    """A fit over all parts whose vocabulary is a table, never a list."""
    train = _part_steps(spark, folder).where(F.col(SPLIT) == TRAIN)
    inputs = ["encoded", "step_l1"]
    fit = linear.ridge(materialise(train.select("step", *inputs)), "step", inputs, 0.01)
    names = {"encoded": F.get("slopes", F.lit(0)), "step_l1": F.get("slopes", F.lit(1))}
    return rounded(fit.withColumns(names).drop("slopes"), ["intercept", *names])


@query
def attribution_identity(spark, folder):
    """Contributions of all inputs and the base sum to each row's prediction."""
    run = training.train_and_backtest(_closed(spark, folder), train_end(spark, folder), _gbt, SPEC, "gbt")
    parts = attribution.contributions(run.model, run.test, SPEC)
    sums = parts.groupBy(*SPEC.key).agg(F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("n"))
    step = F.ln(F.col("gbt")) - F.col("ly_l1")
    rows = run.test.select(*SPEC.key, step.alias("step")).join(sums, SPEC.key)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("n").alias("n_parts"),
        F.count_if(F.abs(F.col("total") - F.col("step")) > 1e-9).alias("n_off"),
    )


@query
def attribution_summary(spark, folder):
    """Mean size of each input's contribution on the holdout."""
    run = training.train_and_backtest(_closed(spark, folder), train_end(spark, folder), _gbt, SPEC, "gbt")
    parts = attribution.contributions(run.model, run.test, SPEC)
    return parts.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_size"), F.avg("contribution").alias("mean")
    )


# Statistics and cleaning


@query
def imputed_panel(spark, folder):
    quarter_end = F.month("date").isin(3, 6, 9, 12)
    holes = _stamped(spark, folder).withColumn(
        "str_days", F.when(~quarter_end, F.col("str_days"))
    )
    out = cleaning.impute(holes, ["str_days", "sah"], SPEC)
    return out.select(*SPEC.key, "str_days", "sah")


@query
def capped_exog(spark, folder):
    return cleaning.cap_exog(_stamped(spark, folder), 3.0, SPEC).select(*SPEC.key, *SPEC.exog)


@query
def target_outlier_flags(spark, folder):
    flagged = cleaning.flag_target(_stamped(spark, folder), 1.5, SPEC)
    return cleaning.flags_by_month(flagged, SPEC)


@query
def scaled_features(spark, folder):
    cleaned = X.training_frame(_panel(spark, folder), train_end(spark, folder), SPEC)
    names = SPEC.numeric_features
    return rounded(cleaning.scale_features(cleaned, names).select(*SPEC.key, *names), names)


@query
def concentration(spark, folder):
    out = stats.concentration(_train_rows(spark, folder), SPEC)
    return rounded(rounded(out, ["value"], 9), ["share", "cum_share", "hhi"])


@query
def seasonality_index(spark, folder):
    out = stats.seasonality_index(_train_rows(spark, folder), SPEC)
    return rounded(out, ["mean", "idx"])


@query
def series_volatility(spark, folder):
    out = stats.series_volatility(_train_rows(spark, folder), SPEC)
    return rounded(out, ["sd_step", "cv"])


@query
def series_swing(spark, folder):
    return stats.series_swing(_panel(spark, folder), SPEC)


@query
def anova_segment(spark, folder):
    out = stats.anova(_train_rows(spark, folder), "zone", "value_lakhs")
    return rounded(out, ["f_stat"])


@query
def kruskal_month(spark, folder):
    out = stats.kruskal(_train_rows(spark, folder), F.month("date"), "value_lakhs")
    return rounded(out, ["h_stat"])


@query
def welch_festive(spark, folder):
    festive = F.month("date").isin(*SPEC.festive_months)
    out = stats.welch(_train_rows(spark, folder), festive, "value_lakhs")
    return rounded(out, ["mean_first", "mean_second", "t_stat", "df"])


@query
def dickey_fuller(spark, folder):
    out = stats.dickey_fuller(_train_rows(spark, folder), SPEC)
    return rounded(out, ["t_level", "t_diff"])


@query
def augmented_dickey_fuller(spark, folder):
    out = stats.augmented_dickey_fuller(_train_rows(spark, folder), (1, 2, 3), SPEC)
    return rounded(out, ["t_level", "t_diff"])


def _clean_train(spark, folder, panel: DataFrame | None = None) -> DataFrame:
    """Written, for sums that read it twice."""
    panel = _panel(spark, folder) if panel is None else panel
    cleaned = X.training_frame(panel, train_end(spark, folder), SPEC)
    return materialise(cleaned.where(F.col(SPLIT) == TRAIN))


@query
def feature_correlation(spark, folder):
    out = stats.correlations(_clean_train(spark, folder), SPEC.numeric_features)
    return rounded(out, ["corr"])


@query
def feature_vif(spark, folder):
    return rounded(linear.vif(_clean_train(spark, folder), SPEC.numeric_features), ["vif"])


@query
def feature_rank(spark, folder):
    """The degenerate trio has rank 2 of 3; the model's inputs are independent."""
    train = _clean_train(spark, folder)
    trio = linear.rank(train, ["d_l1", "d_l2", "rm3"])
    inputs = linear.rank(train, SPEC.numeric_features)
    return (
        trio.withColumn("design", F.lit("momentum"))
        .unionByName(inputs.withColumn("design", F.lit("inputs")))
        .select("design", "n_rows", "n_columns", "rank")
    )


RIDGE_PENALTY = 0.1


def _ridge(spark, folder, panel: DataFrame | None = None) -> DataFrame:
    return linear.ridge(_clean_train(spark, folder, panel), "target_d", SPEC.numeric_features, RIDGE_PENALTY)


@query
def ridge_coefficients(spark, folder):
    names = ["intercept", *SPEC.numeric_features]
    values = F.concat(F.array("intercept"), F.col("slopes"))
    entries = F.transform(
        F.arrays_zip(F.lit(names).alias("feature"), values.alias("value")),
        lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")),
    )
    return rounded(_ridge(spark, folder).select(F.inline(entries)), ["value"], 6)


@query
def ridge_backtest(spark, folder):
    """Ridge in closed form, on the holdout; one panel serves the fit and the frame."""
    panel = _panel(spark, folder)
    fit = F.struct("intercept", "slopes")
    beta = materialise(_ridge(spark, folder, panel)).select(fit.alias("fit")).scalar()
    xs = [F.col(c) for c in SPEC.numeric_features]
    closed = closed_months(panel, last_closed_month(spark, folder))
    scored = training.backtest_frame(closed, train_end(spark, folder), SPEC).withColumn("_fit", beta)
    delta = linear.predicted(F.col("_fit"), xs)
    scored = scored.withColumn("ridge", X.reconstruct(F.col("ly_l1"), delta))
    return rounded(E.evaluate(scored, ["ridge", "naive"], SPEC, [*E.METRICS, E.COVERAGE]), ["value"])


@query
def additivity_check(spark, folder):
    out = reconcile.additivity(P.with_total_rows(_panel(spark, folder), SPEC), SPEC)
    return rounded(out, ["max_relative_error"], 9)


# Leakage and identities


@query
def degeneracy_check(spark, folder):
    out = checks.degeneracy(X.transform(_panel(spark, folder), SPEC))
    return rounded(out, ["max_abs_gap"], 9)


@query
def warmup_nulls(spark, folder):
    return checks.warmup_nulls(X.transform(_panel(spark, folder), SPEC), SPEC)


@query
def leakage_perturbation(spark, folder):
    out = checks.leakage_perturbation(_panel(spark, folder), SPEC)
    return rounded(out, ["max_abs_diff"], 9)


@query
def leakage_equality(spark, folder):
    features = X.transform(_panel(spark, folder), SPEC)
    return checks.leakage_equality(features, SPEC.numeric_features, SPEC.metrics)


@query
def leakage_shift(spark, folder):
    out = checks.leakage_shift(X.transform(_panel(spark, folder), SPEC), SPEC)
    return rounded(out, ["max_abs_gap"], 9)


@query
def partial_segment_effect(spark, folder):
    out = checks.partial_segment_effect(_panel(spark, folder), "Brand#13", SPEC)
    return rounded(out, ["max_abs_gap"])
