"""The log as a stream: restarts, repeats, actuals that are not there yet."""

from __future__ import annotations

from datetime import date

import pytest

from panelcast.operators.reconcile import tag
from panelcast.sources.sinks import append_prediction_log
from panelcast.streaming import labels

FORECAST = "brand string, zone string, target_month date, last_actual double, prediction double, pct_change double"
NEXT, LATER = date(2020, 2, 1), date(2020, 3, 1)


def log(spark, folder, day, run, rows):
    forecast = spark.createDataFrame([(b, "east", m, 1.0, p, None) for b, m, p in rows], FORECAST)
    append_prediction_log(tag(forecast, "model", "v1", run), f"{folder}/log", day)


def collect(spark, folder):
    labels.collect_log(spark, f"{folder}/log", f"{folder}/store", f"{folder}/checkpoint")
    rows = labels.collected(spark, f"{folder}/store").collect()
    return sorted((r["run_id"], r["brand"], r["target_month"], r["prediction"]) for r in rows)


def test_a_restart_goes_on_and_repeats_count_once(spark, tmp_path):
    log(spark, tmp_path, "2020-01-31", "r1", [("a", NEXT, 10.0), ("b", NEXT, 20.0)])
    first = [("r1", "a", NEXT, 10.0), ("r1", "b", NEXT, 20.0)]
    assert collect(spark, tmp_path) == first
    assert collect(spark, tmp_path) == first  # nothing new
    stored = spark.read.parquet(f"{tmp_path}/store").count()
    assert stored == 2
    log(spark, tmp_path, "2020-02-03", "r1", [("a", NEXT, 10.0)])  # logged again
    log(spark, tmp_path, "2020-02-28", "r2", [("a", LATER, 11.0), ("a", LATER, 11.0), ("c", LATER, None)])
    second = [("r2", "a", LATER, 11.0), ("r2", "c", LATER, None)]
    assert collect(spark, tmp_path) == first + second
    assert spark.read.parquet(f"{tmp_path}/store").count() == 4
    # another stream over the same log, with a checkpoint of its own, finds the same rows
    labels.collect_log(spark, f"{tmp_path}/log", f"{tmp_path}/other", f"{tmp_path}/other-checkpoint")
    assert labels.collected(spark, f"{tmp_path}/other").count() == 4


def test_errors_of_what_has_happened(spark, tmp_path):
    log(spark, tmp_path, "2020-01-31", "r1", [("a", NEXT, 11.0), ("b", NEXT, 30.0), ("c", NEXT, None), ("d", NEXT, 5.0)])
    labels.collect_log(spark, f"{tmp_path}/log", f"{tmp_path}/store", f"{tmp_path}/checkpoint")
    actuals = spark.createDataFrame(
        [("a", "east", NEXT, 10.0), ("b", "east", NEXT, 40.0), ("c", "east", NEXT, 7.0), ("a", "east", LATER, 1.0)],
        "brand string, zone string, date date, value_lakhs double",
    )
    errors = labels.realised_errors(labels.collected(spark, f"{tmp_path}/store"), actuals)
    got = {r["brand"]: r["error_pct"] for r in errors.collect()}
    assert got == {"a": pytest.approx(10.0), "b": pytest.approx(-25.0), "c": None, "d": None}
    one = labels.error_summary(errors).first()
    assert (one["n_forecasts"], one["n_open"]) == (4, 1)
    assert one["wmape"] == pytest.approx(100 * 11 / 50) and one["bias_pct"] == pytest.approx(100 * (41 / 50 - 1))
