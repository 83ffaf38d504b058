"""Shape of the physical plans: what must hold when the tables are large."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise
from panelcast.operators import evaluate as E
from panelcast.operators import features as X
from panelcast.operators.baselines import forecast_ar1
from panelcast.operators.reconcile import forecast_ranked, with_total
from panelcast.plans.training import backtest_frame
from panelcast.spec import PanelSpec


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(panel):
    return materialise(panel)


def by_series(plan: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(brand#\d+, zone#\d+, \d+\)", plan))


def test_whole_backtest_shuffles_the_panel_once_by_series(stored):
    rows = E.candidate_rows(backtest_frame(stored, "2019-06-01"), ["ar1", "naive"], PanelSpec())
    plan = plan_of(rows)
    assert by_series(plan) == 1
    assert plan.count("FileScan") == 2  # the rows, and the written cross-section sums


def test_no_panel_shuffle_on_few_keys_when_totals_are_too_large_to_broadcast(spark, stored):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "-1")
        for df in (X.transform(stored), forecast_ranked(with_total(forecast_ar1(stored, "2019-06-01")))):
            plan = plan_of(df)
            assert not re.search(r"hashpartitioning\(zone#\d+, (date#\d+, )?\d+\)", plan)
            assert re.search(r"hashpartitioning\(zone#\d+, (date#\d+, )?_salt#\d+", plan)
    finally:
        spark.conf.set(conf, before)


def test_forecast_with_totals_reads_the_panel_once(stored):
    plan = plan_of(with_total(forecast_ar1(stored, "2019-06-01")))
    assert by_series(plan) == 1
    # the second scan is the scalar of the latest month
    assert plan.count("FileScan") == 2 and "Union" not in plan


def test_scoring_limits_rows_before_the_shuffle(stored):
    plan = plan_of(X.scoring_frame(stored))
    assert by_series(plan) == 1
    assert plan.count("WindowGroupLimit") == 2


def test_unused_metrics_are_not_read(stored):
    plan = plan_of(X.transform(stored).select("brand", "zone", "date", "rm6", "share_l1"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("sah" not in s and "pdo_rs" not in s for s in schemas)


def test_segment_filter_reaches_the_scan_below_the_window(stored):
    steps = X.add_training_target(X.transform(stored)).where(F.col("zone") == "east")
    assert "EqualTo(zone,east)" in plan_of(steps)
