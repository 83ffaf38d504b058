"""Metrics, gate, folds and baselines on numbers small enough to work out."""

from __future__ import annotations

import math
from datetime import date

import pytest
from conftest import MONTHS, SPEC, frame, make_rows
from pyspark.sql import functions as F

from panelcast.operators import baselines as B
from panelcast.operators import evaluate as E
from panelcast.operators import features as X
from panelcast.plans import training

ROWS = "brand string, zone string, date date, y double, p double, scale double, __split string"


def scored(spark):
    d1, d2 = date(2020, 1, 1), date(2020, 2, 1)
    data = [
        ("a", "e", d1, 10.0, 12.0, 2.0, "test"),
        ("a", "w", d1, 20.0, 18.0, 4.0, "test"),
        ("a", "e", d2, 10.0, 10.0, 2.0, "test"),
        ("b", "e", d2, 5.0, 8.0, None, "test"),
        ("b", "e", d1, 99.0, 1.0, 1.0, "train"),
    ]
    return spark.createDataFrame(data, ROWS)


def metrics(spark, names=E.EXTENDED):
    return {r["metric"]: r["value"] for r in E.evaluate(scored(spark), ["p"], SPEC, names).collect()}


def test_metrics_at_both_grains(spark):
    got = metrics(spark)
    assert got["zone_wmape"] == pytest.approx(100 * 7 / 45)
    # the two errors of entity a cancel in the total
    assert got["ai_brand_wmape"] == pytest.approx(100 * 3 / 45)
    # the series without a scale is skipped, not counted as zero
    assert got["mase"] == pytest.approx((1.0 + 0.5 + 0.0) / 3)
    assert got["mape"] == pytest.approx(100 * (0.2 + 0.1 + 0.0 + 0.6) / 4)
    mean = 45 / 4
    sst = sum((y - mean) ** 2 for y in (10, 20, 10, 5))
    assert got["r2"] == pytest.approx(1 - 17 / sst)

MONTH_ONE = date(2020, 1, 1)


def gate(spark, model, naive):
    data = [("m", k, v) for k, v in model.items()] + [("naive", k, v) for k, v in naive.items()]
    long = spark.createDataFrame(data, "candidate string, metric string, value double")
    return {r["gate"]: (r["value"], r["passed"]) for r in E.quality_gate(long, "m").collect()}


def test_gate_boundaries(spark):
    naive = {"ai_brand_wmape": 7.5, "mase": 1.5, "coverage": 1.0}
    got = gate(spark, {"ai_brand_wmape": 6.0, "mase": 1.5, "coverage": 1.0}, naive)
    assert got == {
        "ai_brand_wmape": (6.0, True),
        "vs_naive": (0.8, True),
        "naive_rel_mase": (1.0, False),
        "coverage": (1.0, True),
    }


def test_a_candidate_that_picks_its_rows_is_compared_on_them_and_fails_the_gate(spark):
    rows = scored(spark).where("__split = 'test'").withColumn("naive", F.col("y") * 1.5)
    picky = rows.withColumn("picky", F.when(F.col("brand") == "b", F.col("y") * 1.01))
    metrics = E.evaluate(picky, ["picky", "naive"], SPEC, [*E.METRICS, E.COVERAGE])
    got = {(r["candidate"], r["metric"]): r["value"] for r in metrics.collect()}
    share = rows.where("brand = 'b'").count() / rows.count()
    assert got["picky", "coverage"] == pytest.approx(share) and got["naive", "coverage"] == 1.0
    # both on the rows that both predict
    assert got["picky", "zone_wmape"] == pytest.approx(1.0)
    assert got["naive", "zone_wmape"] == pytest.approx(50.0)
    gates = {r["gate"]: r["passed"] for r in E.quality_gate(metrics, "picky").collect()}
    assert gates["vs_naive"] and not gates["coverage"]


def test_squared_error_keeps_its_digits_far_from_zero(spark):
    base = 1e9
    data = [("a", "e", MONTH_ONE, base + i, base + i + 0.5 * (-1) ** i, 1.0) for i in range(10)]
    rows = spark.createDataFrame(
        data, "brand string, zone string, date date, y double, pred double, scale double"
    ).withColumns({"candidate": F.lit("p"), "covered": F.lit(True)})
    got = E.score(rows).head()
    assert got["r2"] == pytest.approx(1 - 10 * 0.25 / 82.5, rel=1e-9)


def test_gate_without_a_value_does_not_pass(spark):
    got = gate(spark, {"ai_brand_wmape": 1.0}, {"ai_brand_wmape": 7.5, "mase": 1.5})
    assert got["naive_rel_mase"] == (None, False)


def test_scale_on_rows_equals_the_aggregate(panel):
    cleaned = X.training_frame(panel, "2019-06-01")
    table = {(r["brand"], r["zone"]): r["scale"] for r in E.mase_scale(cleaned).collect()}
    on_rows = E.with_scale(cleaned).groupBy("brand", "zone").agg(
        F.min("scale").alias("lo"), F.max("scale").alias("hi")
    )
    for r in on_rows.collect():
        assert r["lo"] == r["hi"] == pytest.approx(table[r["brand"], r["zone"]])


def test_one_train_row_has_no_scale(spark):
    cleaned = X.training_frame(frame(spark, make_rows(months=MONTHS[:9])), "2018-05-01")
    assert {r["scale"] for r in E.mase_scale(cleaned).collect()} == {None}


def test_baselines(spark):
    rows = [r for r in make_rows() if r["brand"] == "amber" and r["zone"] == "east"]
    y = [r["value_lakhs"] for r in rows]
    got = B.with_baselines(X.transform(frame(spark, rows))).orderBy("date").collect()
    for t, r in enumerate(got):
        assert r["naive"] == (pytest.approx(y[t - 1]) if t else None)
        assert r["seasonal_naive"] == (y[t - 12] if t >= 12 else None)
        want = y[t - 1] + (y[t - 1] - y[0]) / (t - 1) if t >= 2 else None
        assert r["drift"] == (pytest.approx(want) if want else None)


def test_ar1_fit_uses_train_rows_only_and_agrees_everywhere(spark, rows):
    end = "2019-06-01"
    panel = frame(spark, rows)
    cut = frame(spark, [r for r in rows if r["date"] <= date(2019, 6, 1)])

    def coefficients(p):
        steps = X.add_training_target(X.transform(X.stamp_split(p, end)))
        return {(r["brand"], r["zone"]): r for r in B.ar1_coefficients(steps).collect()}

    full = coefficients(panel)
    for key, r in coefficients(cut).items():
        assert r["slope"] == pytest.approx(full[key]["slope"], abs=1e-12)
    steps = X.add_training_target(X.transform(X.stamp_split(panel, end)))
    for r in B.with_ar1(steps).where("ar1 IS NOT NULL").collect():
        c = full[r["brand"], r["zone"]]
        level = r["ly_l1"] + c["intercept"] + c["slope"] * r["d_l1"]
        assert r["ar1"] == pytest.approx(math.exp(level))


def test_forecast_ar1_is_the_next_row_of_the_backtest(panel):
    got = B.forecast_ar1(panel, "2019-06-01").collect()
    steps = X.add_training_target(X.transform(X.stamp_split(X.extended_panel(panel), "2019-06-01")))
    want = {
        (r["brand"], r["zone"]): r["ar1"]
        for r in B.with_ar1(steps).where("date = DATE '2020-01-01'").collect()
    }
    assert len(got) == 10
    for r in got:
        assert r["target_month"] == date(2020, 1, 1)
        assert r["prediction"] == pytest.approx(want[r["brand"], r["zone"]])
        assert r["pct_change"] == pytest.approx(100 * (r["prediction"] / r["last_actual"] - 1))


def test_folds_expand_and_never_touch_the_holdout(panel):
    frame_ = X.stamp_split(panel, "2019-06-01").where("__split = 'train'")
    folds = E.expanding_folds(frame_, "2019-06-01", n_folds=3, months=2)
    got = {(r["fold"], r["role"]): r for r in E.fold_sizes(folds).collect()}
    assert [got[i, "train"]["last_month"] for i in (1, 2, 3)] == [
        date(2018, 12, 1),
        date(2019, 2, 1),
        date(2019, 4, 1),
    ]
    assert got[3, "valid"]["last_month"] == date(2019, 6, 1)
    assert {got[i, "valid"]["n_rows"] for i in (1, 2, 3)} == {20}


def test_selection_takes_the_smallest_cross_validated_error(panel):
    backtest = training.backtest_frame(panel, "2019-09-01")
    out = training.cross_validate(
        backtest, "2019-09-01", ["naive", "seasonal_naive", "drift"], n_folds=3, months=2
    ).collect()
    best = min(out, key=lambda r: r["cv_wmape"])
    assert [r["candidate"] for r in out if r["selected"]] == [best["candidate"]]
    assert {r["n_folds"] for r in out} == {3}


def test_blend_bias_and_entities(spark):
    rows = scored(spark).withColumn("q", F.col("y") + 1.0).where("__split = 'test'")
    assert rows.select(B.blend("p", "q", 0.7).alias("b")).head()["b"] == pytest.approx(11.7)
    long = E.candidate_rows(rows, ["p", "q"], SPEC)
    bias = {(r["candidate"], r["date"].month): r["error_pct"] for r in E.monthly_bias(long).collect()}
    assert bias["p", 1] == pytest.approx(0.0) and bias["p", 2] == pytest.approx(20.0)
    better = E.beats_naive(long, "q", "p").head()
    assert (better["n_entities"], better["n_better"]) == (2, 2)
    per = {(r["candidate"], r["brand"]): r["zone_wmape"] for r in E.entity_wmape(long).collect()}
    assert per["q", "b"] == pytest.approx(20.0)
