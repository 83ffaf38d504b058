"""Training, backtest, scoring and importances with small learners."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import ENTITIES, SPEC, frame, make_rows
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise
from panelcast.operators import learners
from panelcast.operators.contract import ContractViolation
from panelcast.plans import training
from panelcast.plans.scoring import score_payload

END = "2019-06-01"


def small_gbt(codes, **params):
    return learners.boosted_trees(codes, SPEC, **{"maxIter": 3, "stepSize": 0.1, **params})


@pytest.fixture(scope="module")
def run(panel):
    return training.train_and_backtest(panel, END, small_gbt, SPEC, "gbt")


def test_backtest_reports_model_and_naive(run):
    got = {(r["candidate"], r["metric"]): r["value"] for r in run.metrics.collect()}
    assert len(got) == 18 and all(v is not None for v in got.values())
    gate = {r["gate"]: r["value"] for r in run.gate.collect()}
    assert gate["vs_naive"] == pytest.approx(
        got["gbt", "ai_brand_wmape"] / got["naive", "ai_brand_wmape"]
    )


def test_empty_holdout_is_refused(panel):
    with pytest.raises(ValueError, match="no holdout rows"):
        training.train_and_backtest(panel, "2030-01-01", small_gbt)


def test_total_rows_in_the_input_are_dropped(spark, panel, run):
    total = panel.withColumn("zone", F.lit(SPEC.total_label))
    with_total = training.backtest_frame(panel.unionByName(total), END)
    assert with_total.count() == training.backtest_frame(panel, END).count()


def test_forecast_of_a_payload(run, panel):
    out = score_payload(panel, run.model, run.codes, "v1", run_id="r").collect()
    zones = [r for r in out if r["zone"] != SPEC.total_label]
    assert len(zones) == 10 and len(out) == 15
    assert {r["target_month"] for r in out} == {date(2020, 1, 1)}
    assert {(r["source"], r["model_version"], r["contract_version"]) for r in out} == {
        ("model", "v1", 1)
    }
    assert all(r["prediction"] > 0 and 0.2 <= r["prediction"] / r["last_actual"] <= 5 for r in zones)
    for r in out:
        if r["zone"] == SPEC.total_label:
            parts = sum(z["prediction"] for z in zones if z["brand"] == r["brand"])
            assert r["prediction"] == pytest.approx(parts, rel=1e-9)


def test_payload_that_breaks_the_contract_is_refused(spark, run, rows):
    bad = [r for r in rows if not (r["brand"] == "amber" and r["zone"] == "west")]
    with pytest.raises(ContractViolation, match="incomplete_segment"):
        score_payload(frame(spark, bad), run.model, run.codes)


def test_same_run_twice_and_any_column_order_gives_the_same_forecast(run, panel):
    def values(model, p):
        rows = learners.forecast_model(p, model).collect()
        return {(r["brand"], r["zone"]): r["prediction"] for r in rows}

    first = values(run.model, panel)
    again = training.train_and_backtest(panel, END, small_gbt, SPEC, "gbt")
    assert values(again.model, panel) == first
    assert values(run.model, panel.select(*reversed(panel.columns))) == first


def test_kept_run_scores_from_its_folder_alone(spark, tmp_path, run, panel):
    folder = str(tmp_path / "runs")
    training.keep_run(run, folder, "r1")
    with pytest.raises(Exception, match="already exists"):
        training.keep_run(run, folder, "r1")
    model, codes = training.load_run(spark, folder, "r1")
    texts = panel.withColumn("date", F.date_format(F.date_add("date", 9), "yyyy-MM-dd"))
    log = f"{folder}/log"
    got = score_payload(texts, model, codes, "v1", log=log, day="2020-01-05")
    want = score_payload(panel, run.model, run.codes, "v1")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert spark.read.json(log).count() == want.count()
    assert spark.read.parquet(f"{folder}/gates").where("run_id = 'r1'").count() == 4
    reference = spark.read.parquet(f"{folder}/reference")
    assert set(SPEC.feature_order) <= set(reference.columns)
    assert reference.where("brand_code IS NULL OR zone_code IS NULL").count() == 0


def test_unknown_entity_cannot_be_scored(spark, run):
    strange = frame(spark, make_rows(entities=[*ENTITIES, "zinc"]))
    with pytest.raises(Exception, match="(?i)unseen label"):
        learners.forecast_model(strange, run.model).collect()


def test_linear_learners_fit(run, panel):
    frame_ = materialise(training.backtest_frame(panel, END))
    train = learners.fit_order(frame_.where("__split = 'train'"))
    for lasso in (False, True):
        model = learners.linear(run.codes, lasso=lasso).fit(train)
        out = learners.predict_level(model, frame_.where("__split = 'test'"), "p")
        assert out.where("p > 0").count() == out.count() > 0


def test_shuffle_permutes_inside_each_month(run):
    rows = run.test.select(*SPEC.key, "sah_l1")
    out = learners.shuffled_within_month(rows, ["sah_l1"]).collect()
    assert len(out) == rows.count()
    for m in {r["date"] for r in out}:
        mine = [r for r in out if r["date"] == m]
        assert sorted(r["sah_l1"] for r in mine) == sorted(r["sah_l1__s"] for r in mine)
        assert all(r["sah_l1"] != r["sah_l1__s"] for r in mine)


def test_fit_layout_does_not_depend_on_the_number_of_rows(run):
    for rows in (run.frame, run.frame.limit(3)):
        assert learners.fit_order(rows, parts=3).count() == rows.count()


def test_importances_cover_every_input(run):
    split = {r["feature"]: r["importance"] for r in learners.split_importance(run.model).collect()}
    assert set(split) == set(SPEC.feature_order)
    assert sum(split.values()) == pytest.approx(1.0)
    gain = learners.permutation_importance(run.model, run.test).collect()
    assert {r["feature"] for r in gain} == set(SPEC.feature_order)
    unused = {f for f, v in split.items() if v == 0.0}
    assert all(r["wmape_increase"] == pytest.approx(0.0) for r in gain if r["feature"] in unused)


def test_random_search_and_seed_stability(run, panel):
    frame_ = materialise(training.backtest_frame(panel, END))
    out = training.random_search(
        frame_,
        END,
        lambda codes, **p: small_gbt(codes, **{"maxIter": 2, **p}),
        run.codes,
        {"maxDepth": [2, 3], "stepSize": [0.05, 0.3]},
        draws=2,
        n_folds=2,
        months=2,
    ).collect()
    assert len(out) == 2 and sum(r["selected"] for r in out) == 1
    best = min(out, key=lambda r: r["cv_wmape"])
    assert best["selected"] and best["n_folds"] == 2
    spread = training.seed_stability(
        frame_, lambda codes, **p: small_gbt(codes, **{"maxIter": 2, **p}), run.codes, (1, 2)
    ).collect()
    assert all(r["n_seeds"] == 2 and r["min_value"] <= r["max_value"] for r in spread)


def test_learners_blends_and_baselines_in_one_selection(run, panel):
    frame_ = training.backtest_frame(panel, END)
    learned = {"ridge": learners.linear, "gbt": lambda codes: small_gbt(codes)}
    out = training.cross_validate_learners(
        frame_, END, learned, run.codes, ("naive", "drift"), {"mix": ("ridge", "naive", 0.7)},
        n_folds=2, months=3,
    ).collect()
    assert {r["candidate"] for r in out} == {"ridge", "gbt", "mix", "naive", "drift"}
    assert {r["n_folds"] for r in out} == {2} and sum(r["selected"] for r in out) == 1
    plain = training.cross_validate(frame_, END, ["naive", "drift"], n_folds=2, months=3).collect()
    errors = {r["candidate"]: r["cv_wmape"] for r in out}
    assert all(errors[r["candidate"]] == pytest.approx(r["cv_wmape"]) for r in plain)
