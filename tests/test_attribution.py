"""Contributions sum to the prediction, and only inputs that a tree asks have any."""

from __future__ import annotations

import pytest
from conftest import SPEC
from pyspark.sql import functions as F

from panelcast.operators import attribution, learners
from panelcast.plans.training import train_and_backtest

END = "2019-06-01"


@pytest.fixture(scope="module", params=["gbt", "rf"])
def run(request, panel):
    def learner(codes):
        if request.param == "gbt":
            return learners.boosted_trees(codes, SPEC, maxIter=5, stepSize=0.3, maxDepth=3)
        return learners.random_forest(codes, SPEC, numTrees=4, maxDepth=3)

    return train_and_backtest(panel, END, learner, SPEC, "model")


def test_contributions_sum_to_the_prediction(run):
    parts = attribution.contributions(run.model, run.test, SPEC)
    sums = parts.groupBy(*SPEC.key).agg(F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = run.model.transform(run.test).join(sums, SPEC.key).select("prediction", "total", "n").collect()
    assert len(rows) == run.test.count() > 0
    assert all(r["total"] == pytest.approx(r["prediction"], abs=1e-12) for r in rows)
    assert {r["n"] for r in rows} == {len(SPEC.feature_order) + 1}


def test_unused_inputs_add_nothing(run):
    nodes = attribution.tree_nodes(run.model)
    used = {SPEC.feature_order[r[0]] for r in nodes.where("left >= 0").select("feature").distinct().collect()}
    parts = attribution.contributions(run.model, run.test, SPEC)
    sizes = {r["feature"]: r["size"] for r in parts.groupBy("feature").agg(F.max(F.abs("contribution")).alias("size")).collect()}
    assert set(sizes) == {*SPEC.feature_order, attribution.BASE}
    assert {f for f, size in sizes.items() if size > 0} - {attribution.BASE} <= used
    base = parts.where(F.col("feature") == attribution.BASE).agg(F.min("contribution"), F.max("contribution")).first()
    assert base[0] == pytest.approx(base[1])  # the same for every row
    assert sum(size > 0 for size in sizes.values()) > 2
