from __future__ import annotations

import math
import random
from datetime import date

import pytest
from conftest import frame
from pyspark.sql import functions as F

from panelcast.operators import intervals
from panelcast.operators.arima import Order, arima_backtest
from panelcast.sources.crosstab import months_between
from panelcast.spec import PanelSpec

SPEC = PanelSpec()
LEVELS = {"low": 0.1, "mid": 0.5, "high": 0.9}


def test_quantiles_lean_on_the_pool(spark):
    rng = random.Random(1)
    rows = [("wide", round(rng.gauss(0, 1), 4)) for _ in range(600)] + [("narrow", round(rng.gauss(0, 0.1), 4)) for _ in range(600)]
    rows += [("one", 0.5)]
    errors = spark.createDataFrame(rows, "g string, error double")
    got = {r["g"]: r for r in intervals.error_quantiles(errors, ["g"], [0.1, 0.9], prior=30).collect()}

    def quantile(values, level):
        values = sorted(values)
        return next(v for i, v in enumerate(values, 1) if i >= level * len(values))

    for g, n in (("wide", 600), ("narrow", 600), ("one", 1)):
        own = [e for name, e in rows if name == g]
        pool = [e for _, e in rows]
        weight = n / (n + 30)
        assert got[g]["n_errors"] == n
        for i, level in enumerate((0.1, 0.9)):
            want = weight * quantile(own, level) + (1 - weight) * quantile(pool, level)
            assert got[g]["quantiles"][i] == pytest.approx(want, abs=1e-9)


def test_scores_by_hand(spark):
    rows = [("a", 10.0, 8.0, 10.0, 12.0), ("a", 20.0, 8.0, 10.0, 12.0), ("a", 5.0, None, 4.0, 6.0), ("b", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, low double, mid double, high double")
    got = {(r["g"], r["metric"]): r["value"] for r in intervals.interval_scores(df, LEVELS, ["g"]).collect()}
    assert got["a", "coverage"] == 0.5 and got["a", "scored"] == pytest.approx(2 / 3)
    assert got["a", "pinball_low"] == pytest.approx((0.1 * 2 + 0.1 * 12) / 2)
    assert got["a", "pinball_high"] == pytest.approx((0.1 * 2 + 0.9 * 8) / 2)
    assert got["a", "width"] == pytest.approx(8 / 30)
    assert got["b", "coverage"] is None and got["b", "scored"] == 0


def test_intervals_cover_what_they_say(spark):
    """Errors of the train folds give intervals that hold on months after them."""
    rng = random.Random(9)
    months = months_between(date(2010, 1, 1), date(2020, 1, 1))
    rows = []
    for i in range(12):
        ly, sd = 3.0, 0.05 if i % 2 else 0.2
        for d in months:
            ly += rng.gauss(0, sd)
            rows.append({"brand": f"b{i % 2}", "zone": f"z{i}", "date": d, "value_lakhs": math.exp(ly)} | {c: 1.0 for c in SPEC.exog})
    panel = frame(spark, rows)
    end = "2018-06-01"
    errors = intervals.fold_errors(panel, end, Order(1))
    assert errors.agg(F.max("date")).first()[0] == date(2018, 6, 1)
    assert errors.count() == 12 * 30
    quantiles = intervals.error_quantiles(errors, ["brand"], list(LEVELS.values()))
    holdout = arima_backtest(panel, end, {"prediction": Order(1)}).where(F.col("date") > F.lit(end))
    out = intervals.with_intervals(holdout, quantiles, ["brand"], list(LEVELS))
    got = {(r["brand"], r["metric"]): r["value"] for r in intervals.interval_scores(out, LEVELS, ["brand"]).collect()}
    # 108 months a brand; the narrow one's intervals are a little wide, as they lean on all errors
    assert 0.68 < got["b0", "coverage"] < 0.92 and 0.72 < got["b1", "coverage"] < 0.96
    assert got["b0", "scored"] == got["b1", "scored"] == 1
    assert got["b0", "width"] > 2 * got["b1", "width"]
