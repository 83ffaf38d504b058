from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import linear

COLUMNS = ["a", "b", "c", "y"]


def table(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(5, 1), rng.gauss(-2, 3), rng.gauss(0, 0.1)
        rows.append(("even" if i % 2 else "odd", a, b, c, 1.5 + 2 * a - b + 7 * c + rng.gauss(0, 0.5)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def df(spark, rows):
    extra = [("odd", None, 1.0, 1.0, 1.0), ("odd", 1.0, 1.0, 1.0, None), ("short", 1.0, 2.0, 3.0, 4.0)]
    return spark.createDataFrame(rows + extra, "g string, a double, b double, c double, y double")


def fitted(rows):
    x = np.array([[1.0, *r[1:4]] for r in rows])
    y = np.array([r[4] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    sse = float(((y - x @ beta) ** 2).sum())
    spread = np.diag(np.linalg.inv(x.T @ x))[1:]
    return beta, sse, spread


def test_least_squares_by_group(df, rows):
    xs = [F.col(c) for c in "abc"]
    out = linear.least_squares(df, ["g"], F.col("y"), xs)
    out = out.select("g", "fit.*", *[linear.t_value(F.col("fit"), i, 3).alias(f"t{i}") for i in range(3)])
    got = {r["g"]: r for r in out.collect()}
    for g in ("odd", "even"):
        own = [r for r in rows if r[0] == g]
        beta, sse, spread = fitted(own)
        r = got[g]
        assert r["n"] == len(own)
        assert [r["intercept"], *r["slopes"]] == pytest.approx(beta, rel=1e-9)
        assert r["sse"] == pytest.approx(sse, rel=1e-9) and r["spread"] == pytest.approx(spread, rel=1e-9)
        t = beta[1:] / np.sqrt(sse / (len(own) - 4) * spread)
        assert [r["t0"], r["t1"], r["t2"]] == pytest.approx(t, rel=1e-9)
    assert got["short"]["n"] == 1 and got["short"]["slopes"] is None and got["short"]["t0"] is None


def test_dependent_columns_have_no_fit_but_a_rank(spark, rows):
    wide = [(*r, 2 * r[1] - r[2] + 4, 3.0) for r in rows]
    df = spark.createDataFrame(wide, "g string, a double, b double, c double, y double, d double, e double")
    fit = linear.least_squares(df, [], F.col("y"), [F.col(c) for c in "abd"]).select("fit.*").first()
    assert fit["n"] == len(rows) and fit["slopes"] is None
    for columns, want in ((["a", "b", "d"], 2), (["a", "b", "c", "d"], 3), (["d", "e"], 1), (["a"], 1), (["e"], 0)):
        got = linear.rank(df, columns).first()
        assert (got["n_rows"], got["n_columns"], got["rank"]) == (len(rows), len(columns), want)
    assert all(r["vif"] is None for r in linear.vif(df, ["a", "b", "d"]).collect())
    assert linear.rank(df.where("false"), ["a", "b"]).first()["rank"] == 0


def test_vif_is_one_over_one_minus_r2(df, rows):
    got = {r["feature"]: r["vif"] for r in linear.vif(df.where("g <> 'short'"), COLUMNS).collect()}
    x = np.array([r[1:5] for r in rows])
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [got[c] for c in COLUMNS] == pytest.approx(want, rel=1e-9)


def test_ridge_is_the_closed_form(df, rows):
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for penalty in (0.0, 0.3, 50.0):
        beta = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(3), z.T @ (y - y.mean()) / len(z))
        got = linear.ridge(df.where("g <> 'short'"), "y", ["a", "b", "c"], penalty).first()
        assert got["n"] == len(rows)
        assert got["slopes"] == pytest.approx(beta / x.std(axis=0), rel=1e-8)
        assert got["intercept"] == pytest.approx(y.mean() - (beta / x.std(axis=0)) @ x.mean(axis=0), rel=1e-8)


def test_ridge_takes_constant_and_dependent_columns(spark, rows):
    df = spark.createDataFrame([(r[1], 2 * r[1], 3.0, r[4]) for r in rows], "a double, b double, c double, y double")
    got = linear.ridge(df, "y", ["a", "b", "c"], 0.1).first()
    assert got["slopes"][2] == 0 and got["slopes"][0] == pytest.approx(2 * got["slopes"][1], rel=1e-8)


def test_no_job_and_no_python_in_the_plan(df):
    plan = linear.vif(df, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
