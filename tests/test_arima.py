from __future__ import annotations

import math
import random
from datetime import date

import numpy as np
import pytest
from conftest import frame

from panelcast.operators.arima import Order, arima_backtest, arima_refitted, forecast_arima
from panelcast.sources.crosstab import months_between
from panelcast.spec import PanelSpec

SPEC = PanelSpec()
MONTHS = months_between(date(2014, 1, 1), date(2020, 1, 1))
TRAIN_END = "2019-06-01"


def levels(seed=11):
    """Three long series with a moving average and a season, and one too short to fit."""
    rng = random.Random(seed)
    out = {}
    for name in ("amber", "birch", "cedar"):
        ly, before, shock = 4.0, 0.0, 0.0
        path = []
        for d in MONTHS:
            e = rng.gauss(0, 0.05)
            step = 0.002 + 0.4 * before + e - 0.5 * shock + 0.1 * math.sin(d.month / 12 * 2 * math.pi)
            before, shock = step, e
            ly += step
            path.append((d, math.exp(ly)))
        out[name] = path
    out["dune"] = out["cedar"][-9:]
    out["elm"] = [(d, 0.0 if i == 30 else v) for i, (d, v) in enumerate(out["amber"])]  # no log there
    return out


def rows_of(series):
    rows = []
    for name, path in series.items():
        for d, y in path:
            rows.append({"brand": name, "zone": "east", "date": d, "value_lakhs": y} | {c: 1.0 for c in SPEC.exog})
    return rows


def brute(path, order, in_fit):
    """Predicted steps of one series by numpy and a plain loop."""
    ly = [math.log(y) if y > 0 else None for _, y in path]
    pairs = list(zip(ly, [None, *ly[:-1]], strict=True))
    step = [None if a is None or b is None else a - b for a, b in pairs]

    def lags(values, t, which):
        return [values[t - i] if t >= i else None for i in which]

    def fit(design):
        good = [(x, s) for t, (x, s) in enumerate(design) if in_fit(path[t][0]) and s is not None and None not in x]
        k = len(design[0][0])
        if len(good) < 3 * (k + 1):
            return None
        x = np.array([[1.0, *x] for x, _ in good])
        return np.linalg.lstsq(x, np.array([s for _, s in good]), rcond=None)[0]

    def value(beta, x):
        return None if beta is None or None in x else float(beta[0] + np.dot(beta[1:], x))

    n = len(path)
    shocks = [None] * n
    if order.q:
        design = [(lags(step, t, range(1, order.long + 1)), step[t]) for t in range(n)]
        beta = fit(design)
        hats = [value(beta, x) for x, _ in design]
        shocks = [None if h is None or s is None else s - h for h, s in zip(hats, step, strict=True)]
    design = [(lags(step, t, order.step_lags) + lags(shocks, t, range(1, order.q + 1)), step[t]) for t in range(n)]
    beta = fit(design)
    if beta is not None and order.q:
        theta = np.array(beta[-order.q :])
        if order.q == 2:
            theta[1] = np.clip(theta[1], -0.98, 0.98)
            theta[0] = np.clip(theta[0] / (1 + theta[1]), -0.98, 0.98) * (1 + theta[1])
        else:
            theta = np.clip(theta, -0.98, 0.98)
        beta = np.r_[beta[: -order.q], theta]
    errors, out = [], []
    for t in range(n):
        past = [errors[t - i] if t >= i else 0.0 for i in range(1, order.q + 1)]
        hat = value(beta, lags(step, t, order.step_lags) + past)
        errors.append(0.0 if hat is None or step[t] is None else step[t] - hat)
        out.append(hat)
    return out


ORDERS = {"ar": Order(2), "arima_111": Order(1, 1), "arima_212": Order(2, 2), "sarima": Order(1, 1, seasonal=1), "ma": Order(0, 1)}


def close(a, b):
    return a == b if a is None or b is None else a == pytest.approx(b, rel=1e-6)


def test_backtest_equals_a_plain_loop(spark):
    series = levels()
    got = arima_backtest(frame(spark, rows_of(series)), TRAIN_END, ORDERS).collect()
    found = {(r["brand"], r["date"]): r for r in got}
    assert len(found) == sum(len(p) for p in series.values())
    for name, path in series.items():
        for column, order in ORDERS.items():
            hats = brute(path, order, lambda d: d <= date.fromisoformat(TRAIN_END))
            for t, (d, _) in enumerate(path):
                before = path[t - 1][1] if t and path[t - 1][1] > 0 else None
                want = None if hats[t] is None or before is None else before * math.exp(hats[t])
                assert close(found[name, d][column], want), (name, column, d)
    assert all(found["dune", d]["arima_212"] is None for d, _ in series["dune"])
    assert found["cedar", MONTHS[-1]]["sarima"] is not None


def test_forecast_goes_on_from_the_last_row(spark):
    series = levels()
    got = forecast_arima(frame(spark, rows_of(series)), TRAIN_END, Order(2, 2)).collect()
    ahead = date(2020, 1, 1)
    assert {(r["brand"], r["target_month"]) for r in got} == {(n, ahead) for n in series}
    for r in got:
        path = [*series[r["brand"]], (ahead, -1.0)]
        hat = brute(path, Order(2, 2), lambda d: d <= date.fromisoformat(TRAIN_END))[-1]
        assert r["last_actual"] == pytest.approx(path[-2][1])
        assert close(r["prediction"], None if hat is None else path[-2][1] * math.exp(hat))


def test_refit_at_every_origin(spark):
    series = levels()
    origins = MONTHS[-4:]
    got = arima_refitted(frame(spark, rows_of(series)), [o.isoformat() for o in origins], Order(1, 1)).collect()
    assert {(r["brand"], r["date"]) for r in got} == {(n, o) for n in series for o in origins}
    for r in got:
        path = [p for p in series[r["brand"]] if p[0] <= r["date"]]
        hat = brute(path, Order(1, 1), lambda d, o=r["date"]: d < o)[-1]
        assert close(r["prediction"], None if hat is None else path[-2][1] * math.exp(hat))


def test_one_shuffle_by_series(spark):
    from pyspark.sql import functions as F

    from panelcast.operators.arima import arma, log_steps

    steps = log_steps(frame(spark, rows_of(levels())))
    plan = arma(steps, SPEC.series, SPEC.date, Order(2, 2), F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_shocks_die_out(spark):
    from pyspark.sql import functions as F

    from panelcast.operators.arima import invertible

    rng = random.Random(4)
    rows = [tuple(rng.uniform(-2, 2) for _ in range(4)) for _ in range(200)]
    # products of stable factors stay as they are
    stable = [np.poly([rng.uniform(-0.6, 0.6) for _ in range(4)])[1:].tolist() for _ in range(50)]
    df = spark.createDataFrame(rows + [tuple(s) for s in stable], "a double, b double, c double, d double")
    for q in (1, 2, 3, 4):
        names = list("abcd")[:q]
        got = df.select(F.array(*invertible([F.col(c) for c in names])).alias("t"), *names).collect()
        for r in got:
            roots = np.roots([1.0, *r["t"]])
            assert (np.abs(roots) < 1).all()
            if (np.abs(np.roots([1.0, *(r[c] for c in names)])) < 0.7).all():
                assert r["t"] == pytest.approx([r[c] for c in names])
    assert df.select(F.array(*invertible([F.lit(None).cast("double")])).alias("t")).first()["t"] == [None]
