"""Statistics against direct numpy computations."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SPEC, frame
from pyspark.sql import functions as F

from panelcast.operators import cleaning, linear, stats
from panelcast.operators.features import stamp_split, training_frame


def by_group(rows, key, value="value_lakhs"):
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r[value])
    return {k: np.array(v) for k, v in groups.items()}


def test_concentration(panel, rows):
    value = {k: v.sum() for k, v in by_group(rows, lambda r: r["brand"]).items()}
    total = sum(value.values())
    got = sorted(stats.concentration(panel).collect(), key=lambda r: r["rank"])
    assert [r["brand"] for r in got] == sorted(value, key=lambda b: -value[b])
    cum = np.cumsum(sorted(value.values(), reverse=True)) / total
    assert [r["cum_share"] for r in got] == pytest.approx(cum.tolist())
    assert got[0]["hhi"] == pytest.approx(sum((v / total) ** 2 for v in value.values()))


def test_seasonality_and_volatility(panel, rows):
    overall = np.mean([r["value_lakhs"] for r in rows])
    months = by_group(rows, lambda r: r["date"].month)
    for r in stats.seasonality_index(panel).collect():
        assert r["idx"] == pytest.approx(months[r["month"]].mean() / overall)
    series = by_group(rows, lambda r: (r["brand"], r["zone"]))
    for r in stats.series_volatility(panel).collect():
        y = series[r["brand"], r["zone"]]
        assert r["sd_step"] == pytest.approx(np.diff(np.log(y)).std(ddof=1))
        assert r["cv"] == pytest.approx(y.std(ddof=1) / y.mean())
    for r in stats.series_swing(panel).collect():
        y = series[r["brand"], r["zone"]]
        assert r["max_swing_pct"] == pytest.approx(np.abs(100 * (y[1:] / y[:-1] - 1)).max())


def test_anova(panel, rows):
    groups = list(by_group(rows, lambda r: r["brand"]).values())
    every = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(every) - len(groups))
    got = stats.anova(panel, "brand", "value_lakhs").head()
    assert (got["df_between"], got["df_within"]) == (4, 235)
    assert got["f_stat"] == pytest.approx(between / within)


def test_welch(panel, rows):
    g = by_group(rows, lambda r: 8 <= r["date"].month <= 11)
    a, b = g[True], g[False]
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    got = stats.welch(panel, F.month("date").between(8, 11), "value_lakhs").head()
    assert got["t_stat"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    assert got["df"] == pytest.approx(df)


def kruskal_by_hand(values, groups):
    values = np.asarray(values, float)
    n = len(values)
    rank = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    parts = [rank[np.asarray(groups) == g] for g in sorted(set(groups))]
    h = 12 / (n * (n + 1)) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * (n + 1)
    _, t = np.unique(values, return_counts=True)
    return h / (1 - (t**3 - t).sum() / (n**3 - n))


def test_kruskal_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.where(np.arange(900) % 3 == 0, 7, rng.integers(0, 40, 900)).tolist()
    groups = rng.integers(0, 4, 900).tolist()
    df = spark.createDataFrame(list(zip(groups, map(float, values))), "g int, v double")
    got = stats.kruskal(df, F.col("g"), "v").head()
    assert (got["df"], got["n_rows"]) == (3, 900)
    assert got["h_stat"] == pytest.approx(kruskal_by_hand(values, groups))


def test_dickey_fuller(panel, rows):
    series = by_group(rows, lambda r: (r["brand"], r["zone"]))

    def t_stat(x):
        dx, lag = np.diff(x), x[:-1]
        design = np.column_stack([np.ones(len(lag)), lag])
        beta, *_ = np.linalg.lstsq(design, dx, rcond=None)
        resid = dx - design @ beta
        cov = resid @ resid / (len(dx) - 2) * np.linalg.inv(design.T @ design)
        return beta[1] / np.sqrt(cov[1, 1])

    for r in stats.dickey_fuller(panel).collect():
        x = np.log(series[r["brand"], r["zone"]])
        assert r["t_level"] == pytest.approx(t_stat(x))
        assert r["t_diff"] == pytest.approx(t_stat(np.diff(x)))
        want = 0 if r["t_level"] < -2.86 else 1 if r["t_diff"] < -2.86 else None
        assert r["d"] == want


def test_correlation_and_vif(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    want = np.corrcoef(x.T)
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in stats.correlations(df, list("abc")).collect()}
    assert got["a", "c"] == pytest.approx(want[0, 2]) and got["a", "b"] == pytest.approx(want[0, 1])
    factors = {r["feature"]: r["vif"] for r in linear.vif(df, list("abc")).collect()}
    assert factors["c"] == pytest.approx(np.linalg.inv(want)[2, 2])


def test_vif_of_the_degenerate_columns_is_not_finite(panel):
    cleaned = training_frame(panel, "2019-06-01").na.drop(subset=["rm3", "d_l1", "d_l2"])
    got = linear.vif(cleaned, ["rm3", "d_l1", "d_l2"]).collect()
    assert [r["vif"] for r in got] == [None, None, None]


# Cleaning


def test_imputation_takes_the_train_median(spark, rows):
    holed = [dict(r) for r in rows]
    mine = [r for r in holed if r["brand"] == "amber" and r["zone"] == "east"]
    mine[2]["sah"] = mine[-1]["sah"] = None
    stamped = stamp_split(frame(spark, holed), "2019-06-01")
    out = cleaning.impute(stamped, ["sah"])
    got = {(r["brand"], r["zone"], r["date"]): r["sah"] for r in out.collect()}
    train = [r["sah"] for r in mine if str(r["date"]) <= "2019-06-01" and r["sah"] is not None]
    for r in (mine[2], mine[-1]):
        assert got["amber", "east", r["date"]] == pytest.approx(np.median(train))
    assert got["amber", "east", mine[5]["date"]] == mine[5]["sah"]


def test_caps_leave_the_target_and_flag_it_instead(spark, rows):
    spiked = [dict(r) for r in rows]
    mine = [r for r in spiked if r["brand"] == "amber" and r["zone"] == "east"]
    mine[-1]["sah"], mine[-1]["value_lakhs"] = 1e6, 1e6
    stamped = stamp_split(frame(spark, spiked), "2019-06-01")
    train = [r["sah"] for r in mine if str(r["date"]) <= "2019-06-01"]
    q1, q3 = np.percentile(train, [25, 75])
    hit = (F.col("brand") == "amber") & (F.col("zone") == "east") & (F.col("date") == mine[-1]["date"])
    row = cleaning.cap_exog(stamped).where(hit).head()
    assert row["sah"] == pytest.approx(q3 + 3 * (q3 - q1)) and row["value_lakhs"] == 1e6
    flagged = cleaning.flag_target(stamped).where(hit).head()
    assert flagged["is_outlier"] and flagged["value_lakhs"] == 1e6


def test_scaling_is_fitted_on_train(panel):
    cleaned = training_frame(panel, "2019-06-01")
    names = ["rm6", "sah_l1", "month"]
    scaled = cleaning.scale_features(cleaned, names).where("__split = 'train'")
    for name in names:
        mean, sd = scaled.agg(F.avg(name), F.stddev_pop(name)).head()
        assert mean == pytest.approx(0.0, abs=1e-9) and sd == pytest.approx(1.0)
