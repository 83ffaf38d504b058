from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators.drift import bin_of, drift, histograms, merge


def frame(spark, seed, shift=0.0, scale=1.0, holes=0.0, n=4000):
    rng = random.Random(seed)
    rows = [
        (None if rng.random() < holes else rng.gauss(0, 1) * scale + shift, float(rng.choice([0, 0, 1])), rng.lognormvariate(0, 2))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "a double, b double, c double")


def test_bins_are_ordered_and_narrow(spark):
    values = sorted([0.0, 1e-300, -1e-300, 1.0, -1.0, 1e300, *(random.Random(1).gauss(0, 5) for _ in range(500))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in rows.select(bin_of(F.col("v")).alias("b"), "i").orderBy("i").collect()]
    assert got == sorted(got)
    odd = spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "v double").select(bin_of(F.col("v")).alias("b"))
    assert [r["b"] for r in odd.collect()] == [None, None, 0]


def test_same_distribution_is_stable_and_a_shift_is_seen(spark):
    reference = histograms(frame(spark, 1), ["a", "b", "c"])
    same = {r["feature"]: r for r in drift(reference, histograms(frame(spark, 2), ["a", "b", "c"])).collect()}
    assert {r["level"] for r in same.values()} == {"stable"} and all(r["psi"] < 0.02 for r in same.values())
    moved = {r["feature"]: r for r in drift(reference, histograms(frame(spark, 3, shift=1.0), ["a", "b", "c"])).collect()}
    assert moved["a"]["level"] == "shifted" and moved["b"]["level"] == moved["c"]["level"] == "stable"
    assert moved["a"]["max_gap"] == pytest.approx(0.383, abs=0.03)  # of two normals one apart
    holes = {r["feature"]: r for r in drift(reference, histograms(frame(spark, 4, holes=0.3), ["a", "b", "c"])).collect()}
    assert holes["a"]["level"] == "shifted" and holes["a"]["missing_payload"] > 1000 and holes["a"]["max_gap"] < 0.05


def test_histograms_add_up(spark):
    df = frame(spark, 5, holes=0.1)
    whole = histograms(df, ["a", "c"])
    parts = merge(histograms(df.where("c < 1"), ["a", "c"]), histograms(df.where("c >= 1"), ["a", "c"]))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))


def test_psi_by_hand(spark):
    reference = spark.createDataFrame([("f", i, 10) for i in range(1, 5)], "feature string, bin int, n long")
    payload = spark.createDataFrame([("f", 1, 5), ("f", 4, 10), ("f", 9, 5)], "feature string, bin int, n long")
    got = drift(reference, payload, groups=2).first()
    share = [(20.5 / 41, 5.5 / 21), (20.5 / 41, 15.5 / 21)]  # bins 1-2 and 3 on, the unseen one with the last
    assert got["psi"] == pytest.approx(sum((a - e) * math.log(a / e) for e, a in share))
    assert got["max_gap"] == pytest.approx(0.5) and (got["n_reference"], got["n_payload"]) == (40, 20)


def test_empty_payload(spark):
    reference = histograms(frame(spark, 1), ["a"])
    got = drift(reference, reference.where("false")).first()
    assert got["n_payload"] == 0 and got["max_gap"] is None
