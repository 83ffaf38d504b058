from __future__ import annotations

import math
import random

import numpy as np
import pytest

from panelcast.llm import whitening
from panelcast.llm.whitening import fit, integer_vectors, whiten, whitened_embeddings

SCHEMA = "vec_id long, embedding array<float>, block string, ids int, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7, 0.5) for i, v in rows], SCHEMA)


def brute(rows, components):
    """n, deviations, whitened rows and shares by numpy from all vectors at once."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in good]
    once = np.array(sorted({tuple(v) for v in x}), np.float64)
    n, mean = len(once), once.mean(axis=0)
    covariance = (once - mean).T @ (once - mean) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sums = [sum(int(v[j]) for v in once) for j in range(width)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    projected = (np.array(x) - mean) @ vectors / np.sqrt(values)
    return [i for i, _ in good], n, deviation, projected, values / np.trace(covariance)


def check(got, rows, components):
    ids, n, deviation, projected, explained = brute(rows, components)
    by_component = {}
    for r in got.collect():
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        by_component.setdefault(r["component"], []).append((r["vec_id"] or -1, r["deviation"], r["whitened"]))
    assert set(by_component) == set(range(1, components + 1))
    for c, have in by_component.items():
        want = sorted((i or -1, d, w) for i, d, w in zip(ids, deviation, projected[:, c - 1].tolist(), strict=True))
        flipped = sorted((i, d, -w) for i, d, w in want)
        have = sorted(have)
        assert [h[:2] for h in have] == [w[:2] for w in want]
        off = [max(abs(h[2] - w[2]) for h, w in zip(have, side, strict=True)) for side in (want, flipped)]
        assert min(off) < 1e-6  # one sign for all rows


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(10)]) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(60)]  # copies are fitted once
    check(whitened_embeddings(frame(spark, rows).repartition(3), 4), rows, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, -2.0, 3.0]), (2, None), (3, [None, 1.0, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]),
        (6, []), (7, [0.5]), (8, [0.5]), (8, [0.5, 0.0]), (None, [0.25, 4.0]), (9, [-0.0, 1.0, 7.0, 2.0]),
    ]
    check(whitened_embeddings(frame(spark, rows), 2), rows, 2)
    assert whitened_embeddings(frame(spark, rows), 4).select("component").distinct().count() == 4
    for few in ([], [(2, None)], [(6, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        got = whitened_embeddings(frame(spark, few), 4)
        assert got.count() == 0
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_dimensions_without_variance_have_no_component(spark):
    rng = random.Random(5)
    rows = [(i, [a := rng.gauss(0, 1), 2.0, a]) for i in range(40)]
    vectors = integer_vectors(frame(spark, rows))
    model = fit(vectors, 3)
    assert len(model.variances) == 1 and model.explained[0] == pytest.approx(1.0)
    assert whiten(vectors, model).count() == 40


def test_exact_deviations_and_overflow(spark):
    big = 2.0**20
    rows = [(i, [big * i, 1.0]) for i in range(3)]
    got = whitened_embeddings(frame(spark, rows), 1).collect()
    assert sorted(r["deviation"] for r in got) == sorted(brute(rows, 1)[2])
    with pytest.raises(Exception, match="64 bits"):
        whitened_embeddings(frame(spark, [(1, [2.0**40]), (2, [0.0])]), 1).collect()
