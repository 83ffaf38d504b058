from __future__ import annotations

from datetime import date

import pytest
from conftest import MONTHS, SPEC, frame, make_rows

from panelcast.operators import levels, spine

LEVELS = {"town": ["brand", "zone", "town"], "zone": ["brand", "zone"], "brand": ["brand"], "all": []}
SCHEMA = "brand string, zone string, town string, date date, v double"
D = date(2020, 1, 1)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sums_at_every_level(spark):
    rows = [("a", "e", "x", D, 1.0), ("a", "e", "y", D, 2.0), ("a", "w", "x", D, 4.0), ("b", "e", "x", D, None), (None, "e", "x", D, 8.0)]
    got = {(r["level"], r["brand"], r["zone"], r["town"]): r for r in levels.lattice(table(spark, rows), LEVELS, ["v"], ["date"]).collect()}
    assert len(got) == 5 + 4 + 3 + 1
    assert got["zone", "a", "e", None]["v"] == 3 and got["zone", "a", "e", None]["n_cells"] == 2
    assert got["brand", "a", None, None]["v"] == 7 and got["brand", None, None, None]["v"] == 8
    assert got["brand", "b", None, None]["v"] is None and got["brand", "b", None, None]["n_missing_v"] == 1
    assert got["all", None, None, None]["v"] is None and got["all", None, None, None]["n_cells"] == 5


def test_coherence_finds_what_does_not_add_up(spark):
    rows = [("a", z, t, D, 1.0 + i) for i, (z, t) in enumerate([("e", "x"), ("e", "y"), ("w", "x")])]
    rows += [(None, "e", "x", D, 8.0), ("b", "e", "x", D, None)]
    whole = levels.lattice(table(spark, rows), LEVELS, ["v"], ["date"])
    got = {r["level"]: r for r in levels.coherence(whole, LEVELS, "v", ["date"]).collect()}
    assert set(got) == {"zone", "brand", "all"}
    assert all(r["n_missing"] == 0 for r in got.values())
    assert got["zone"]["max_relative_gap"] == 0 and got["zone"]["n_incomplete"] == 1 and got["all"]["n_incomplete"] == 1
    bent = whole.where("NOT (level = 'zone' AND zone = 'w')").replace({3.0: 4.0}, subset=["v"])
    bad = {r["level"]: r for r in levels.coherence(bent, LEVELS, "v", ["date"]).collect()}
    assert bad["zone"]["n_missing"] == 1 and bad["zone"]["max_relative_gap"] == pytest.approx(0.25)


def gappy():
    """Without three months in a row of one series and single ones of another."""
    rows = make_rows(["amber", "birch", "cedar"], ["east"], MONTHS)
    out = {("amber", MONTHS[i]) for i in (5, 6, 7)} | {("birch", MONTHS[i]) for i in (2, 9)} | {("cedar", MONTHS[0])}
    return [r for r in rows if (r["brand"], r["date"]) not in out]


def test_every_month_is_there(spark):
    rows = gappy()
    dense = spine.densify(frame(spark, rows)).orderBy("brand", "date").collect()
    assert [(r["brand"], r["date"]) for r in dense] == [
        (b, m) for b, months in (("amber", MONTHS), ("birch", MONTHS), ("cedar", MONTHS[1:])) for m in months
    ]
    gaps = {(r["brand"], r["date"]): r["gap_length"] for r in dense if r["is_gap"]}
    assert gaps == {("amber", MONTHS[i]): 3 for i in (5, 6, 7)} | {("birch", MONTHS[i]): 1 for i in (2, 9)}
    there = [r for r in dense if not r["is_gap"]]
    assert len(there) == len(rows) and all(r["gap_length"] == 0 and r["value_lakhs"] is not None for r in there)
    assert all(r["value_lakhs"] is None and r["sah"] is None for r in dense if r["is_gap"])
    report = {r["brand"]: tuple(r)[2:] for r in spine.gap_report(frame(spark, rows)).collect()}
    n = len(MONTHS)
    assert report == {"amber": (n, 3, 1, 3), "birch": (n, 2, 2, 1), "cedar": (n - 1, 0, 0, 0)}


def test_lags_by_date(spark):
    rows = gappy()
    value = {(r["brand"], r["date"]): r["value_lakhs"] for r in rows}
    got = spine.calendar_lags(frame(spark, rows), "value_lakhs", [1, 4], SPEC).collect()
    assert len(got) == len(rows)
    for r in got:
        at = MONTHS.index(r["date"])
        for k in (1, 4):
            want = value.get((r["brand"], MONTHS[at - k])) if at >= k else None
            assert r[f"value_lakhs_m{k}"] == want
