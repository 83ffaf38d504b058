"""One mutated payload per rule."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import MONTHS, SPEC, frame
from pyspark.sql import functions as F

from panelcast.operators import contract as C
from panelcast.operators.features import stamp_split
from panelcast.plans.scoring import score_payload


def report(spark, rows, codes):
    got = C.contract_report(frame(spark, rows), codes).collect()
    return {(r["rule"], r["key"]): (r["observed"], r["expected"]) for r in got}


def test_clean_panel_has_no_violation(spark, rows, codes):
    clean = C.contract_report(frame(spark, rows), codes)
    assert clean.count() == 0
    C.enforce(clean)


def test_missing_columns(panel, codes):
    found = C.contract_report(panel.drop("sah", "pdo_rs"), codes)
    assert [r["key"] for r in found.orderBy("key").collect()] == ["pdo_rs", "sah"]
    with pytest.raises(C.ContractViolation, match="required_columns: pdo_rs"):
        C.enforce(found)


def test_unknown_members_and_the_gap_they_leave(spark, rows, codes):
    bad = [
        {**r, "brand": "zinc"} if r["brand"] == "amber" and r["zone"] == "east" else r for r in rows
    ]
    got = report(spark, bad, codes)
    assert got["unknown_entity", "zinc"] == (1, 0)
    assert got["incomplete_segment", "east"] == got["incomplete_segment", "west"] == (5, 6)
    moved = [{**r, "zone": "north"} if r["zone"] == "east" else r for r in rows]
    assert report(spark, moved, codes) == {("unknown_segment", "north"): (1, 0)}


def test_entity_absent_everywhere_is_not_noticed(spark, rows, codes):
    assert report(spark, [r for r in rows if r["brand"] != "amber"], codes) == {}


def test_incomplete_segment(spark, rows, codes):
    bad = [r for r in rows if not (r["brand"] == "amber" and r["zone"] == "west")]
    assert report(spark, bad, codes) == {("incomplete_segment", "west"): (4, 5)}


def test_null_metric_and_nonpositive_target(spark, rows, codes):
    bad = [dict(r) for r in rows]
    bad[3]["sah"] = bad[8]["sah"] = bad[9]["pdo_rs"] = None
    bad[11]["value_lakhs"], bad[12]["value_lakhs"] = 0.0, -1.0
    assert report(spark, bad, codes) == {
        ("null_metric", "sah"): (2, 0),
        ("null_metric", "pdo_rs"): (1, 0),
        ("nonpositive_target", "value_lakhs"): (2, 0),
    }


def test_short_history_counts_dates_while_depth_counts_rows(spark, rows, codes):
    short = [r for r in rows if not (r["brand"] == "elm" and r["date"] < MONTHS[-6])]
    doubled = short + [r for r in short if r["brand"] == "elm" and r["zone"] == "east"]
    got = report(spark, doubled, codes)
    assert got == {
        ("short_history", "elm|east"): (6, 7),
        ("short_history", "elm|west"): (6, 7),
        ("duplicate_keys", "elm|east"): (6, 0),
    }
    depth = C.history_depth(frame(spark, doubled)).collect()
    assert [(r["zone"], r["n_rows"]) for r in depth] == [("west", 6)]


def test_first_violated_rule_is_the_one_raised(spark, rows, codes):
    bad = [dict(r) for r in rows if r["date"] >= MONTHS[-3]]
    bad[0]["sah"] = None
    with pytest.raises(C.ContractViolation) as caught:
        C.enforce(C.contract_report(frame(spark, bad), codes))
    assert caught.value.rule == "null_metric"


def test_duplicates_are_reported_but_do_not_refuse(spark, rows, codes):
    found = C.contract_report(frame(spark, rows + rows[:1]), codes)
    assert [r["rule"] for r in found.collect()] == ["duplicate_keys"]
    C.enforce(found)


def test_a_hot_duplicated_key_collapses_before_the_series_level(spark, rows, codes):
    hot = frame(spark, rows[:1]).select("*", F.explode(F.sequence(F.lit(1), F.lit(20000))).alias("i"))
    panel = frame(spark, rows).unionByName(hot.drop("i"))
    got = {(r["brand"], r["zone"]): r for r in C.series_summary(panel).collect()}
    assert got["amber", "east"]["n_rows"] == 24 + 20000
    assert (got["amber", "east"]["n_dates"], got["amber", "east"]["n_duplicated"]) == (24, 1)


def test_ranges_and_violations(spark, rows):
    later = [dict(r) for r in rows]
    later[23]["sah"], later[22]["sah"] = 1e6, -5.0
    stamped = stamp_split(frame(spark, later), "2019-06-01")
    train = [r for r in later if r["date"] <= date(2019, 6, 1)]
    got = {r["column_name"]: r for r in C.fit_ranges(stamped).collect()}
    assert got["brand"]["n_allowed"] == 5 and got["zone"]["n_allowed"] == 2
    assert got["sah"]["max_value"] == max(r["sah"] for r in train)
    assert not got["sah"]["nullable"] and got["sah"]["dtype"] == "double"
    assert got["date"]["dtype"] == "date" and got["sah"]["n_allowed"] is None
    allowed = C.fit_allowed(stamped).where("column_name = 'zone'").collect()
    assert sorted(r["value"] for r in allowed) == ["east", "west"]
    holes = stamped.withColumn("zone", F.when(F.col("zone") != "west", F.col("zone")))
    got = {r["column_name"]: r for r in C.fit_ranges(holes).collect()}
    assert got["zone"]["nullable"] and not got["zone"]["required"] and got["zone"]["n_allowed"] == 1
    assert got["brand"]["required"] and not got["brand"]["nullable"]
    outside = {r["column_name"]: r for r in C.range_violations(stamped).collect()}
    assert outside["sah"]["n_above"] >= 1 and outside["sah"]["n_below"] >= 1


def test_fallback_is_opt_in_and_tagged(spark, rows):
    panel = frame(spark, rows)
    with pytest.raises(RuntimeError, match="fallback not allowed"):
        score_payload(panel, None, None)
    with pytest.raises(C.ContractViolation):
        score_payload(panel.drop("sah"), None, None, allow_fallback=True)
    out = score_payload(panel, None, None, allow_fallback=True, run_id="r1").collect()
    assert {(r["source"], r["model_version"], r["contract_version"]) for r in out} == {
        ("fallback", "none", 0)
    }
    assert len(out) == 15 and all(r["pct_change"] == 0.0 for r in out)


def test_fallback_leaves_out_series_without_a_row_in_the_latest_month(spark, rows):
    stale = [r for r in rows if not (r["brand"] == "elm" and r["date"] == MONTHS[-1])]
    out = score_payload(frame(spark, stale), None, None, allow_fallback=True, include_total=False)
    assert {r["brand"] for r in out.collect()} == set("amber birch cedar dune".split())
    assert SPEC.total_label not in {r["zone"] for r in out.collect()}
