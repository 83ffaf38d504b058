"""Totals, ranks, summaries, parity and envelopes."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import SPEC
from pyspark.sql import functions as F

from panelcast.operators import baselines as B
from panelcast.operators import checks
from panelcast.operators import reconcile as R
from panelcast.sources import panel as P

MONTH = date(2020, 1, 1)
SCHEMA = (
    "brand string, zone string, target_month date, last_actual double, prediction double, "
    "pct_change double"
)


def forecast(spark, rows):
    return spark.createDataFrame(
        [(b, z, MONTH, last, p, 100 * (p / last - 1)) for b, z, last, p in rows], SCHEMA
    )


SMALL = [("a", "e", 10.0, 11.0), ("a", "w", 30.0, 27.0), ("b", "e", 5.0, 5.0), ("b", "w", 5.0, 33.0)]


def test_totals_are_sums_of_segments(spark, panel):
    got = {r["brand"]: r for r in R.reconcile_total(forecast(spark, SMALL)).collect()}
    assert (got["a"]["last_actual"], got["a"]["prediction"]) == (40.0, 38.0)
    assert got["a"]["pct_change"] == pytest.approx(-5.0)
    assert {r["zone"] for r in got.values()} == {SPEC.total_label}
    one_pass = R.with_total(B.forecast_ar1(panel, "2019-06-01")).collect()
    two_pass = R.reconcile_total(B.forecast_ar1(panel, "2019-06-01")).collect()
    totals = {r["brand"]: r["prediction"] for r in one_pass if r["zone"] == SPEC.total_label}
    assert totals == pytest.approx({r["brand"]: r["prediction"] for r in two_pass})
    assert len(one_pass) == 15


def test_rank_restarts_in_each_segment(spark):
    ranked = R.forecast_ranked(R.with_total(forecast(spark, SMALL))).collect()
    got = {(r["zone"], r["rank"]): r["brand"] for r in ranked}
    # equal totals (38) are ordered by name
    assert got == {
        ("e", 1): "a",
        ("e", 2): "b",
        ("w", 1): "b",
        ("w", 2): "a",
        (SPEC.total_label, 1): "a",
        (SPEC.total_label, 2): "b",
    }


def test_summary(spark):
    got = R.forecast_summary(R.with_total(forecast(spark, SMALL))).head()
    assert got["total_prediction"] == 76.0 and got["n_entities"] == 2
    assert got["total_pct_change"] == pytest.approx(52.0)
    assert got["largest_entity"] == "a"


def test_a_missing_segment_makes_the_total_missing(spark):
    holes = forecast(spark, SMALL).withColumn(
        "prediction", F.when(F.expr("NOT (brand = 'a' AND zone = 'w')"), F.col("prediction"))
    )
    for totals in (R.reconcile_total(holes), R.with_total(holes)):
        got = {r["brand"]: r for r in totals.where(F.col("zone") == SPEC.total_label).collect()}
        assert got["a"]["prediction"] is None and got["a"]["pct_change"] is None
        assert got["a"]["last_actual"] == 40.0 and got["b"]["prediction"] == 38.0
    counts = {r["brand"]: (r["n_segments"], r["n_missing"]) for r in R.missing_segments(holes).collect()}
    assert counts == {"a": (2, 1), "b": (2, 0)}
    assert R.forecast_summary(R.with_total(holes)).head()["total_prediction"] is None


def test_parity_counts_missing_predictions(spark):
    want = forecast(spark, SMALL)
    nothing = want.withColumn("prediction", F.lit(None).cast("double"))
    got = R.parity_diff(nothing, want).head()
    assert (got["n_missing"], got["n_compared"], got["within_tolerance"]) == (4, 0, False)
    later = want.withColumn("target_month", F.add_months("target_month", 1))
    assert R.parity_diff(later, want).head()["n_extra"] == 4


def test_parity(spark):
    want = forecast(spark, SMALL)
    same = R.parity_diff(want, want).head()
    assert same["within_tolerance"] and same["max_abs_diff"] == 0.0 and same["n_compared"] == 4
    moved = forecast(spark, [("a", "e", 10.0, 11.5), *SMALL[1:3], ("c", "w", 1.0, 1.0)])
    got = R.parity_diff(moved, want).head()
    assert (got["n_missing"], got["n_extra"], got["n_compared"]) == (1, 1, 3)
    assert got["worst_key"] == "a|e" and got["max_abs_diff"] == pytest.approx(0.5)
    assert not got["within_tolerance"]


def test_additivity_sees_a_wrong_total(panel):
    whole = P.with_total_rows(panel, SPEC)
    assert R.additivity(whole).head()["max_relative_error"] < 1e-12
    is_hit = (F.col("zone") == SPEC.total_label) & (F.col("brand") == "elm")
    bent = whole.withColumn(
        "value_lakhs", F.when(is_hit, F.col("value_lakhs") * 1.01).otherwise(F.col("value_lakhs"))
    )
    assert R.additivity(bent).head()["max_relative_error"] == pytest.approx(0.01 / 1.01)
    assert P.drop_total(whole, SPEC).count() == panel.count()


def test_envelope(spark, panel):
    calm = R.with_total(B.forecast_ar1(panel, "2019-06-01")).where(
        F.col("zone") != SPEC.total_label
    )
    got = checks.forecast_envelope(calm, panel).collect()
    assert len(got) == 10 and all(r["in_envelope"] for r in got)
    wild = forecast(spark, [("amber", "east", 10.0, 51.0)])
    assert not checks.forecast_envelope(wild, panel).head()["in_envelope"]


def test_latest_months_subset_profile_and_fingerprint(spark, panel, rows):
    from panelcast.operators.features import stamp_split

    cut = P.latest_months(panel, 10, SPEC)
    assert cut.select("date").distinct().count() == 10 and cut.count() == 100
    assert P.segment_subset(panel, ["east"], SPEC).count() == 120
    profile = {r["scope"]: r for r in P.panel_profile(stamp_split(panel, "2019-06-01"), SPEC).collect()}
    assert (profile["all"]["n_rows"], profile["all"]["n_series"]) == (240, 10)
    assert profile["train"]["n_rows"] + profile["test"]["n_rows"] == 240
    a = P.data_fingerprint(panel).head()
    b = P.data_fingerprint(panel.repartition(7).orderBy(F.desc("sah"))).head()
    c = P.data_fingerprint(panel.withColumn("sah", F.col("sah") + 1)).head()
    assert a == b and a != c


def test_dates_given_as_text_become_month_starts(spark):
    df = spark.createDataFrame([("2019-08-15",), ("2019-08-01",)], "date string")
    assert {r["date"] for r in P.normalise_dates(df, SPEC).collect()} == {date(2019, 8, 1)}
