"""Features against a plain-Python statement of their definitions."""

from __future__ import annotations

import math
import statistics
from collections import defaultdict
from datetime import date

import pytest
from conftest import ENTITIES, MONTHS, SEGMENTS, SPEC, frame, make_rows
from pyspark.sql import functions as F

from panelcast.operators import checks, encoding
from panelcast.operators import features as X


def by_hand(rows):
    """(brand, zone, date) -> features, following each definition literally."""
    totals = defaultdict(float)
    series = defaultdict(list)
    for r in rows:
        totals[r["zone"], r["date"]] += r["value_lakhs"]
        series[r["brand"], r["zone"]].append(r)
    out = {}
    for (b, z), rs in series.items():
        rs = sorted(rs, key=lambda r: r["date"])
        ly = [math.log(r["value_lakhs"]) for r in rs]
        zt = [math.log(totals[z, r["date"]]) for r in rs]

        def at(seq, i):
            return seq[i] if i >= 0 else None

        def minus(a, b):
            return None if a is None or b is None else a - b

        for i, r in enumerate(rs):
            f = {f"ly_l{k}": at(ly, i - k) for k in range(1, 8)}
            for k in (1, 2, 3):
                f[f"d_l{k}"] = minus(f[f"ly_l{k}"], f[f"ly_l{k + 1}"])
            past3, past6 = ly[max(0, i - 3) : i], ly[max(0, i - 6) : i]
            f["rm3"] = statistics.fmean(past3) - f["ly_l1"] if past3 else None
            f["rm6"] = statistics.fmean(past6) - f["ly_l1"] if past6 else None
            f["sd6"] = statistics.stdev(past6) if len(past6) > 1 else None
            f["zt_l1"] = at(zt, i - 1)
            f["zt_d1"] = minus(at(zt, i - 1), at(zt, i - 2))
            f["share_l1"] = minus(f["ly_l1"], f["zt_l1"])
            for c in SPEC.exog:
                one, two = (rs[i - k][c] if i >= k else None for k in (1, 2))
                f[f"{c}_l1"], f[f"{c}_d1"] = one, minus(one, two)
            m = r["date"].month
            f["month"], f["is_festive"], f["is_summer"] = m, int(8 <= m <= 11), int(4 <= m <= 6)
            out[b, z, r["date"]] = f
    return out


def same(got, want):
    for key, expected in want.items():
        for name, value in expected.items():
            if value is None:
                assert got[key][name] is None, (key, name)
            else:
                assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)


def collected(df, date_column="date"):
    return {(r["brand"], r["zone"], r[date_column]): r for r in df.collect()}


def test_transform_matches_the_definitions(panel, rows):
    got = collected(X.transform(panel))
    assert len(got) == len(rows)
    same(got, by_hand(rows))


def test_gappy_series_use_positional_lags(spark, rows):
    gappy = [
        r
        for i, r in enumerate(rows)
        if not (r["brand"] == "birch" and r["date"].month in (3, 4)) and i % 17
    ]
    got = collected(X.transform(frame(spark, gappy)))
    same(got, by_hand(gappy))


# The model inputs in contract order.
def test_feature_order_is_pinned():
    assert SPEC.feature_order == [
        "d_l3", "rm6", "sd6", "zt_d1", "share_l1",
        "numeric_dist_pct_l1", "numeric_dist_pct_d1", "wtd_dist_val_l1", "wtd_dist_val_d1",
        "num_stores_l1", "num_stores_d1", "ms_value_l1", "ms_value_d1",
        "volume_tonnes_l1", "volume_tonnes_d1", "sah_l1", "sah_d1",
        "str_days_l1", "str_days_d1", "pdo_rs_l1", "pdo_rs_d1",
        "month", "is_festive", "brand_code", "zone_code",
    ]


def test_target_without_logarithm_gives_null(spark, rows):
    bad = [dict(r) for r in rows if r["brand"] == "amber" and r["zone"] == "east"]
    bad[5]["value_lakhs"] = 0.0
    got = {r["date"]: r for r in X.transform(frame(spark, bad)).collect()}
    assert got[bad[5]["date"]]["ly"] is None
    assert got[bad[6]["date"]]["ly_l1"] is None
    assert got[bad[6]["date"]]["sd6"] is not None


def test_scoring_frame_equals_the_transformed_extended_panel(panel, codes):
    month = date(2020, 1, 1)
    extended = X.extended_panel(panel)
    assert extended.count() == panel.count() + len(ENTITIES) * len(SEGMENTS)
    want = collected(X.transform(extended, SPEC, codes).where(F.col("date") == F.lit(month)))
    got = collected(X.scoring_frame(panel, SPEC, codes), "target_month")
    assert got.keys() == want.keys()
    for key, row in got.items():
        for name in SPEC.feature_order:
            assert row[name] == pytest.approx(want[key][name], abs=1e-12), name


def test_series_that_ended_early_is_scored_from_its_own_rows(spark, rows):
    stale = [r for r in rows if not (r["brand"] == "elm" and r["date"] > date(2019, 6, 1))]
    got = collected(X.scoring_frame(frame(spark, stale)), "target_month")
    assert len(got) == 10
    last = [r for r in stale if r["brand"] == "elm" and r["zone"] == "east"][-1]
    assert got["elm", "east", date(2020, 1, 1)]["ly_l1"] == pytest.approx(
        math.log(last["value_lakhs"])
    )


def test_scoring_refuses_or_keeps_short_history(spark, rows):
    short = [r for r in rows if not (r["brand"] == "elm" and r["date"] < date(2019, 10, 1))]
    scoring = X.scoring_frame(frame(spark, short))
    for read in (lambda: scoring.select("ly_l1").collect(), lambda: scoring.select("brand", "d_l3").collect(), scoring.count):
        with pytest.raises(Exception, match="series too short for its features.*elm"):
            read()
    kept = X.scoring_frame(frame(spark, short), on_incomplete="keep").collect()
    assert sum(r["d_l3"] is None for r in kept) == 2


def test_target_month_from_any_day_of_the_month(spark):
    for day in (date(2019, 8, 1), date(2019, 8, 15)):
        got = X.target_month(frame(spark, make_rows(months=[day]))).head()
        assert got["target_month"] == date(2019, 9, 1)


def test_series_last_takes_the_last_known_value_per_column(spark, rows):
    holed = [dict(r) for r in rows]
    for r in holed:
        if r["brand"] == "amber" and r["date"] == MONTHS[-1]:
            r["sah"] = None
    got = {(r["brand"], r["zone"]): r for r in X.series_last(frame(spark, holed)).collect()}
    want = [r for r in rows if r["brand"] == "amber" and r["zone"] == "east"]
    assert got["amber", "east"]["sah"] == want[-2]["sah"]
    assert got["amber", "east"]["pdo_rs"] == want[-1]["pdo_rs"]


def test_training_rows_start_at_index_four(panel):
    cleaned = X.training_frame(panel, "2019-06-01")
    first = cleaned.groupBy("brand", "zone").agg(F.min("date").alias("d")).collect()
    # a lag four back is the binding one; shorter frames already give a value
    assert {r["d"] for r in first} == {MONTHS[4]}
    stamps = cleaned.groupBy("__split").agg(F.max("date"), F.min("date")).collect()
    assert {tuple(r) for r in stamps} == {
        ("train", date(2019, 6, 1), MONTHS[4]),
        ("test", MONTHS[-1], date(2019, 7, 1)),
    }


def test_reconstruct_inverts_the_target(panel):
    steps = X.add_training_target(X.transform(panel)).where("target_d IS NOT NULL")
    back = X.reconstruct(F.col("ly_l1"), F.col("target_d"))
    assert steps.agg(F.max(F.abs(back - F.col("y")))).head()[0] < 1e-9


def test_align_orders_drops_and_refuses(panel, codes):
    out = X.transform(panel, SPEC, codes)
    assert X.align(out.select(*reversed(out.columns)), SPEC.feature_order).columns == (
        SPEC.feature_order
    )
    with pytest.raises(ValueError, match="rm6"):
        X.align(out.drop("rm6"), SPEC.feature_order)


def test_column_order_does_not_matter(panel):
    shuffled = panel.select(*reversed(panel.columns))
    cols = [*SPEC.key, *SPEC.numeric_features]
    a, b = (collected(X.transform(p).select(*cols)) for p in (panel, shuffled))
    for key in a:
        assert a[key].asDict() == pytest.approx(b[key].asDict(), abs=1e-12)


def test_codes_are_sorted_ranks_and_unseen_is_null(spark, panel, codes):
    assert {r["value"]: r["code"] for r in codes.entity.collect()} == {
        e: i for i, e in enumerate(ENTITIES)
    }
    assert {r["value"]: r["code"] for r in codes.segment.collect()} == {"east": 0, "west": 1}
    strange = frame(spark, make_rows(entities=["zzz"], months=MONTHS[:1]))
    assert {r["brand_code"] for r in encoding.apply_codes(strange, codes).collect()} == {None}


def test_indexer_keeps_the_full_vocabulary_of_a_small_payload(spark, codes):
    small = frame(spark, make_rows(entities=ENTITIES[:2], months=MONTHS[:2]))
    entity, _ = encoding.nominal_indexers(codes)
    out = entity.transform(small)
    assert out.schema["brand_code"].metadata["ml_attr"]["vals"] == ENTITIES
    assert {(r["brand"], r["brand_code"]) for r in out.collect()} == {("amber", 0.0), ("birch", 1.0)}


# Leakage


def test_no_feature_moves_when_its_own_month_is_corrupted(panel):
    result = checks.leakage_perturbation(panel).collect()
    assert len(result) == len(SPEC.numeric_features)
    assert all(r["n_rows"] == 10 and r["max_abs_diff"] < 1e-12 and not r["leaks"] for r in result)


def test_perturbation_check_sees_a_leak(panel):
    # the corrupted month does move the features of rows that may use it
    last = F.lit(MONTHS[-2])
    bent = checks.perturb_month(panel, last, SPEC)
    a, b = (collected(X.transform(p)) for p in (panel, bent))
    key = ("amber", "east", MONTHS[-1])
    assert abs(a[key]["share_l1"] - b[key]["share_l1"]) > 1e-6


def test_leaving_out_an_entity_moves_the_share_of_the_others(panel):
    got = checks.partial_segment_effect(panel, "amber").head()
    assert got["n_moved"] == got["n_rows"] > 0 and got["max_abs_gap"] > 1e-9


def test_degenerate_identity_and_warmup(panel):
    features = X.transform(panel)
    assert checks.degeneracy(features).head()["holds"]
    assert all(r["n_null"] == 0 for r in checks.warmup_nulls(features).collect())


def test_equality_scan_flags_only_a_real_copy(panel):
    features = X.transform(panel).withColumn("rm6", F.col("sah"))
    result = checks.leakage_equality(features, SPEC.numeric_features, SPEC.metrics).collect()
    assert {(r["feature"], r["metric"]) for r in result if r["same"]} == {("rm6", "sah")}
    assert len(result) == len(SPEC.numeric_features) * len(SPEC.metrics)


def test_shift_identity(panel):
    got = checks.leakage_shift(X.transform(panel)).head()
    assert got["n_rows"] == 10 * 23 and got["max_abs_gap"] == 0.0


def test_statistics_fitted_on_train_ignore_later_rows(spark, rows):
    from panelcast.operators import cleaning

    cut = [r for r in rows if r["date"] <= date(2019, 6, 1)]

    def fitted(rs):
        stamped = X.stamp_split(frame(spark, rs), "2019-06-01")
        fences = cleaning.fit_fences(stamped, list(SPEC.exog), 3.0, SPEC)
        return {(r["brand"], r["zone"]): r for r in fences.collect()}

    assert fitted(rows) == fitted(cut)
