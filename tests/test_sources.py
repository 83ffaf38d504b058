"""Readers, the cross-tab, and the outputs of a run."""

from __future__ import annotations

import csv
import json
from datetime import date

import pytest
from conftest import ENTITIES, MONTHS, SEGMENTS, SPEC, frame, make_rows
from pyspark.sql import functions as F

from panelcast.functions import columns as C
from panelcast.functions import lineage
from panelcast.operators.baselines import fallback_forecast
from panelcast.operators.features import training_frame
from panelcast.operators.reconcile import tag
from panelcast.sources import crosstab as T
from panelcast.sources import sinks
from panelcast.sources.panel import read_panel

BLOCK = ["value_lakhs", "% Grwth YA", *SPEC.exog[:4], "% Grwth YA", *SPEC.exog[4:]]
NAMES = ["value_lakhs", "val_growth", *SPEC.exog[:4], "vol_growth", *SPEC.exog[4:]]
DERIVED = ("val_growth", "vol_growth")
OTHERS = ["MATERIAL_COST", "QTR_TARGET_ID", "YTD_ID"]


def write_crosstab(path, rows, swap=False):
    months = [T.month_label(d) for d in MONTHS]
    by_series = {}
    for r in rows:
        by_series.setdefault((r["brand"], r["zone"]), {})[r["date"]] = r
    with open(path, "w", newline="") as fh:
        out = csv.writer(fh)
        out.writerow(["BRAND", "ZONES", "METRICS", *months, "YTD TY", " MAT LY"])
        for (b, z), at in by_series.items():
            order = list(zip(BLOCK, NAMES))
            if swap and (b, z) == ("elm", "west"):
                order[0], order[2] = order[2], order[0]
            for label, name in order:
                cells = [at[d].get(name, "ERR") if d in at else "" for d in MONTHS]
                out.writerow([b, z, label, *cells, 1.0, 2.0])


def test_csv_and_parquet_panels(spark, tmp_path, rows):
    panel = frame(spark, rows)
    panel.write.parquet(str(tmp_path / "p"))
    panel.write.option("header", True).csv(str(tmp_path / "c"))
    a = read_panel(spark, str(tmp_path / "p"))
    b = read_panel(spark, str(tmp_path / "c"), "csv")
    assert a.dtypes == b.dtypes
    assert a.exceptAll(b).count() == 0 and b.count() == len(rows)


def test_nan_becomes_null_on_ingest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r["x"] for r in C.blank_to_null(df, ["x"]).collect()] == [None, 1.0]


def test_missing_part_gives_no_series_id(spark):
    df = spark.createDataFrame([("a", None), ("a", "e")], "brand string, zone string")
    assert [r[0] for r in df.select(C.series_id(SPEC)).collect()] == [None, "a|e"]


def test_month_labels():
    assert T.month_of_label("JUN17") == date(2017, 6, 1)
    assert T.month_of_label(" AUG95 ") == date(1995, 8, 1)
    assert [T.month_of_label(c) for c in ("YTD TY", "MAT LY", "BRAND", "JUNE7")] == [None] * 4
    assert all(T.month_of_label(T.month_label(d)) == d for d in MONTHS)


def test_crosstab_is_named_by_position(spark, tmp_path, rows):
    path = str(tmp_path / "wide.csv")
    gappy = [r for r in rows if not (r["brand"] == "birch" and r["date"] == MONTHS[3])]
    write_crosstab(path, gappy)
    raw = T.read_crosstab(spark, path)
    assert "MAT LY" in raw.columns
    kept = T.drop_leakage(raw)
    assert not {"YTD TY", "MAT LY"} & set(kept.columns)
    T.require_constant_blocks(kept, NAMES)
    assert T.drop_leakage(raw.withColumns({c: F.lit(1) for c in OTHERS})).columns == [*kept.columns, *OTHERS]
    with pytest.raises(Exception, match="not a number: val_growth"):
        T.flatten_crosstab(kept, NAMES).collect()
    flat = T.drop_leakage(T.flatten_crosstab(kept, NAMES, derived=DERIVED), list(DERIVED))
    got = {(r["brand"], r["zone"], r["date"]): r for r in flat.collect()}
    assert len(got) == len(gappy)
    for r in gappy:
        for m in SPEC.metrics:
            assert got[r["brand"], r["zone"], r["date"]][m] == pytest.approx(r[m])


def test_crosstab_with_a_reordered_block_is_reported(spark, tmp_path, rows):
    path = str(tmp_path / "wide.csv")
    write_crosstab(path, rows, swap=True)
    found = T.block_violations(T.read_crosstab(spark, path), NAMES).collect()
    assert {(r["problem"], r["place"]) for r in found} == {("label", "1"), ("label", "3")}
    with pytest.raises(ValueError, match="metric blocks differ: label at"):
        T.flatten_crosstab(T.read_crosstab(spark, path), NAMES)
    short = T.block_violations(T.read_crosstab(spark, path), NAMES[:-1]).where("problem = 'size'")
    assert short.count() == len(ENTITIES) * len(SEGMENTS)


def test_a_month_without_a_column_fails_the_job(panel):
    labelled = [(m, m.upper()) for m in SPEC.metrics]
    assert T.months_of(panel) == MONTHS
    assert T.to_crosstab(panel, labelled, MONTHS).count() == 10 * len(labelled)
    with pytest.raises(Exception, match="month without a column"):
        T.to_crosstab(panel, labelled, MONTHS[:-1]).collect()


def test_label_cleaning(spark):
    df = spark.createDataFrame([("  dark   brown\tbar ",)], "x string")
    assert df.select(C.standard_label("x")).head()[0] == "DARK BROWN BAR"


def test_prediction_log_appends_by_day(spark, tmp_path, panel):
    path = str(tmp_path / "log")
    rows = tag(fallback_forecast(panel), "fallback", "none", run_id="r1")
    sinks.append_prediction_log(rows, path, "2020-01-05")
    sinks.append_prediction_log(rows, path, "2020-01-05")
    sinks.append_prediction_log(rows, path, "2020-01-06")
    back = spark.read.json(path)
    assert {(str(r["dt"]), r["count"]) for r in back.groupBy("dt").count().collect()} == {
        ("2020-01-05", 20),
        ("2020-01-06", 10),
    }
    line = next((tmp_path / "log" / "dt=2020-01-06").glob("*.json")).read_text().splitlines()[0]
    assert json.loads(line)["source"] == "fallback" and json.loads(line)["run_id"] == "r1"


def test_reference_is_replaced_and_metrics_append(spark, tmp_path, panel):
    cleaned = training_frame(panel, "2019-06-01")
    path = str(tmp_path / "reference")
    sinks.write_reference(cleaned, path)
    sinks.write_reference(cleaned, path)
    back = spark.read.parquet(path)
    assert {r["__split"] for r in back.select("__split").distinct().collect()} == {"train"}
    assert back.count() == cleaned.where("__split = 'train'").count()
    metrics = spark.createDataFrame([("m", 1.0)], "metric string, value double")
    for run in ("r1", "r2"):
        sinks.append_metrics(metrics, str(tmp_path / "metrics"), run)
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2


def test_materialise_writes_under_the_configured_folder(spark):
    folder = spark.conf.get(lineage.CHECKPOINT_CONF)
    df = frame(spark, make_rows(months=MONTHS[:2])).where(F.col("brand") == "amber")
    kept = lineage.materialise(df)
    assert all(folder in f for f in kept.inputFiles())
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert kept.exceptAll(df).count() == 0
