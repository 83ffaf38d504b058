"""What the queries over single parts and the ridge backtest build and write, counted on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from panelcast.plans import catalog
from panelcast.sources.star import monthly_panel
from panelcast.spec import SPLIT

FOLDER = os.environ.get("PANELCAST_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture
def counted(monkeypatch):
    """Panels built and columns of the tables that the catalog itself writes."""
    panels, tables = [], []

    def build(*args, **kwargs):
        panels.append(args)
        return monthly_panel(*args, **kwargs)

    def write(df, keep=catalog.materialise):
        tables.append(df.columns)
        return keep(df)

    monkeypatch.setattr(catalog, "monthly_panel", build)
    monkeypatch.setattr(catalog, "materialise", write)
    return panels, tables


def test_part_features_write_no_second_panel(spark, counted):
    panels, tables = counted
    assert catalog.part_features(spark, FOLDER).columns[:3] == catalog.SPEC.key
    assert len(panels) == 1 and tables == []


def test_ridge_backtest_builds_one_panel(spark, counted):
    panels, _ = counted
    out = catalog.ridge_backtest(spark, FOLDER)
    assert out.columns == ["candidate", "metric", "value"]
    assert len(panels) == 1


def test_the_part_fit_writes_only_what_it_reads(spark, counted, monkeypatch):
    rows = [(f"p{i % 5}", "EAST", i, 0.1 * i, 0.2 * (i % 3), "train", 0.3 * (i % 4)) for i in range(20)]
    steps = spark.createDataFrame(rows, f"brand string, zone string, date int, step double, step_l1 double, {SPLIT} string, encoded double")
    monkeypatch.setattr(catalog, "_part_steps", lambda *_: steps)
    assert catalog.part_ridge(spark, FOLDER).select(F.col("n")).head()[0] == 20
    assert counted[1] == [["step", "encoded", "step_l1"]]
