"""A local session and a small deterministic panel."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import SparkSession

from panelcast.sources.crosstab import months_between
from panelcast.spec import PanelSpec

SPEC = PanelSpec()
ENTITIES = ["amber", "birch", "cedar", "dune", "elm"]
SEGMENTS = ["east", "west"]
MONTHS = months_between(date(2018, 1, 1), date(2020, 1, 1))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("panelcast-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_rows(entities=ENTITIES, segments=SEGMENTS, months=MONTHS, seed=7) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for e in entities:
        for s in segments:
            level = rng.uniform(20, 200)
            for d in months:
                season = 1.3 if d.month in (8, 9, 10, 11) else 1.0
                row = {"brand": e, "zone": s, "date": d}
                row["value_lakhs"] = level * season * rng.uniform(0.9, 1.1)
                for c in SPEC.exog:
                    row[c] = rng.uniform(1, 50)
                rows.append(row)
    return rows


def frame(spark, rows, spec=SPEC):
    order = spec.schema.fieldNames()
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], spec.schema)


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def panel(spark, rows):
    return frame(spark, rows).persist()


@pytest.fixture(scope="session")
def codes(panel):
    from panelcast.operators.encoding import fit_codes

    return fit_codes(panel)
