"""Wide audit cross-tab to panel and back.

A cross-tab has one block of metric rows per (entity, segment) and one column per
month. Metric labels repeat inside a block, so rows are named by position.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.spec import PanelSpec

MONTH_NAMES = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()

# Names of the period columns whose window contains the target month. Only
# whole names count, so a column that merely begins alike stays.
AGGREGATE_PERIODS = re.compile(r"YEC ?\d{2}|QTRFC ?\d{4}|YTD( (TY|LY|YA))?|MAT( (TY|LY|YA))?")


def month_label(d: date) -> str:
    return f"{MONTH_NAMES[d.month - 1]}{d.year % 100:02d}"


def month_of_label(label: str, pivot_year: int = 70) -> date | None:
    """First day of the month a column label such as ``JUN17`` stands for, else None."""
    label = label.strip().upper()
    if len(label) != 5 or label[:3] not in MONTH_NAMES or not label[3:].isdigit():
        return None
    short = int(label[3:])
    century = 1900 if short >= pivot_year else 2000
    return date(century + short, MONTH_NAMES.index(label[:3]) + 1, 1)


def months_between(first: date, end: date) -> list[date]:
    """Month starts from ``first`` up to, not including, ``end``."""
    n = (end.year - first.year) * 12 + end.month - first.month
    return [
        date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1)
        for i in range(n)
    ]


def months_of(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> list[date]:
    """Every month from the panel's first to its last."""
    first, last = panel.agg(F.min(spec.date), F.max(spec.date)).first()
    if first is None:
        return []
    return months_between(first, (last.replace(day=28) + timedelta(days=4)).replace(day=1))


def trimmed(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks (some period columns carry one)."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_leakage(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop aggregate-period columns, or the given ones, and assert they are gone."""
    df = trimmed(df)
    if names is None:
        names = [c for c in df.columns if AGGREGATE_PERIODS.fullmatch(c.upper())]
    out = df.drop(*names)
    left = [c for c in out.columns if c in names]
    if left:
        raise ValueError(f"leakage columns still present: {left}")
    return out


def read_crosstab(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """Cross-tab with ``_row``, a sortable file position that keeps the source order."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader
    raw = reader.format(fmt).load(path)
    place = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("n"),
    )
    return trimmed(raw.select("*", place.alias("_row")))


def _position(row: str) -> Column:
    return F.row_number().over(Window.partitionBy("BRAND", "ZONES").orderBy(row))


def block_violations(crosstab: DataFrame, metrics: list[str], row: str = "_row") -> DataFrame:
    """Positions whose label differs between blocks, and blocks of a wrong size."""
    placed = crosstab.select("BRAND", "ZONES", "METRICS", _position(row).alias("position"))
    labels = (
        placed.groupBy("position")
        .agg(F.count_distinct("METRICS").alias("n"))
        .where("n > 1")
        .select(F.lit("label").alias("problem"), F.col("position").cast("string").alias("place"))
    )
    sizes = (
        placed.groupBy("BRAND", "ZONES")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") != len(metrics))
        .select(F.lit("size").alias("problem"), F.concat_ws("|", "BRAND", "ZONES").alias("place"))
    )
    return labels.unionByName(sizes)


def require_constant_blocks(crosstab: DataFrame, metrics: list[str], row: str = "_row") -> None:
    """Naming rows by position is only right when every block lists them alike."""
    found = block_violations(crosstab, metrics, row).limit(5).collect()
    if found:
        places = ", ".join(f"{r['problem']} at {r['place']}" for r in found)
        raise ValueError(f"metric blocks differ: {places}")


def flatten_crosstab(
    crosstab: DataFrame,
    metrics: list[str],
    spec: PanelSpec = PanelSpec(),
    row: str = "_row",
    derived: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (entity, segment, month) with the metrics named by position.

    Blocks that do not list their rows alike are refused before anything is named.
    Months come from the column labels; a month without any value is not a row. Only rows
    of ``derived`` metrics may hold error sentinels, which are no values; any other text
    that is not a number fails the job.
    """
    require_constant_blocks(crosstab, metrics, row)
    labels = {c: d for c in crosstab.columns if (d := month_of_label(c))}
    name = F.element_at(F.array(*[F.lit(m) for m in metrics]), _position(row))
    named = crosstab.select("BRAND", "ZONES", name.alias("metric"), *labels)

    def value(c: str) -> Column:
        number = F.col(c).try_cast("double")
        blank = F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
        wrong = F.concat(F.lit("not a number: "), F.col("metric"), F.lit(f" in {c}"))
        return F.when(
            number.isNull() & ~blank & ~F.col("metric").isin(*derived),
            F.raise_error(wrong).cast("double"),
        ).otherwise(number)

    cells = F.array(
        *[F.struct(F.lit(d).alias("date"), value(c).alias("value")) for c, d in labels.items()]
    )
    long = named.select("BRAND", "ZONES", "metric", F.inline(cells)).where("value IS NOT NULL")
    wide = long.groupBy("BRAND", "ZONES", "date").pivot("metric", metrics).agg(F.first("value"))
    return wide.select(
        F.col("BRAND").alias(spec.entity),
        F.col("ZONES").alias(spec.segment),
        F.col("date").alias(spec.date),
        *metrics,
    )


def to_crosstab(
    panel: DataFrame,
    labelled: list[tuple[str, str]],
    months: list[date],
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Panel to cross-tab; ``labelled`` gives (column, label shown) in block order.

    A row of a month outside ``months`` fails the job.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("_row"), F.lit(label).alias("METRICS"), F.col(c).alias("value")
            )
            for i, (c, label) in enumerate(labelled, start=1)
        ]
    )
    long = panel.select(*spec.key, F.inline(cells))
    at = {
        month_label(d): F.max(F.when(F.col(spec.date) == F.lit(d), F.col("value"))) for d in months
    }
    unknown = F.raise_error(F.lit("month without a column")).cast("string")
    entity = F.when(F.col(spec.date).isin(months), F.col(spec.entity)).otherwise(unknown)
    return long.groupBy(
        entity.alias("BRAND"), F.col(spec.segment).alias("ZONES"), "_row", "METRICS"
    ).agg(*[c.alias(label) for label, c in at.items()])
