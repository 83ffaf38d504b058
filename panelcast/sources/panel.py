"""Reading, filtering and profiling a ready-made panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.columns import blank_to_null, month_start
from panelcast.spec import SPLIT, PanelSpec


def read_panel(
    spark: SparkSession, path: str, fmt: str = "parquet", spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Panel with a declared schema; Parquet preferred, CSV with a header accepted."""
    reader = spark.read.schema(spec.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return blank_to_null(reader.format(fmt).load(path), spec.metrics)


def missing_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    return [c for c in spec.columns if c not in df.columns]


def drop_total(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keep real segments; the total is rebuilt bottom-up."""
    return panel.where(F.col(spec.segment) != spec.total_label)


def segment_subset(panel: DataFrame, segments: list[str], spec: PanelSpec) -> DataFrame:
    return panel.where(F.col(spec.segment).isin(segments))


def latest_months(panel: DataFrame, n: int, spec: PanelSpec) -> DataFrame:
    """Rows of the ``n`` latest distinct months.

    Only the distinct months are ordered; the limit is the feature itself, and the
    resulting first month is a scalar, so the panel is filtered without a join.
    """
    months = panel.select(spec.date).distinct().orderBy(F.desc(spec.date)).limit(n)
    first = months.agg(F.min(spec.date)).scalar()
    return panel.where(F.col(spec.date) >= first)


def with_total_rows(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Panel of (key, target) plus rows that sum the segments under the total label."""
    levels = panel.select(*spec.key, spec.target)
    totals = (
        levels.groupBy(spec.entity, spec.date)
        .agg(F.sum(spec.target).alias(spec.target))
        .withColumn(spec.segment, F.lit(spec.total_label))
    )
    return levels.unionByName(totals)


def panel_profile(stamped: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows, series and month range of the whole panel and of each split."""
    by_series = stamped.groupBy(*spec.series, SPLIT).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(spec.date).alias("first"),
        F.max(spec.date).alias("last"),
    )
    scoped = by_series.withColumn("scope", F.explode(F.array(F.lit("all"), F.col(SPLIT))))
    one_per_series = scoped.groupBy("scope", *spec.series).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return one_per_series.groupBy("scope").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
        F.min("first").alias("first_month"),
        F.max("last").alias("last_month"),
    )


def data_fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """Content digest that ignores row order and partitioning.

    Rows are written out as text, numbers as whole multiples of 10^-``digits``, so that any
    engine with MD5 gets the same digest; a NULL differs from an empty text.
    """

    def text(name: str, kind: str) -> Column:
        value = F.col(name)
        if kind in ("double", "float"):
            value = F.rint(value * 10.0**digits).cast("decimal(38,0)")
        return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))

    row = F.concat_ws("|", *[text(name, kind) for name, kind in df.dtypes])
    h = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum("h").alias("hash_sum"),
    )


def normalise_dates(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Dates given as text or as any day of the month become month starts."""
    return panel.withColumn(spec.date, month_start(F.to_date(spec.date)))
