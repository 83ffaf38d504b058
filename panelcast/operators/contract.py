"""Data contract of a payload: what must hold before features are built.

The panel is read once, into a per-series summary with two levels of map-side
combined aggregation; every rule is then a small query on that summary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import longer, series_id
from panelcast.functions.lineage import materialise
from panelcast.operators.encoding import CodeMaps
from panelcast.sources.panel import missing_columns
from panelcast.spec import SPLIT, TRAIN, PanelSpec

# Order in which a violation is raised.
RULES = {
    "required_columns": 1,
    "unknown_entity": 2,
    "unknown_segment": 3,
    "null_metric": 4,
    "nonpositive_target": 5,
    "short_history": 6,
    "incomplete_segment": 7,
    # reported, but outside the rules that refuse a payload
    "duplicate_keys": 8,
}
REFUSING = 7


class ContractViolation(ValueError):
    """The payload does not satisfy the data contract."""

    def __init__(self, rule: str, detail: str):
        super().__init__(f"{rule}: {detail}")
        self.rule = rule


def series_summary(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per series: rows, distinct dates, duplicate keys, nulls per metric, bad targets."""
    nulls = [f"_null_{m}" for m in spec.metrics]
    cells = panel.groupBy(*spec.key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(spec.target) <= 0).alias("bad"),
        *[F.count_if(F.col(m).isNull()).alias(c) for m, c in zip(spec.metrics, nulls)],
    )
    return cells.groupBy(*spec.series).agg(
        F.sum("n").alias("n_rows"),
        F.count(spec.date).alias("n_dates"),
        F.count_if(F.col("n") > 1).alias("n_duplicated"),
        F.sum("bad").alias("n_nonpositive"),
        *[F.sum(c).alias(c) for c in nulls],
    )


def history_depth(
    panel: DataFrame, spec: PanelSpec = PanelSpec(), minimum: int | None = None
) -> DataFrame:
    """Rows per series, for series with fewer than ``minimum``."""
    minimum = spec.min_history if minimum is None else minimum
    depth = panel.groupBy(*spec.series).agg(F.count(F.lit(1)).alias("n_rows"))
    return depth.where(F.col("n_rows") < minimum)


def unknown_members(
    summary: DataFrame, vocabulary: DataFrame, column: str
) -> DataFrame:
    """Distinct values absent from the vocabulary."""
    seen = summary.select(F.col(column).alias("value")).distinct()
    return seen.join(vocabulary.select("value"), "value", "left_anti").select(
        F.lit(column).alias("column"), "value"
    )


def null_counts(summary: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Required metrics that hold nulls, with their number."""
    one = summary.agg(*[F.sum(f"_null_{m}").alias(m) for m in spec.metrics])
    return longer(one, [], spec.metrics, "metric", "n_null").where("n_null > 0")


def nonpositive_target(summary: DataFrame) -> DataFrame:
    """Number of rows whose target has no logarithm (none: no row)."""
    return summary.agg(F.coalesce(F.sum("n_nonpositive"), F.lit(0)).alias("n_rows")).where(
        "n_rows > 0"
    )


def short_history(
    summary: DataFrame, spec: PanelSpec = PanelSpec(), minimum: int | None = None
) -> DataFrame:
    """Series with fewer distinct dates than required."""
    minimum = spec.min_history if minimum is None else minimum
    return summary.where(F.col("n_dates") < minimum).select(*spec.series, "n_dates")


def incomplete_segments(summary: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Segments holding fewer entities than the payload has anywhere."""
    expected = summary.agg(F.count_distinct(spec.entity)).scalar()
    # a summary row is one entity of the segment; count() skips a missing name
    held = summary.groupBy(spec.segment).agg(F.count(spec.entity).alias("n_entities"))
    return held.withColumn("n_expected", expected).where("n_entities < n_expected")


def duplicate_keys(summary: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Series in which some month occurs more than once."""
    return summary.where("n_duplicated > 0").select(*spec.series, "n_duplicated")


def contract_report(
    panel: DataFrame, codes: CodeMaps, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Every violation as (rule_no, rule, key, observed, expected); empty when clean."""
    spark = panel.sparkSession
    schema = "rule_no int, rule string, key string, observed bigint, expected bigint"
    absent = missing_columns(panel, spec)
    if absent:
        rows = [(RULES["required_columns"], "required_columns", c, 0, 1) for c in absent]
        return spark.createDataFrame(rows, schema)

    summary = materialise(series_summary(panel, spec))

    def rows(df: DataFrame, rule: str, key, observed, expected) -> DataFrame:
        return df.select(
            F.lit(RULES[rule]).alias("rule_no"),
            F.lit(rule).alias("rule"),
            key.alias("key"),
            observed.cast("bigint").alias("observed"),
            expected.cast("bigint").alias("expected"),
        )

    zero, one = F.lit(0), F.lit(1)
    value, sid = F.col("value"), series_id(spec)
    found = [
        rows(
            unknown_members(summary, codes.entity, spec.entity), "unknown_entity", value, one, zero
        ),
        rows(
            unknown_members(summary, codes.segment, spec.segment),
            "unknown_segment",
            value,
            one,
            zero,
        ),
        rows(null_counts(summary, spec), "null_metric", F.col("metric"), F.col("n_null"), zero),
        rows(
            nonpositive_target(summary),
            "nonpositive_target",
            F.lit(spec.target),
            F.col("n_rows"),
            zero,
        ),
        rows(
            short_history(summary, spec),
            "short_history",
            sid,
            F.col("n_dates"),
            F.lit(spec.min_history),
        ),
        rows(
            incomplete_segments(summary, spec),
            "incomplete_segment",
            F.col(spec.segment),
            F.col("n_entities"),
            F.col("n_expected"),
        ),
        rows(duplicate_keys(summary, spec), "duplicate_keys", sid, F.col("n_duplicated"), zero),
    ]
    return reduce(DataFrame.unionByName, found)


def first_offenders(report: DataFrame, n: int = 3) -> DataFrame:
    """The report's first ``n`` rows of each rule by key, with how many the rule has."""
    ordered = Window.partitionBy("rule_no").orderBy("key")
    counts = report.groupBy("rule_no").agg(F.count(F.lit(1)).alias("n_offenders"))
    first = report.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= n)
    return first.join(counts, "rule_no").select("rule_no", "rule", "place", "key", "observed", "expected", "n_offenders")


def enforce(report: DataFrame, upto: int = REFUSING) -> None:
    """Raise on the first violated rule, naming at most five offenders of it."""
    refusing = report.where(F.col("rule_no") <= upto)
    first = refusing.orderBy("rule_no", "key").limit(5).collect()
    if first:
        rule = first[0]["rule"]
        detail = "; ".join(
            f"{r['key']} (observed {r['observed']}, expected {r['expected']})"
            for r in first
            if r["rule"] == rule
        )
        raise ContractViolation(rule, detail)


def fit_ranges(stamped: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per column, what the train rows show: type, nullability, range, category count.

    ``nullable`` is measured for every column, and a column is ``required`` if train never
    lacks it. ``n_allowed`` is NULL for a column that is not a category; the categories
    themselves are in ``fit_allowed``. Categories are counted among the distinct series.
    """
    train = stamped.where(F.col(SPLIT) == TRAIN)
    types = {f.name: f.dataType.simpleString() for f in stamped.schema.fields}
    columns = [*spec.series, spec.date, *spec.metrics]
    values = [*(F.min(c).alias(f"{c}__min") for c in spec.metrics)]
    values += [*(F.max(c).alias(f"{c}__max") for c in spec.metrics)]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in columns]
    one = train.agg(*values, *nulls)
    members = train.select(*spec.series).distinct()
    for c in spec.series:
        one = one.withColumn(f"{c}__n", members.agg(F.count_distinct(c)).scalar())

    def entry(c: str) -> Column:
        ranged, counted = c in spec.metrics, c in spec.series
        return F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("dtype"),
            (F.col(f"{c}__nulls") > 0).alias("nullable"),
            (F.col(f"{c}__min") if ranged else F.lit(None)).cast("double").alias("min_value"),
            (F.col(f"{c}__max") if ranged else F.lit(None)).cast("double").alias("max_value"),
            (F.col(f"{c}__n") if counted else F.lit(None)).cast("bigint").alias("n_allowed"),
            (F.col(f"{c}__nulls") == 0).alias("required"),
        )

    return one.select(F.inline(F.array(*[entry(c) for c in columns])))


def fit_allowed(stamped: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """(column_name, value): the categories that the train rows have."""
    pair = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in spec.series
    ]
    members = stamped.where(F.col(SPLIT) == TRAIN).select(*spec.series).distinct()
    return members.select(F.inline(F.array(*pair))).where("value IS NOT NULL").distinct()


def range_violations(stamped: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Rows outside train whose value leaves the train range, counted per column."""
    is_train = F.col(SPLIT) == TRAIN
    bounds = stamped.where(is_train).agg(
        F.struct(
            *[F.min(m).alias(f"{m}__lo") for m in spec.metrics],
            *[F.max(m).alias(f"{m}__hi") for m in spec.metrics],
        )
    )
    later = stamped.where(~is_train).withColumn("_b", bounds.scalar())
    below = [F.count_if(F.col(m) < F.col(f"_b.{m}__lo")).alias(f"{m}__below") for m in spec.metrics]
    above = [F.count_if(F.col(m) > F.col(f"_b.{m}__hi")).alias(f"{m}__above") for m in spec.metrics]
    one = later.agg(*below, *above)
    entries = [
        F.struct(
            F.lit(m).alias("column_name"),
            F.col(f"{m}__below").alias("n_below"),
            F.col(f"{m}__above").alias("n_above"),
        )
        for m in spec.metrics
    ]
    return one.select(F.inline(F.array(*entries)))
