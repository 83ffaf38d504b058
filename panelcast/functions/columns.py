"""Scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.spec import PanelSpec


def series_id(spec: PanelSpec) -> Column:
    # concat, not concat_ws: a missing part must not produce a valid-looking id
    return F.concat(F.col(spec.entity), F.lit("|"), F.col(spec.segment))


def month_start(c: Column | str) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "MM")


def next_month(c: Column | str) -> Column:
    return F.add_months(month_start(c), 1).cast("date")


def calendar_columns(date: Column, spec: PanelSpec) -> dict[str, Column]:
    month = F.month(date)
    return {
        "month": month,
        "is_festive": month.isin(*spec.festive_months).cast("int"),
        "is_summer": month.isin(*spec.summer_months).cast("int"),
    }


def log_positive(c: Column | str) -> Column:
    """Natural log; NULL where the value is not positive."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, F.ln(c))


def pct_change(new: Column, old: Column) -> Column:
    return (F.try_divide(new, old) - 1.0) * 100.0


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN becomes NULL: Spark orders NaN as largest and sums propagate it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def standard_label(c: Column | str) -> Column:
    """Trimmed, inner whitespace collapsed, upper case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def longer(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows, through one array so a single pass of ``df`` is enough."""
    pairs = ", ".join(f"named_struct('{name}', '{v}', '{value}', `{v}`)" for v in values)
    return df.selectExpr(*[f"`{c}`" for c in ids], f"inline(array({pairs}))")
