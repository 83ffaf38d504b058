"""Drift of later rows against the training reference, from mergeable histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import longer

# ln(1.02): a bin's ends differ by two per cent of the value.
LOG_GROWTH = 0.01980262729617973
# Added to a bin's exponent, so that bins of small values keep the sign of the value.
OFFSET = 100_000
# Usual reading of the index: below 0.1 stable, from 0.25 on shifted.
MODERATE, SHIFTED = 0.1, 0.25
MISSING = -1


def bin_of(value: Column) -> Column:
    """Ordered integer bin of a number, the same for every table; NULL for a missing one."""
    size = F.ceil(F.ln(F.abs(value)) / F.lit(LOG_GROWTH)).cast("int") + OFFSET
    known = value.isNotNull() & ~F.isnan(value)
    return F.when(known & (value > 0), size).when(known & (value < 0), -size).when(known, 0)


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, bin, n) of each column: one pass, a row for each bin that has values.

    Bins depend on nothing but the value, so histograms of parts of a table add up to the
    table's (``merge``), and what a reference keeps is bounded by the range of its values.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = longer(numbers, [], columns, "feature", "value")
    return rows.groupBy("feature", bin_of(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    """The histogram of all rows behind the given ones."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("feature", "bin").agg(F.sum("n").alias("n"))


def drift(reference: DataFrame, payload: DataFrame, groups: int = 10) -> DataFrame:
    """Per feature, how far the payload's distribution is from the reference's.

    The reference's bins are cut into ``groups`` runs of about equal counts; values outside
    its range join the nearest run, missing ones are a group of their own. ``psi`` is the
    population stability index of the groups' shares, each count raised by a half so that
    empty groups have one. ``max_gap`` is the largest difference of the cumulative shares of
    values that are there. Windows are per feature over bins, never over rows.
    """
    both = (
        reference.select("feature", "bin", F.col("n").alias("r"), F.lit(0).cast("long").alias("p"))
        .unionByName(payload.select("feature", "bin", F.lit(0).cast("long").alias("r"), F.col("n").alias("p")))
        .groupBy("feature", "bin")
        .agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    )
    there = Window.partitionBy("feature", F.col("bin").isNull())
    upto = there.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = both.withColumns(
        {
            "_r": F.sum("r").over(upto),
            "_p": F.sum("p").over(upto),
            "_rn": F.sum("r").over(there),
            "_pn": F.sum("p").over(there),
        }
    )
    run = F.floor(F.lit(groups) * F.try_divide(F.col("_r") - F.col("r"), F.col("_rn"))).cast("int")
    own = F.when(F.col("r") > 0, run)
    group = F.when(F.col("bin").isNull(), MISSING).otherwise(
        F.coalesce(F.last(own, ignorenulls=True).over(upto), F.lit(0))
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.try_divide("_r", "_rn") - F.try_divide("_p", "_pn")))
    shares = (
        cut.select("feature", group.alias("group"), "r", "p", gap.alias("gap"))
        .groupBy("feature", "group")
        .agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.max("gap").alias("gap"))
    )
    whole = Window.partitionBy("feature")
    half = F.lit(0.5)

    def share(c: str) -> Column:
        return (F.col(c) + half) / (F.sum(c).over(whole) + half * F.count(F.lit(1)).over(whole))

    parts = shares.withColumns({"_e": share("r"), "_a": share("p")})
    missing = F.col("group") == MISSING
    psi = F.sum((F.col("_a") - F.col("_e")) * F.ln(F.col("_a") / F.col("_e")))
    out = parts.groupBy("feature").agg(
        F.sum("r").alias("n_reference"),
        F.sum("p").alias("n_payload"),
        F.coalesce(F.sum(F.when(missing, F.col("r"))), F.lit(0)).alias("missing_reference"),
        F.coalesce(F.sum(F.when(missing, F.col("p"))), F.lit(0)).alias("missing_payload"),
        psi.alias("psi"),
        F.max("gap").alias("max_gap"),
    )
    level = F.when(F.col("psi") >= SHIFTED, "shifted").when(F.col("psi") >= MODERATE, "moderate")
    return out.withColumn("level", level.otherwise("stable"))
