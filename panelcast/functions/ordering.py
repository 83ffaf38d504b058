"""Exact global positions and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise


def running(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, str] | None = None,
    position: str = "position",
) -> DataFrame:
    """Add the 1-based ``position`` of each row and inclusive running sums.

    ``order`` must identify a row, otherwise equal keys would share a range. Rows
    are range-partitioned and written with their partition number, so a retry sees
    the same numbers; each partition then needs only the totals of those before it.
    Small inputs end up in few ranges, because adaptive execution merges neighbours. The one window without a partition key reads one row per range.

    ``sums`` maps an output name to the column it accumulates.
    """
    sums = sums or {}
    ranged = materialise(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )

    per_part = ranged.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{out}") for out, c in sums.items()],
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def offset(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    offsets = per_part.select(
        "_part",
        offset("_n").alias("_n0"),
        *[offset(f"_s_{out}").alias(f"_s0_{out}") for out in sums],
    )

    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.withColumns(
        {
            position: F.row_number().over(inside),
            **{out: F.sum(c).over(upto) for out, c in sums.items()},
        }
    )
    return (
        numbered.join(offsets, "_part")
        .withColumns(
            {
                position: F.col(position) + F.col("_n0"),
                **{out: F.col(out) + F.col(f"_s0_{out}") for out in sums},
            }
        )
        .select(*df.columns, position, *sums)
    )


def position_within(
    df: DataFrame, group: list[str], order: list[Column], position: str = "position"
) -> DataFrame:
    """1-based position of each row inside its group, however large the group is.

    Rows are numbered globally by (group, order), and the group's first number is an
    aggregate. It is written, so that its real size decides how it is joined: it is
    broadcast while groups are few, and the rows stay where they are. Beyond that, hot
    groups are split by a salt of the row's number.
    """
    numbered = running(df, [F.col(g) for g in group] + order, position="_global")
    starts = materialise(numbered.groupBy(*group).agg(F.min("_global").alias("_start")))
    return (
        salted_join(numbered, starts, group, F.col("_global"))
        .withColumn(position, F.col("_global") - F.col("_start") + 1)
        .select(*df.columns, position)
    )


JOIN_SALTS = 8
# A key with more rows than this is split in a join with a lookup of very many keys.
SPLIT_ROWS = 100_000


def keys_to_split(rows: DataFrame, key: str, least: int = SPLIT_ROWS) -> DataFrame:
    """(key): the values with more than ``least`` rows, written. They are few, however many keys there are."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return materialise(counts.where(F.col("_n") > least).select(key))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    salt: Column,
    how: str = "inner",
    split: DataFrame | None = None,
) -> DataFrame:
    """Join a written table of few rows a key; a key with very many rows is split.

    ``salt`` tells the rows of a key apart. Written first, the table is broadcast by its
    real size; where it is too large for that, no key's rows meet in one task.

    Each entry of the table is repeated once a salt. Where the keys grow with the rows, name
    those to ``split`` (see ``keys_to_split``; columns of ``keys``): only they are repeated,
    and their rows and those without a key are salted.
    """
    salts = F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))
    hashed = F.pmod(F.xxhash64(salt), F.lit(JOIN_SALTS)).cast("int")
    if split is None:
        spread = lookup.withColumn("_salt", F.explode(salts))
        salted = rows.withColumn("_salt", hashed)
    else:
        by, marks = split.columns, split.withColumn("_split", F.lit(True))
        nowhere = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        spread = lookup.join(marks, by, "left").withColumn(
            "_salt", F.explode(F.when(F.col("_split"), salts).otherwise(F.array(F.lit(0))))
        )
        salted = rows.join(marks, by, "left").withColumn(
            "_salt", F.when(F.coalesce("_split", nowhere), hashed).otherwise(F.lit(0))
        )
        spread, salted = spread.drop("_split"), salted.drop("_split")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
