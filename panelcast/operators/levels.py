"""Sums at every level of a hierarchy in one pass, and whether the levels agree."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lattice(
    df: DataFrame, levels: dict[str, list[str]], measures: list[str], keep: list[str]
) -> DataFrame:
    """(level, dimensions, keep, n_cells, measures, n_missing_*): sums of ``df`` at each level.

    ``levels`` names subsets of the dimensions; ``keep`` (months, say) belongs to all. A
    dimension that a level leaves out is NULL there. A sum with a missing part is NULL and
    ``n_missing_<measure>`` says how many are missing: half a total never looks whole.
    Grouping sets expand each row once a level, before map-side combining.
    """
    dimensions = list(dict.fromkeys(c for names in levels.values() for c in names))
    own = {c: f"_d{i}" for i, c in enumerate(dimensions)}
    # renamed, so that a NULL member of the data is not taken for a level's total
    rows = df.select(*[F.col(c).alias(own[c]) for c in dimensions], *keep, *measures)
    sets = [[F.col(c) for c in [*(own[d] for d in names), *keep]] for names in levels.values()]
    columns = [F.col(c) for c in [*own.values(), *keep]]
    sums: list[Column] = [F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n_cells")]
    for m in measures:
        missing = F.count_if(F.col(m).isNull())
        sums += [F.when(missing == 0, F.sum(m)).alias(m), missing.alias(f"n_missing_{m}")]
    out = rows.groupingSets(sets, *columns).agg(*sums)
    level = F.lit(None).cast("string")
    for name, names in levels.items():
        # the grouping id has a bit for each column, the first one highest, set where it is left out
        bits = "".join("0" if c in names else "1" for c in dimensions) + "0" * len(keep)
        level = F.when(F.col("_id") == int(bits, 2), name).otherwise(level)
    picked = [F.col(own[c]).alias(c) for c in dimensions]
    counts = [c for m in measures for c in (m, f"n_missing_{m}")]
    return out.select(level.alias("level"), *picked, *keep, "n_cells", *counts)


def coherence(
    table: DataFrame, levels: dict[str, list[str]], measure: str, keep: list[str]
) -> DataFrame:
    """(level, child, n_cells, n_missing, n_incomplete, max_relative_gap): each level against the next finer.

    ``levels`` runs from the finest to the coarsest, each a subset of the one before. The
    finer level's cells are summed again and joined with the coarser's: ``max_relative_gap``
    is the largest difference, relative to the coarser sum. ``n_missing`` cells are on one
    side only; ``n_incomplete`` have a NULL on either side and are not compared.
    """
    names = list(levels)
    out = None
    for child, parent in zip(names, names[1:], strict=False):
        on = [*levels[parent], *keep]
        missing = F.count_if(F.col(measure).isNull())
        parts = (
            table.where(F.col("level") == child)
            .groupBy(*on)
            .agg(F.when(missing == 0, F.sum(measure)).alias("_parts"), F.lit(1).alias("_c"))
        )
        whole = table.where(F.col("level") == parent).select(
            *on, F.col(measure).alias("_whole"), F.lit(1).alias("_p")
        )
        same = reduce(and_, [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in on])
        joined = whole.alias("w").join(parts.alias("p"), same, "full")
        one_side = F.col("_c").isNull() | F.col("_p").isNull()
        incomplete = ~one_side & (F.col("_parts").isNull() | F.col("_whole").isNull())
        gap = F.abs(F.try_divide(F.col("_whole") - F.col("_parts"), F.col("_whole")))
        row = joined.agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.count_if(one_side).alias("n_missing"),
            F.count_if(incomplete).alias("n_incomplete"),
            F.max(gap).alias("max_relative_gap"),
        ).select(F.lit(parent).alias("level"), F.lit(child).alias("child"), "*")
        out = row if out is None else out.unionByName(row)
    return out
