"""Descriptive and hypothesis statistics from distributed sums."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import log_positive, ratio
from panelcast.functions.ordering import running
from panelcast.operators.features import series_window
from panelcast.operators.linear import cell, correlation, gram, moments, solution, t_value
from panelcast.spec import PanelSpec

# Published asymptotic 5 % value of the Dickey-Fuller t with a constant.
DICKEY_FULLER_5PCT = -2.86


def concentration(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Entities by value: rank, share, cumulative share, and the concentration index."""
    per_entity = panel.groupBy(spec.entity).agg(F.sum(spec.target).alias("value"))
    ranked = running(
        per_entity,
        [F.desc("value"), F.col(spec.entity)],
        sums={"cum_value": "value"},
        position="rank",
    )
    totals = ranked.agg(
        F.struct(F.sum("value").alias("v"), F.sum(F.col("value") * F.col("value")).alias("vv"))
    )
    return (
        ranked.withColumn("_t", totals.scalar())
        .withColumns(
            {
                "share": ratio(F.col("value"), F.col("_t.v")),
                "cum_share": ratio(F.col("cum_value"), F.col("_t.v")),
                "hhi": ratio(F.col("_t.vv"), F.col("_t.v") * F.col("_t.v")),
            }
        )
        .select(spec.entity, "rank", "value", "share", "cum_share", "hhi")
    )


def seasonality_index(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Mean target by month of year over the overall mean."""
    by_month = panel.groupBy(F.month(spec.date).alias("month")).agg(
        F.count(spec.target).alias("n_rows"), F.sum(spec.target).alias("s")
    )
    overall = by_month.agg(F.sum("s") / F.sum("n_rows")).scalar()
    mean = F.col("s") / F.col("n_rows")
    return by_month.select("month", "n_rows", mean.alias("mean"), ratio(mean, overall).alias("idx"))


def series_volatility(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Deviation of log steps and coefficient of variation of the level, per series."""
    step = F.ln(spec.target) - F.lag(F.ln(spec.target), 1).over(series_window(spec))
    steps = panel.select(*spec.key, spec.target, step.alias("step"))
    return steps.groupBy(*spec.series).agg(
        F.stddev_samp("step").alias("sd_step"),
        ratio(F.stddev_samp(spec.target), F.avg(spec.target)).alias("cv"),
    )


def series_swing(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Largest absolute month-on-month change in percent, per series."""
    before = F.lag(spec.target, 1).over(series_window(spec))
    change = F.abs((F.try_divide(F.col(spec.target), before) - 1.0) * 100.0)
    return (
        panel.select(*spec.key, change.alias("change"))
        .groupBy(*spec.series)
        .agg(F.max("change").alias("max_swing_pct"))
    )


def _moments(df: DataFrame, group: Column, value: str) -> DataFrame:
    return df.groupBy(group.alias("g")).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic from per-group count, mean and variance."""
    g = _moments(df, F.col(group), value).where("n > 0")
    # deviations of the group means from the mean of all, so that no large sums cancel
    gap = F.col("m") - df.agg(F.avg(value)).scalar()
    within = F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * (F.col("n") - 1))
    one = g.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * gap * gap).alias("ssb"),
        within.alias("ssw"),
    )
    ssb = F.col("ssb")
    return one.select(
        (F.col("k") - 1).alias("df_between"),
        (F.col("n") - F.col("k")).alias("df_within"),
        ratio(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("f_stat"),
    )


def welch(df: DataFrame, is_first: Column, value: str) -> DataFrame:
    """Welch's t of two groups with Satterthwaite degrees of freedom."""
    g = _moments(df, is_first.cast("int"), value)

    def of(flag: int, c: str) -> Column:
        return F.max(F.when(F.col("g") == flag, F.col(c)))

    one = g.agg(
        *[of(flag, c).alias(f"{c}{flag}") for flag in (1, 0) for c in ("n", "m", "v")]
    ).withColumns({"e1": F.col("v1") / F.col("n1"), "e0": F.col("v0") / F.col("n0")})
    se2 = F.col("e1") + F.col("e0")
    denominator = F.col("e1") * F.col("e1") / (F.col("n1") - 1) + F.col("e0") * F.col("e0") / (
        F.col("n0") - 1
    )
    return one.select(
        F.col("n1").alias("n_first"),
        F.col("n0").alias("n_second"),
        F.col("m1").alias("mean_first"),
        F.col("m0").alias("mean_second"),
        ratio(F.col("m1") - F.col("m0"), F.sqrt(se2)).alias("t_stat"),
        ratio(se2 * se2, denominator).alias("df"),
    )


def kruskal(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie-averaged ranks and tie correction.

    Equal values of a group are counted first, so a value shared by very many rows is
    a few rows when ranks are computed; ranks are running counts over range partitions.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"), group.alias("g"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    ranked = running(counts, [F.col("value"), F.col("g")], sums={"upto": "c"})
    ties = ranked.groupBy("value").agg(
        F.min(F.col("upto") - F.col("c")).alias("below"), F.sum("c").cast("double").alias("t")
    )
    per_group = (
        ranked.join(ties, "value")
        .groupBy("g")
        .agg(
            F.sum("c").alias("n"),
            F.sum((F.col("below") + (F.col("t") + 1) / 2.0) * F.col("c")).alias("r"),
            # summed over the rows of a value this is t^3 - t
            F.sum(F.col("c") * (F.col("t") * F.col("t") - 1)).alias("tie"),
        )
    )
    one = per_group.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"),
        F.sum("tie").alias("tie"),
    )
    n = F.col("n")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("rr") - (n + 1) * 3.0
    correction = F.lit(1.0) - F.col("tie") / (n * n * n - n)
    return one.select(
        (F.col("k") - 1).alias("df"),
        n.cast("bigint").alias("n_rows"),
        ratio(h, correction).alias("h_stat"),
    )


def dickey_fuller(
    panel: DataFrame, spec: PanelSpec = PanelSpec(), critical: float = DICKEY_FULLER_5PCT
) -> DataFrame:
    """Per series, Dickey-Fuller t (constant, no lags) of log levels and of log steps.

    ``d`` is the order of differencing suggested: 0 when the levels are already
    stationary, 1 when their steps are, NULL when neither is.
    """
    w = series_window(spec)
    ly = F.ln(spec.target)
    lagged = panel.select(*spec.key, ly.alias("x0")).withColumns(
        {"x1": F.lag("x0", 1).over(w), "x2": F.lag("x0", 2).over(w)}
    )
    steps = lagged.select(
        *spec.series,
        "x1",
        (F.col("x0") - F.col("x1")).alias("dx"),
        (F.col("x1") - F.col("x2")).alias("s1"),
        (F.col("x0") - 2.0 * F.col("x1") + F.col("x2")).alias("ds"),
    )

    def sums(y: str, x: str, name: str) -> list[Column]:
        return [
            f(y, x).alias(f"{name}_{tag}")
            for tag, f in (
                ("n", F.regr_count),
                ("xx", F.regr_sxx),
                ("xy", F.regr_sxy),
                ("yy", F.regr_syy),
            )
        ]

    def t_stat(name: str) -> Column:
        n, xx, xy, yy = (F.col(f"{name}_{tag}") for tag in ("n", "xx", "xy", "yy"))
        slope = F.try_divide(xy, xx)
        sse = yy - slope * xy
        se = F.when((n > 2) & (sse > 0), F.sqrt(F.try_divide(F.try_divide(sse, n - 2), xx)))
        return F.try_divide(slope, se)

    fitted = steps.groupBy(*spec.series).agg(*sums("dx", "x1", "level"), *sums("ds", "s1", "diff"))
    d = F.when(F.col("t_level") < critical, 0).when(F.col("t_diff") < critical, 1)
    return fitted.select(
        *spec.series, t_stat("level").alias("t_level"), t_stat("diff").alias("t_diff")
    ).withColumn("d", d)


def augmented_dickey_fuller(
    panel: DataFrame,
    lags: tuple[int, ...] = (1, 2, 3),
    spec: PanelSpec = PanelSpec(),
    critical: float = DICKEY_FULLER_5PCT,
) -> DataFrame:
    """Per series and p in ``lags``, the augmented Dickey-Fuller t of log levels and of log steps.

    The step of the series is regressed on a constant, its level before, and its own p last
    steps, on all rows that have them; t is that of the level. ``d`` is the order of
    differencing suggested, as in ``dickey_fuller``; t is NULL where rows are too few.
    """
    w = series_window(spec)
    ly = log_positive(spec.target)
    lagged = panel.select(*spec.key, ly.alias("_v0")).withColumns(
        {f"_v{i}": F.lag("_v0", i).over(w) for i in range(1, max(lags) + 3)}
    )

    def difference(times: int, i: int) -> Column:
        """The level or its first or second difference, i rows before."""
        if not times:
            return F.col(f"_v{i}")
        return difference(times - 1, i) - difference(times - 1, i + 1)

    sums, fits = [], {}
    for p in lags:
        for name, d in (("level", 0), ("diff", 1)):
            xs = [difference(d, 1), *(difference(d + 1, i) for i in range(1, p + 1))]
            of = [f"_{name}{p}_{part}" for part in ("n", "means", "products")]
            parts = moments(difference(d + 1, 0), xs, F.lit(True))
            sums += [c.alias(alias) for c, alias in zip(parts, of, strict=True)]
            fits[name, p] = solution(*map(F.col, of), p + 1)
    one = lagged.groupBy(*spec.series).agg(*sums)
    solved = one.select(*spec.series, *[fit.alias(f"_{name}{p}") for (name, p), fit in fits.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("lags"),
                F.col(f"_level{p}.n").alias("n_rows"),
                t_value(F.col(f"_level{p}"), 0, p + 1).alias("t_level"),
                t_value(F.col(f"_diff{p}"), 0, p + 1).alias("t_diff"),
            )
            for p in lags
        ]
    )
    d = F.when(F.col("t_level") < critical, 0).when(F.col("t_diff") < critical, 1)
    return solved.select(*spec.series, F.inline(rows)).withColumn("d", d)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, corr) for each pair; NULL where a column is constant.

    All pairs come from one matrix of sums over the complete rows; no job runs before it
    is asked. ``df`` is read twice and should be written.
    """
    matrix = gram(df, columns).select(correlation(F.col("products")).alias("m"))
    entries = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), cell(F.col("m"), i, j).alias("corr")
        )
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
    ]
    return matrix.select(F.inline(F.array(*entries)))
