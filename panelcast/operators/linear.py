"""Linear algebra of small matrices inside the plan: moments, sweeps, least squares.

A k x k matrix is an array of arrays in one row, of the whole input or of each group. The
moments are aggregates with map-side combining; what follows works on that one row. No job
runs while a plan is built, and nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pivot below this share of its variable's own sum of squares is rounding: the variable
# is a combination of those before it.
TOLERANCE = 1e-9


def cell(matrix: Column, i: Column | int, j: Column | int) -> Column:
    i, j = (F.lit(x) if isinstance(x, int) else x for x in (i, j))
    return F.get(F.get(matrix, i), j)


def sweep(matrix: Column, pivots: int, tolerance: float = TOLERANCE) -> Column:
    """struct(m, rank): the symmetric matrix swept on its first ``pivots`` variables.

    After the sweep the block of these variables is its inverse, the columns beyond hold the
    coefficients of their regressions on them, and the block beyond the residual products.
    Variables that depend on those before them are not swept and not counted in ``rank``.
    """

    def step(state: Column, p: Column) -> Column:
        m = state.getField("m")
        pivot = cell(m, p, p)
        clear = F.coalesce(pivot > cell(matrix, p, p) * tolerance, F.lit(False))

        def entry(row: Column, i: Column) -> Callable[[Column, Column], Column]:
            def swept(v: Column, j: Column) -> Column:
                return (
                    F.when((i == p) & (j == p), 1.0 / pivot)
                    .when(i == p, v / pivot)
                    .when(j == p, -v / pivot)
                    .otherwise(v - F.get(row, p) * cell(m, p, j) / pivot)
                )

            return swept

        rows = F.transform(m, lambda row, i: F.transform(row, entry(row, i)))
        return F.struct(
            F.when(clear, rows).otherwise(m).alias("m"),
            (state.getField("rank") + clear.cast("int")).alias("rank"),
        )

    start = F.struct(matrix.alias("m"), F.lit(0).alias("rank"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), start, step)


def diagonal(matrix: Column) -> Column:
    return F.transform(matrix, lambda row, i: F.get(row, i))


def moments(y: Column, xs: list[Column], use: Column) -> list[Column]:
    """Aggregates ``n``, ``means`` and ``products`` of the complete rows that ``use`` admits.

    ``products`` are sums of products of deviations from the means, of (*xs, y).
    """
    columns = [*xs, y]
    complete = F.coalesce(use, F.lit(False))
    for c in columns:
        complete = complete & c.isNotNull()
    used = [F.when(complete, c.cast("double")) for c in columns]
    n = F.count(F.when(complete, 1))
    pairs = {}
    for i, a in enumerate(used):
        for j, b in enumerate(used[: i + 1]):
            pairs[i, j] = pairs[j, i] = F.covar_pop(a, b) * n
    size = range(len(used))
    products = F.array(*[F.array(*[pairs[i, j] for j in size]) for i in size])
    means = F.array(*[F.avg(c) for c in used])
    return [n.alias("n"), means.alias("means"), products.alias("products")]


def solution(n: Column, means: Column, products: Column, k: int, least: int = 0) -> Column:
    """struct(n, intercept, slopes, sse, spread) of least squares on k regressors.

    ``spread`` times the residual variance are the slopes' variances. All but ``n`` are NULL
    where rows are too few for the coefficients, or fewer than ``least``, or a regressor
    depends on the others.
    """
    swept = F.transform(F.array(sweep(products, k)), _solved(n, means, k, least))
    return F.get(swept, F.lit(0))


def _solved(n: Column, means: Column, k: int, least: int) -> Callable[[Column], Column]:
    def of(swept: Column) -> Column:
        m = swept.getField("m")
        fits = (swept.getField("rank") == k) & (n >= max(k + 2, least))
        slopes = F.transform(F.slice(m, 1, k), lambda row: F.get(row, F.lit(k)))
        fitted = F.aggregate(
            F.zip_with(slopes, F.slice(means, 1, k), lambda b, x: b * x),
            F.lit(0.0),
            lambda total, part: total + part,
        )
        return F.struct(
            n.alias("n"),
            F.when(fits, F.get(means, F.lit(k)) - fitted).alias("intercept"),
            F.when(fits, slopes).alias("slopes"),
            F.when(fits, cell(m, k, k)).alias("sse"),
            F.when(fits, F.slice(diagonal(m), 1, k)).alias("spread"),
        )

    return of


def least_squares(
    df: DataFrame, by: list[str], y: Column, xs: list[Column], use: Column | None = None
) -> DataFrame:
    """(by, fit): one least squares fit with a constant for each group; see ``solution``."""
    use = F.lit(True) if use is None else use
    sums = df.groupBy(*by).agg(*moments(y, xs, use))
    fit = solution(F.col("n"), F.col("means"), F.col("products"), len(xs))
    return sums.select(*by, fit.alias("fit"))


def predicted(fit: Column, xs: list[Column]) -> Column:
    """The fitted value at ``xs``; NULL where the fit or a regressor is missing."""
    out = fit.getField("intercept")
    for i, x in enumerate(xs):
        out = out + F.get(fit.getField("slopes"), F.lit(i)) * x
    return out


def t_value(fit: Column, i: int, k: int) -> Column:
    """Slope i of a fit on k regressors over its standard error; NULL without residuals."""
    variance = F.when(fit.getField("sse") > 0, fit.getField("sse")) / (fit.getField("n") - k - 1)
    error = F.sqrt(variance * F.get(fit.getField("spread"), F.lit(i)))
    return F.try_divide(F.get(fit.getField("slopes"), F.lit(i)), error)


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, means, products) of the complete rows of ``df``; see ``moments``.

    The means are a scalar subquery and the products plain sums of deviations from them, so
    ``df`` is read twice and should be written.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    means = rows.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    off = rows.select(means.alias("_means"), *columns)
    off = off.select(*[(F.col(c) - F.col("_means").getField(c)).alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs]
    one = off.agg(F.count(F.lit(1)).alias("n"), *sums)
    size = range(len(columns))
    products = F.array(*[F.array(*[F.col(f"s{max(i, j)}_{min(i, j)}") for j in size]) for i in size])
    of_means = F.array(*[means.getField(c) for c in columns])
    return one.select("n", of_means.alias("means"), products.alias("products"))


def correlation(products: Column) -> Column:
    """The correlation matrix; NULL entries for a constant column, also on its diagonal."""
    scale = F.transform(diagonal(products), lambda v: F.when(v > 0, F.sqrt(v)))
    return F.transform(
        products,
        lambda row, i: F.transform(row, lambda v, j: v / F.get(scale, i) / F.get(scale, j)),
    )


def rank(df: DataFrame, columns: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(n_rows, n_columns, rank): how many of the columns are linearly independent.

    A constant column counts as dependent, since a model has a constant of its own.
    """
    swept = sweep(F.col("products"), len(columns), tolerance).getField("rank")
    return gram(df, columns).select(
        F.col("n").alias("n_rows"),
        F.lit(len(columns)).alias("n_columns"),
        F.when(F.col("n") > 0, swept).otherwise(0).alias("rank"),
    )


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, vif): variance inflation, the diagonal of the inverse correlation matrix.

    A singular design has no finite value (NULL). Diagnostic only: it never decides
    which features a model gets.
    """
    k = len(columns)
    swept = gram(df, columns).select(sweep(correlation(F.col("products")), k).alias("s"))
    values = F.when(F.col("s.rank") == k, diagonal(F.col("s.m")))
    entries = [
        F.struct(F.lit(c).alias("feature"), F.get(F.col("v"), F.lit(i)).alias("vif"))
        for i, c in enumerate(columns)
    ]
    return swept.select(values.alias("v")).select(F.inline(F.array(*entries)))


def ridge(df: DataFrame, y: str, columns: list[str], penalty: float) -> DataFrame:
    """One row (n, intercept, slopes) of ridge regression on standardised columns.

    Minimises the mean squared error plus ``penalty`` times the squared slopes of the
    columns in units of their standard deviations; slopes are returned in the columns' own
    units. Constant columns have slope 0; the penalty makes any other design solvable.
    """
    k = len(columns)
    sums = gram(df, [*columns, y])
    scale = F.transform(diagonal(F.col("products")), lambda v: F.when(v > 0, F.sqrt(v / F.col("n"))))
    spread = sums.withColumn("scale", scale)

    def standard(row: Column, i: Column) -> Column:
        def entry(v: Column, j: Column) -> Column:
            own = F.when((i < k) & (i == j), F.lit(1.0 + penalty))
            si, sj = (F.when(x < k, F.get(F.col("scale"), x)).otherwise(1.0) for x in (i, j))
            return F.coalesce(own, v / F.col("n") / si / sj, F.lit(0.0))

        return F.transform(row, entry)

    swept = spread.withColumn("s", sweep(F.transform("products", standard), k))
    slope = F.zip_with(
        F.slice("s.m", 1, k),
        F.slice("scale", 1, k),
        lambda row, s: F.coalesce(F.get(row, F.lit(k)) / s, F.lit(0.0)),
    )
    solved = swept.withColumn("slopes", slope)
    fitted = F.aggregate(
        F.zip_with("slopes", F.slice("means", 1, k), lambda b, m: b * m),
        F.lit(0.0),
        lambda total, part: total + part,
    )
    return solved.select("n", (F.get("means", F.lit(k)) - fitted).alias("intercept"), "slopes")
