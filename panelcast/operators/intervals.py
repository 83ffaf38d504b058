"""Prediction intervals from errors on rows a model was not fitted on, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import longer
from panelcast.functions.lineage import materialise
from panelcast.operators.arima import Order, arma, log_steps
from panelcast.operators.evaluate import expanding_folds
from panelcast.spec import PanelSpec

STEP = 1e-4  # errors are counted on a grid of this many nats
# So many errors of a group weigh as much as the errors of all groups together.
PRIOR_ERRORS = 30


def fold_errors(
    panel: DataFrame,
    train_end: str,
    order: Order,
    spec: PanelSpec = PanelSpec(),
    n_folds: int = 5,
    months: int = 6,
) -> DataFrame:
    """(key, fold, error): log errors of the folds' validation months.

    Each fold's coefficients come from the months before it, so no error is of a row that
    was fitted; the holdout is never read. Rows without a prediction are left out.
    """
    steps = expanding_folds(log_steps(panel, spec), train_end, n_folds, months, spec)
    by = [*spec.series, "fold"]
    found = arma(steps.select(*spec.key, "fold", "role", "step"), by, spec.date, order, F.col("role") == "train")
    valid = steps.where("role = 'valid'").select(*spec.key, "fold", "step")
    error = (F.col("step") - F.col("delta")).alias("error")
    return valid.join(found, [*by, spec.date]).select(*spec.key, "fold", error).na.drop(subset=["error"])


def _quantiles(counts: DataFrame, by: list[str], levels: list[float], name: str) -> DataFrame:
    """(by, n, names): the smallest grid value up to which a level's share of errors lies."""
    upto = Window.partitionBy(*by).orderBy("bin") if by else Window.orderBy("bin")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    ranked = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})

    def at(level: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.col("_all") * F.lit(level), F.col("bin"))) * F.lit(STEP)

    values = [at(level).alias(f"{name}{i}") for i, level in enumerate(levels)]
    return ranked.groupBy(*by).agg(F.sum("n").alias(f"{name}n"), *values)


def error_quantiles(
    errors: DataFrame, by: list[str], levels: list[float], prior: int = PRIOR_ERRORS
) -> DataFrame:
    """(by, n_errors, quantiles): one value for each level and group, written.

    n errors of a group count n / (n + ``prior``) against the quantile of all errors, so
    small groups lean on the others and none switches its rule at some size. Errors are
    counted on a grid first: windows hold grid values, whatever the number of errors.
    """
    grid = errors.select(*by, F.rint(F.col("error") / F.lit(STEP)).cast("long").alias("bin"))
    counts = materialise(grid.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")))
    pooled = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    of_all = _quantiles(pooled, [], levels, "_a")
    row = of_all.agg(F.max(F.array(*[f"_a{i}" for i in range(len(levels))]))).scalar()
    weight = F.col("_gn") / (F.col("_gn") + F.lit(float(prior)))
    mixed = [
        weight * F.col(f"_g{i}") + (1.0 - weight) * F.get("_all", F.lit(i)) for i in range(len(levels))
    ]
    groups = _quantiles(counts, by, levels, "_g").withColumn("_all", row)
    return materialise(groups.select(*by, F.col("_gn").alias("n_errors"), F.array(*mixed).alias("quantiles")))


def with_intervals(
    predictions: DataFrame, quantiles: DataFrame, by: list[str], names: list[str], prediction: str = "prediction"
) -> DataFrame:
    """Add a column for each quantile: the prediction times the exponential of the error.

    A group without errors of its own has no interval (NULL).
    """
    joined = predictions.join(quantiles.select(*by, "quantiles"), by, "left")
    levels = {
        name: F.col(prediction) * F.exp(F.get("quantiles", F.lit(i))) for i, name in enumerate(names)
    }
    return joined.withColumns(levels).drop("quantiles")


def interval_scores(
    rows: DataFrame, levels: dict[str, float], by: list[str], y: str = "y"
) -> DataFrame:
    """(by, metric, value): pinball loss of each level, coverage and width of the outer two.

    ``levels`` maps quantile columns to levels, in ascending order. ``width`` is relative to
    the sum of the actuals, the loss is the mean over rows that have all quantiles, and
    ``scored`` is the share of such rows.
    """
    names = list(levels)
    there = F.col(y).isNotNull()
    for name in names:
        there = there & F.col(name).isNotNull()

    def pinball(name: str, level: float) -> Column:
        over = F.col(y) - F.col(name)
        return F.avg(F.when(there, F.greatest(over * F.lit(level), over * F.lit(level - 1.0))))

    low, high = F.col(names[0]), F.col(names[-1])
    inside = (F.col(y) >= low) & (F.col(y) <= high)
    metrics = {f"pinball_{name}": pinball(name, level) for name, level in levels.items()}
    metrics["coverage"] = F.avg(F.when(there, inside.cast("double")))
    metrics["width"] = F.try_divide(F.sum(F.when(there, high - low)), F.sum(F.when(there, F.col(y))))
    metrics["scored"] = F.avg(there.cast("double"))
    wide = rows.groupBy(*by).agg(*[c.alias(name) for name, c in metrics.items()])
    return longer(wide, by, list(metrics), "metric", "value")
