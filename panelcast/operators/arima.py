"""Autoregressive moving-average forecasts of log steps, series by series, in the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import log_positive, next_month
from panelcast.operators.baselines import as_forecast
from panelcast.operators.features import as_of_month, reconstruct, series_window
from panelcast.operators.linear import moments, predicted, solution
from panelcast.spec import PanelSpec


# Rows that a regression needs for each of its coefficients.
ROWS_EACH = 3
# Largest reflection coefficient of the shock polynomial: beyond 1 shocks would grow with time.
INVERTIBLE = 0.98


@dataclass(frozen=True)
class Order:
    """p lags of the step, q lags of the shock, and the first ``seasonal`` multiples of the season.

    The target is the log step, so this is ARIMA(p, 1, q) of the log level; a seasonal lag
    is a regressor of its own, without products with the other lags.
    """

    p: int
    q: int = 0
    seasonal: int = 0
    season: int = 12

    @property
    def step_lags(self) -> list[int]:
        return [*range(1, self.p + 1), *(self.season * i for i in range(1, self.seasonal + 1))]

    @property
    def long(self) -> int:
        """Lags of the first regression, whose residuals stand for the shocks."""
        return self.p + self.q + 2


def log_steps(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """(key, y, ly_l1, step): each row's level, the log level before it and the log step."""
    w = series_window(spec)
    level = panel.select(*spec.key, F.col(spec.target).alias("y"), log_positive(spec.target).alias("_ly"))
    return level.withColumn("ly_l1", F.lag("_ly", 1).over(w)).select(
        *spec.key, "y", "ly_l1", (F.col("_ly") - F.col("ly_l1")).alias("step")
    )


def invertible(theta: list[Column], limit: float = INVERTIBLE) -> list[Column]:
    """The coefficients of 1 + theta_1 B + ..., with reflection coefficients up to ``limit``.

    Polynomials whose reflection coefficients are all smaller stay as they are. The others
    have roots on the wrong side or close to it; their shocks would not die out.
    """
    reflections, left = [], list(theta)
    while left:
        r = F.greatest(F.least(left[-1], F.lit(limit)), F.lit(-limit))
        r = F.when(left[-1].isNotNull(), r)
        reflections.insert(0, r)
        left = [(a - r * b) / (1.0 - r * r) for a, b in zip(left[:-1], left[-2::-1], strict=True)]
    out: list[Column] = []
    for r in reflections:
        out = [a + r * b for a, b in zip(out, out[::-1], strict=True)] + [r]
    return out


def arma(
    steps: DataFrame, by: list[str], date: str, order: Order, in_fit: Column, step: str = "step"
) -> DataFrame:
    """(by, date, n_fit, coefficients, delta): each row's predicted step from the rows before it.

    Two regressions fit the coefficients on the rows of ``in_fit``: a long autoregression
    gives residuals as estimates of the shocks, then the step is regressed on its own lags
    and the shocks' (Hannan and Rissanen). The model's own shocks are a recursion over the
    series: step minus prediction, 0 before the first prediction and where a step is
    missing. ``coefficients`` is the constant, then the step lags, then the shock lags, the
    latter moved to where old shocks die out (``invertible``).

    Coefficients and predictions are NULL where a series has fewer than ``ROWS_EACH`` rows for
    each coefficient of either regression: nothing falls back to a smaller model silently. A series is one row while it is fitted, with an array as
    long as its calendar; both regressions and the recursion share one shuffle by series.
    """
    w = Window.partitionBy(*by).orderBy(date)
    long = [F.lag(step, i).over(w).alias(f"_a{i}") for i in range(1, order.long + 1)]
    own = [F.lag(step, i).over(w).alias(f"_x{i}") for i in order.step_lags]
    lagged = steps.select(*by, date, F.col(step).alias("_step"), in_fit.alias("_in_fit"), *long, *own)
    xs = [F.col(f"_x{i}") for i in order.step_lags]
    if order.q:
        first = [F.col(f"_a{i}") for i in range(1, order.long + 1)]
        lagged = _fitted(lagged, by, date, first)
        lagged = lagged.withColumn("_shock", F.col("_step") - predicted(F.col("fit"), first)).drop("fit")
        shocks = {f"_e{i}": F.lag("_shock", i).over(w) for i in range(1, order.q + 1)}
        lagged = lagged.withColumns(shocks)
    shocks = [F.col(f"_e{i}") for i in range(1, order.q + 1)]
    k = len(xs)
    theta = [F.get("fit.slopes", F.lit(k + i)) for i in range(order.q)]
    rows = F.struct(date, "_step", *[f"_x{i}" for i in order.step_lags])
    fitted = _solved(lagged, by, [*xs, *shocks], rows)
    fitted = fitted.withColumn("theta", F.array(*invertible(theta)).cast("array<double>"))

    def walk(path: Column, row: Column) -> Column:
        """One more (shock, prediction), from the shocks before."""
        delta = predicted(F.col("fit"), [row.getField(f"_x{i}") for i in order.step_lags])
        for i in range(1, order.q + 1):
            before = F.get(path, F.size(path) - i).getField("shock")
            delta = delta + F.get("theta", F.lit(i - 1)) * F.coalesce(before, F.lit(0.0))
        shock = F.coalesce(row.getField("_step") - delta, F.lit(0.0))
        return F.concat(path, F.array(F.struct(shock.alias("shock"), delta.alias("delta"))))

    path = F.aggregate("rows", F.array().cast("array<struct<shock:double,delta:double>>"), walk)
    coefficients = F.concat(F.array("fit.intercept"), F.slice("fit.slopes", 1, k), "theta")
    joined = F.zip_with("rows", path, lambda row, at: F.struct(row.getField(date).alias(date), at.getField("delta").alias("delta")))
    return fitted.select(
        *by,
        F.col("fit.n").alias("n_fit"),
        F.when(F.col("fit.intercept").isNotNull(), coefficients).alias("coefficients"),
        F.inline(joined),
    ).select(*by, date, "n_fit", "coefficients", "delta")


def _solved(lagged: DataFrame, by: list[str], xs: list[Column], rows: Column) -> DataFrame:
    """(by, fit, rows): a row for each series, its rows in order of their date."""
    sums = lagged.groupBy(*by).agg(
        *moments(F.col("_step"), xs, F.col("_in_fit")), F.array_sort(F.collect_list(rows)).alias("rows")
    )
    k = len(xs)
    fit = solution(F.col("n"), F.col("means"), F.col("products"), k, ROWS_EACH * (k + 1))
    return sums.select(*by, fit.alias("fit"), "rows")


def _fitted(lagged: DataFrame, by: list[str], date: str, xs: list[Column]) -> DataFrame:
    """The rows of ``lagged`` with their series' fit."""
    carried = [c for c in lagged.columns if c not in by and c != date]
    return _solved(lagged, by, xs, F.struct(date, *carried)).select(*by, "fit", F.inline("rows"))


def arima_backtest(
    panel: DataFrame, train_end: str, orders: dict[str, Order], spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """(key, y, ly_l1, one column for each order): one-step predictions of every row.

    Coefficients are fitted on rows up to ``train_end``; shocks follow the actual steps.
    """
    steps = log_steps(panel, spec)
    in_fit = F.col(spec.date) <= F.to_date(F.lit(train_end))
    out = steps.drop("step")
    for name, order in orders.items():
        found = arma(steps, spec.series, spec.date, order, in_fit)
        level = found.select(*spec.key, F.col("delta").alias(name))
        out = out.join(level, spec.key).withColumn(name, reconstruct(F.col("ly_l1"), F.col(name)))
    return out


def arima_refitted(
    panel: DataFrame, origins: list[str], order: Order, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """(key, y, n_fit, prediction) of the months in ``origins``, each from a fit on all before it.

    The origins are walked one step at a time with a refit at each: every origin has a copy
    of the months up to it, and is a series of its own.
    """
    of = F.explode(F.array(*[F.to_date(F.lit(o)) for o in origins])).alias("_origin")
    steps = log_steps(panel, spec).select("*", of).where(F.col(spec.date) <= F.col("_origin"))
    found = arma(steps, [*spec.series, "_origin"], spec.date, order, F.col(spec.date) < F.col("_origin"))
    last = found.where(F.col(spec.date) == F.col("_origin")).drop("_origin", "coefficients")
    levels = log_steps(panel, spec).select(*spec.key, "y", "ly_l1")
    return last.join(levels, spec.key).select(
        *spec.key, "y", "n_fit", reconstruct(F.col("ly_l1"), F.col("delta")).alias("prediction")
    )


def forecast_arima(
    panel: DataFrame, train_end: str, order: Order, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Next month per series. A series whose train part is too short has a NULL prediction."""
    w = series_window(spec)
    month = next_month(as_of_month(panel, spec))
    steps = log_steps(panel, spec)
    # the row to predict has no step of its own; its level before is the last one
    last = panel.select(*spec.key, log_positive(spec.target).alias("ly_l1"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    ahead = last.where("_last").select(*spec.series, month.alias(spec.date), "ly_l1")
    both = steps.select(*spec.key, "ly_l1", "step").unionByName(ahead.withColumn("step", F.lit(None).cast("double")))
    in_fit = F.col(spec.date) <= F.to_date(F.lit(train_end))
    found = arma(both, spec.series, spec.date, order, in_fit).where(F.col(spec.date) == month)
    rows = ahead.withColumnRenamed(spec.date, "target_month").join(
        found.select(*spec.series, "delta"), spec.series
    )
    return as_forecast(rows, F.col("delta"), spec)
