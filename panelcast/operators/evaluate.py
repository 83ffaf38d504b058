"""Backtest accuracy, quality gate, expanding folds and selection.

Predictions of several candidates are scored together, on the rows that all of them
predict; every metric is an aggregate with map-side combining, at the grain of rows, of
entity totals or of segment totals.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import longer, ratio
from panelcast.functions.lineage import materialise
from panelcast.operators.features import series_window
from panelcast.spec import (
    GATE_MASE,
    GATE_TOTAL_WMAPE,
    GATE_VS_NAIVE,
    SPLIT,
    TEST,
    TRAIN,
    PanelSpec,
)

METRICS = ["zone_wmape", "ai_brand_wmape", "mase"]
COVERAGE = "coverage"
EXTENDED = [*METRICS, "mape", "r2", "total_mape", "total_r2", "segment_wmape", COVERAGE]


def mase_scale(cleaned: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per series, mean absolute step of the target over its cleaned train rows."""
    w = series_window(spec)
    train = cleaned.where(F.col(SPLIT) == TRAIN)
    steps = train.withColumn("step", F.abs(F.col("y") - F.lag("y", 1).over(w)))
    return steps.groupBy(*spec.series).agg(F.avg("step").alias("scale"))


def with_scale(cleaned: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The same scale on every row of the series.

    Train rows precede test rows, so the step from the previous cleaned row is the
    step inside train; the partitioning by series is the one the features left.
    """
    w = series_window(spec)
    step = F.abs(F.col("y") - F.lag("y", 1).over(w))
    stepped = cleaned.withColumn("_step", F.when(F.col(SPLIT) == TRAIN, step))
    whole = Window.partitionBy(*spec.series)
    return stepped.withColumn("scale", F.avg("_step").over(whole)).drop("_step")


def candidate_rows(
    frame: DataFrame, candidates: list[str], spec: PanelSpec, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Long rows (candidate, key, y, pred, scale, covered) from one prediction column each.

    Candidates are compared on the same rows: where one of them has no prediction, ``pred``
    is NULL for all. ``covered`` says whether the candidate itself had one.
    """
    all_there = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in candidates))
    ids = [*keep, *spec.key, "y", "scale", "_all"]
    long = longer(frame.withColumn("_all", all_there), ids, candidates, "candidate", "pred")
    own = F.col("pred")
    return long.withColumns(
        {"covered": own.isNotNull(), "pred": F.when(F.col("_all"), own)}
    ).drop("_all")


def score(
    rows: DataFrame,
    spec: PanelSpec = PanelSpec(),
    by: tuple[str, ...] = ("candidate",),
) -> DataFrame:
    """All metrics per ``by`` group as columns, on the rows all candidates predict.

    ``zone_wmape`` weighs every row; ``ai_brand_wmape`` and the ``total_`` metrics first
    sum segments by entity and month, ``segment_wmape`` sums entities by segment and month;
    ``mase`` averages scaled errors and skips series without a scale. ``coverage`` is the
    share of rows with a prediction of the candidate's own, ``n_rows`` the rows compared.
    Squared deviations are taken from variances, not from differences of large sums. The
    rows are written first, because several aggregates read them.
    """
    used = [*by, *spec.key, "y", "pred", "scale", "covered"]
    rows = materialise(rows.select(*dict.fromkeys(used)))
    shared = rows.where("pred IS NOT NULL")
    err = "abs(y - pred)"

    def grain(*keys: str) -> DataFrame:
        return shared.groupBy(*by, *keys).agg(F.sum("y").alias("sy"), F.sum("pred").alias("sp"))

    plain = shared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(f"try_divide(sum({err}), sum(y)) * 100D AS zone_wmape"),
        F.expr(f"avg(try_divide({err}, scale)) AS mase"),
        F.expr(f"avg(try_divide({err}, abs(y))) * 100D AS mape"),
        F.expr(f"1D - try_divide(sum({err} * {err}), count(1) * var_pop(y)) AS r2"),
    )
    gap = "abs(sy - sp)"
    totals = grain(spec.entity, spec.date).groupBy(*by).agg(
        F.expr(f"try_divide(sum({gap}), sum(sy)) * 100D AS ai_brand_wmape"),
        F.expr(f"avg(try_divide({gap}, abs(sy))) * 100D AS total_mape"),
        F.expr(f"1D - try_divide(sum({gap} * {gap}), count(1) * var_pop(sy)) AS total_r2"),
    )
    segments = grain(spec.segment, spec.date).groupBy(*by).agg(
        F.expr(f"try_divide(sum({gap}), sum(sy)) * 100D AS segment_wmape")
    )
    covered = rows.groupBy(*by).agg(F.avg(F.col("covered").cast("double")).alias(COVERAGE))
    out = covered
    for part in (plain, totals, segments):
        out = out.join(part, list(by), "left")
    return out


def evaluate(
    scaled: DataFrame,
    candidates: list[str],
    spec: PanelSpec = PanelSpec(),
    metrics: list[str] = METRICS,
) -> DataFrame:
    """(candidate, metric, value) on the test rows of a frame that carries ``scale``."""
    test = scaled.where(F.col(SPLIT) == TEST)
    wide = score(candidate_rows(test, candidates, spec), spec)
    return longer(wide, ["candidate"], metrics, "metric", "value")


def quality_gate(
    metrics: DataFrame,
    model: str,
    naive: str = "naive",
    ceiling: float = GATE_TOTAL_WMAPE,
    vs_naive: float = GATE_VS_NAIVE,
    mase: float = GATE_MASE,
) -> DataFrame:
    """(gate, value, threshold, passed) from the long metrics of model and naive.

    The last gate needs the ``coverage`` metric: a model that predicts fewer rows than
    naive fails whatever its errors are.
    """

    def value(candidate: str, metric: str) -> Column:
        hit = (F.col("candidate") == candidate) & (F.col("metric") == metric)
        return F.max(F.when(hit, F.col("value")))

    one = metrics.agg(
        value(model, "ai_brand_wmape").alias("model_wmape"),
        value(naive, "ai_brand_wmape").alias("naive_wmape"),
        value(model, "mase").alias("model_mase"),
        value(naive, "mase").alias("naive_mase"),
        value(model, COVERAGE).alias("model_coverage"),
        value(naive, COVERAGE).alias("naive_coverage"),
    ).select(
        "model_coverage",
        "naive_coverage",
        "model_wmape",
        ratio(F.col("model_wmape"), F.col("naive_wmape")).alias("vs_naive"),
        ratio(F.col("model_mase"), F.col("naive_mase")).alias("rel_mase"),
    )

    def gate(name: str, c: str, threshold: float | Column, passed: Column) -> Column:
        limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
        return F.struct(
            F.lit(name).alias("gate"),
            F.col(c).alias("value"),
            limit.cast("double").alias("threshold"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    gates = F.array(
        gate("ai_brand_wmape", "model_wmape", ceiling, F.col("model_wmape") <= ceiling),
        gate("vs_naive", "vs_naive", vs_naive, F.col("vs_naive") <= vs_naive),
        # strictly better, unlike the two ceilings
        gate("naive_rel_mase", "rel_mase", mase, F.col("rel_mase") < mase),
        gate(
            COVERAGE,
            "model_coverage",
            F.col("naive_coverage"),
            F.col("model_coverage") >= F.col("naive_coverage"),
        ),
    )
    return one.select(F.inline(gates))


def entity_wmape(rows: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Accuracy per candidate and entity."""
    scored = score(rows, spec, by=("candidate", spec.entity))
    return scored.select("candidate", spec.entity, "n_rows", "zone_wmape")


def beats_naive(rows: DataFrame, model: str, naive: str = "naive", spec=PanelSpec()) -> DataFrame:
    """How many entities the model predicts better than naive, and their value share."""
    err = F.abs(F.col("y") - F.col("pred"))

    def of(name: str, c: Column) -> Column:
        return F.sum(F.when(F.col("candidate") == name, c))

    per_entity = rows.where("pred IS NOT NULL").groupBy(spec.entity).agg(
        of(naive, F.col("y")).alias("y"),
        ratio(of(model, err), of(model, F.col("y"))).alias("model"),
        ratio(of(naive, err), of(naive, F.col("y"))).alias("naive"),
    )
    better = F.col("model") < F.col("naive")
    return per_entity.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(better).alias("n_better"),
        (ratio(F.sum(F.when(better, F.col("y")).otherwise(0.0)), F.sum("y")) * 100.0).alias(
            "value_share_pct"
        ),
    )


def monthly_bias(rows: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Signed percent error of the summed forecast, per candidate and month."""
    shared = rows.where("pred IS NOT NULL")
    sums = shared.groupBy("candidate", spec.date).agg(
        F.sum("y").alias("actual"), F.sum("pred").alias("forecast")
    )
    return sums.withColumn(
        "error_pct", (ratio(F.col("forecast"), F.col("actual")) - 1.0) * 100.0
    )


def fold_bounds(train_end: str, n_folds: int = 5, months: int = 6) -> list[tuple[int, date, date]]:
    """(fold, cutoff, end): train up to the cutoff, validate from there up to the end.

    The last fold ends at ``train_end``, so the holdout is never touched.
    """
    last = date.fromisoformat(train_end)

    def earlier(n: int) -> date:
        m = last.year * 12 + last.month - 1 - n
        return date(m // 12, m % 12 + 1, 1)

    return [
        (i, earlier(months * (n_folds - i + 1)), earlier(months * (n_folds - i)))
        for i in range(1, n_folds + 1)
    ]


def expanding_folds(
    frame: DataFrame,
    train_end: str,
    n_folds: int = 5,
    months: int = 6,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Rows copied into each fold they take part in, with ``fold`` and ``role``.

    Bounds are constants, so no join is needed.
    """
    folds = F.array(
        *[
            F.struct(F.lit(i).alias("fold"), F.lit(c).alias("cutoff"), F.lit(e).alias("fold_end"))
            for i, c, e in fold_bounds(train_end, n_folds, months)
        ]
    )
    role = F.when(F.col(spec.date) <= F.col("cutoff"), "train").when(
        F.col(spec.date) <= F.col("fold_end"), "valid"
    )
    return (
        frame.select("*", F.inline(folds)).withColumn("role", role).where("role IS NOT NULL")
    )


def validation_rows(
    frame: DataFrame,
    train_end: str,
    n_folds: int = 5,
    months: int = 6,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Only the validation rows, each with its ``fold``: their windows do not overlap."""
    fold = F.lit(None).cast("int")
    for i, cutoff, end in fold_bounds(train_end, n_folds, months):
        inside = (F.col(spec.date) > F.lit(cutoff)) & (F.col(spec.date) <= F.lit(end))
        fold = F.when(inside, F.lit(i)).otherwise(fold)
    return frame.withColumn("fold", fold).where("fold IS NOT NULL")


def fold_sizes(folds: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(spec.date).alias("first_month"),
        F.max(spec.date).alias("last_month"),
    )


def cv_scores(
    valid_rows: DataFrame, spec: PanelSpec = PanelSpec(), metric: str = "zone_wmape"
) -> DataFrame:
    """Mean of the per-fold metric of each candidate."""
    per_fold = score(valid_rows, spec, by=("candidate", "fold"))
    return per_fold.groupBy("candidate").agg(
        F.count(metric).alias("n_folds"), F.avg(metric).alias("cv_wmape")
    )


def select_candidate(scores: DataFrame) -> DataFrame:
    """Flag the smallest cross-validated error; the holdout never decides."""
    best = scores.agg(F.min(F.struct("cv_wmape", "candidate"))["candidate"]).scalar()
    return scores.withColumn("selected", F.col("candidate") == best)
