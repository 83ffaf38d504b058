"""Train, backtest and gate a learner on a panel."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise
from panelcast.operators.baselines import blend, with_ar1, with_baselines
from panelcast.operators.encoding import CodeMaps, apply_codes, fit_codes
from panelcast.operators.evaluate import (
    EXTENDED,
    candidate_rows,
    cv_scores,
    evaluate,
    fold_bounds,
    quality_gate,
    score,
    select_candidate,
    validation_rows,
    with_scale,
)
from panelcast.operators.features import (
    add_training_target,
    clean_for_training,
    stamp_split,
    transform,
)
from panelcast.operators.learners import fit_order, predict_level
from panelcast.sources.panel import drop_total
from panelcast.sources.sinks import (
    append_metrics,
    load_codes,
    save_codes,
    save_model,
    write_reference,
)
from panelcast.spec import SPLIT, TEST, TRAIN, PanelSpec

Learner = Callable[[CodeMaps], Pipeline]


def backtest_frame(panel: DataFrame, train_end: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Cleaned rows with target, split, error scale and every learner-free prediction.

    One shuffle by series serves the features, the baselines, the AR(1) fit and the
    scale; the codes come from the model's own pipeline.
    """
    stamped = stamp_split(drop_total(panel, spec), train_end, spec)
    features = add_training_target(transform(stamped, spec))
    predicted = with_ar1(with_baselines(features, spec), spec)
    return with_scale(clean_for_training(predicted, spec), spec)


@dataclass(frozen=True)
class Backtest:
    """What a training run leaves behind."""

    model: PipelineModel
    codes: CodeMaps
    frame: DataFrame
    test: DataFrame
    metrics: DataFrame
    gate: DataFrame


def train_and_backtest(
    panel: DataFrame,
    train_end: str,
    learner: Learner,
    spec: PanelSpec = PanelSpec(),
    name: str = "model",
    parts: int | None = None,
) -> Backtest:
    """Fit on train rows, score the untouched holdout, compare with persistence, gate.

    The frame is written once because fit, scale and evaluation all read it.
    """
    codes = fit_codes(drop_total(panel, spec), spec)
    frame = materialise(backtest_frame(panel, train_end, spec))
    test = frame.where(F.col(SPLIT) == TEST)
    if test.isEmpty():
        raise ValueError(f"no holdout rows after {train_end}")
    model = learner(codes).fit(fit_order(frame.where(F.col(SPLIT) == TRAIN), spec, parts))
    scored = predict_level(model, test, name)
    metrics = evaluate(scored, [name, "naive"], spec, EXTENDED)
    return Backtest(model, codes, frame, scored, metrics, quality_gate(metrics, name))


def keep_run(run: Backtest, folder: str, run_id: str, spec: PanelSpec = PanelSpec()) -> None:
    """All that another session needs to score, in ``folder``.

    The model and its code maps in directories of their own; metrics and verdicts appended;
    the reference refreshed, with all model inputs, from the frame the run already wrote.
    """
    save_model(run.model, f"{folder}/models/{run_id}")
    save_codes(run.codes, f"{folder}/codes/{run_id}")
    append_metrics(run.metrics, f"{folder}/metrics", run_id)
    append_metrics(run.gate, f"{folder}/gates", run_id)
    write_reference(apply_codes(run.frame, run.codes, spec), f"{folder}/reference")


def load_run(spark: SparkSession, folder: str, run_id: str) -> tuple[PipelineModel, CodeMaps]:
    """What ``score_payload`` needs of a kept run."""
    return PipelineModel.load(f"{folder}/models/{run_id}"), load_codes(spark, f"{folder}/codes/{run_id}")


# Fits that share the cluster; each is a row of small jobs that leave most of it idle.
AT_ONCE = 4


def _together(spark: SparkSession, work: Callable, tasks: list, at_once: int) -> list:
    """``work`` of each task, in their order; the driver's threads only wait for Spark's jobs."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), tasks))


def random_search(
    frame: DataFrame,
    train_end: str,
    learner: Callable[..., Pipeline],
    codes: CodeMaps,
    grid: dict[str, list],
    draws: int = 40,
    n_folds: int = 5,
    months: int = 6,
    seed: int = 42,
    spec: PanelSpec = PanelSpec(),
    metric: str = "zone_wmape",
    parts: int | None = None,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Random draws of hyper-parameters on expanding folds, the best one flagged.

    Each fit is a distributed job on a date range of the one written frame, ``at_once`` of
    them share the cluster, and the driver only keeps an error per draw and fold.
    """
    settings = list(itertools.product(*grid.values()))
    picked = random.Random(seed).sample(settings, min(draws, len(settings)))
    train = frame.where(F.col(SPLIT) == TRAIN)
    laid_out = fit_order(train, spec, parts)
    day = F.col(spec.date)

    def error(task) -> tuple[str, int, float]:
        values, (fold, cutoff, end) = task
        params = dict(zip(grid, values, strict=True))
        model = learner(codes, **params).fit(laid_out.where(day <= F.lit(cutoff)))
        valid = laid_out.where((day > F.lit(cutoff)) & (day <= F.lit(end)))
        scored = predict_level(model, valid, "model")
        label = ", ".join(f"{k}={v}" for k, v in params.items())
        return label, fold, score(candidate_rows(scored, ["model"], spec), spec).head()[metric]

    bounds = fold_bounds(train_end, n_folds, months)
    rows = _together(frame.sparkSession, error, list(itertools.product(picked, bounds)), at_once)
    errors = frame.sparkSession.createDataFrame(
        rows, "candidate string, fold int, error double"
    )
    means = errors.groupBy("candidate").agg(
        F.count("error").alias("n_folds"), F.avg("error").alias("cv_wmape")
    )
    return select_candidate(means)


def seed_stability(
    frame: DataFrame,
    learner: Callable[..., Pipeline],
    codes: CodeMaps,
    seeds: tuple[int, ...] = (1, 2, 3, 4, 5),
    spec: PanelSpec = PanelSpec(),
    parts: int | None = None,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Range of the holdout metrics over refits with different seeds, ``at_once`` of them at a time."""
    train = fit_order(frame.where(F.col(SPLIT) == TRAIN), spec, parts)
    test = frame.where(F.col(SPLIT) == TEST)

    def metrics(seed: int) -> list[tuple[int, str, float]]:
        scored = predict_level(learner(codes, seed=seed).fit(train), test, "model")
        return [(seed, r["metric"], r["value"]) for r in evaluate(scored, ["model"], spec).collect()]

    rows = [row for found in _together(frame.sparkSession, metrics, list(seeds), at_once) for row in found]
    runs = frame.sparkSession.createDataFrame(rows, "seed int, metric string, value double")
    return runs.groupBy("metric").agg(
        F.count("value").alias("n_seeds"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def cross_validate(
    frame: DataFrame,
    train_end: str,
    candidates: list[str],
    n_folds: int = 5,
    months: int = 6,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Cross-validated error of learner-free candidates, the smallest flagged.

    Their predictions read only earlier rows of the series, so the validation rows of
    a fold can be scored without a refit.
    """
    train = frame.where(F.col(SPLIT) == TRAIN)
    valid = validation_rows(train, train_end, n_folds, months, spec)
    rows = candidate_rows(valid, candidates, spec, keep=("fold",))
    return select_candidate(cv_scores(rows, spec))


def cross_validate_learners(
    frame: DataFrame,
    train_end: str,
    learners: dict[str, Learner],
    codes: CodeMaps,
    baselines: tuple[str, ...] = ("naive", "seasonal_naive", "drift"),
    blends: dict[str, tuple[str, str, float]] | None = None,
    n_folds: int = 5,
    months: int = 6,
    spec: PanelSpec = PanelSpec(),
    parts: int | None = None,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """One table of cross-validated errors: fitted learners, blends and baselines.

    Each learner is fitted on the rows before a fold and predicts the fold, ``at_once``
    fits at a time; a blend is
    (first, second, weight of the first) of any two candidates. All are scored on the same
    rows, the smallest error is flagged, and the holdout is never read.
    """
    blends = blends or {}
    day, folds = F.col(spec.date), None
    laid_out = fit_order(frame.where(F.col(SPLIT) == TRAIN), spec, parts)
    bounds = fold_bounds(train_end, n_folds, months)

    def fitted(task) -> PipelineModel:
        (_, cutoff, _), name = task
        return learners[name](codes).fit(laid_out.where(day <= F.lit(cutoff)))

    tasks = list(itertools.product(bounds, learners))
    models = dict(zip([(b[0], name) for b, name in tasks], _together(frame.sparkSession, fitted, tasks, at_once), strict=True))
    for fold, cutoff, end in bounds:
        valid = laid_out.where((day > F.lit(cutoff)) & (day <= F.lit(end)))
        for name in learners:
            valid = predict_level(models[fold, name], valid, name)
        valid = valid.withColumn("fold", F.lit(fold))
        folds = valid if folds is None else folds.unionByName(valid)
    mixed = folds.withColumns({name: blend(a, b, w) for name, (a, b, w) in blends.items()})
    candidates = [*learners, *blends, *baselines]
    rows = candidate_rows(mixed, candidates, spec, keep=("fold",))
    return select_candidate(cv_scores(rows, spec))
