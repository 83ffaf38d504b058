"""Outputs of training and scoring runs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.encoding import CodeMaps
from panelcast.spec import SPLIT, TRAIN


def write_reference(cleaned: DataFrame, path: str) -> None:
    """The train rows with their features, refreshed at each training."""
    cleaned.where(F.col(SPLIT) == TRAIN).write.mode("overwrite").parquet(path)


def append_prediction_log(tagged_forecast: DataFrame, path: str, day: str) -> None:
    """One JSON row per forecast under ``dt=<day>``; earlier runs stay untouched."""
    tagged_forecast.withColumn("dt", F.lit(day)).write.partitionBy("dt").mode("append").option(
        "ignoreNullFields", False
    ).json(path)


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Metrics or gate verdicts of one run, keyed by ``run_id``."""
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline in a new directory; an existing version is never replaced."""
    model.write().save(path)


def save_codes(codes: CodeMaps, path: str) -> None:
    """The vocabularies of a model, in a new directory beside it."""
    codes.entity.write.parquet(f"{path}/entity")
    codes.segment.write.parquet(f"{path}/segment")


def load_codes(spark: SparkSession, path: str) -> CodeMaps:
    return CodeMaps(spark.read.parquet(f"{path}/entity"), spark.read.parquet(f"{path}/segment"))
