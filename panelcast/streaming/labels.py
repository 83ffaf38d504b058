"""The prediction log as a file stream, and the errors of its forecasts once actuals are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.columns import pct_change
from panelcast.spec import PanelSpec

# A repeat of a logged forecast is recognised while the stream reads it within so many days
# of log time; ``collected`` recognises the others.
REPEATS_WITHIN = "400 days"


def log_schema(spec: PanelSpec = PanelSpec()) -> T.StructType:
    """What ``sinks.append_prediction_log`` writes; ``dt`` is the day's folder."""
    text, number = T.StringType(), T.DoubleType()
    columns = [
        (spec.entity, text), (spec.segment, text), ("target_month", T.DateType()), ("last_actual", number),
        ("prediction", number), ("pct_change", number), ("source", text), ("model_version", text),
        ("contract_version", T.IntegerType()), ("run_id", text), ("dt", T.DateType()),
    ]
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


def _identity(spec: PanelSpec) -> list[str]:
    """What tells one forecast from another: a run forecasts a series' month once."""
    return ["run_id", *spec.series, "target_month"]


def collect_log(
    spark: SparkSession, log: str, store: str, checkpoint: str, spec: PanelSpec = PanelSpec()
) -> None:
    """Take what was logged since the last call into ``store``, once, and return.

    The files that were read and the forecasts seen are kept in ``checkpoint``, so a call
    after a failure or a restart goes on where the last one ended; nothing is read twice.
    Rows that repeat a forecast are dropped, and their state is let go as log time moves on.
    """
    rows = spark.readStream.schema(log_schema(spec)).json(log)
    once = (
        rows.withColumn("logged_at", F.col("dt").cast("timestamp"))
        .withWatermark("logged_at", REPEATS_WITHIN)
        .dropDuplicatesWithinWatermark(_identity(spec))
    )
    run = (
        once.writeStream.format("parquet")
        .option("path", store)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def collected(spark: SparkSession, store: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The forecasts of the store, each once however late it was repeated."""
    stored = T.StructType([*log_schema(spec).fields, T.StructField("logged_at", T.TimestampType())])
    rows = spark.read.schema(stored).parquet(store).drop("logged_at")
    others = [F.min(F.struct("dt", *_payload(spec))).alias("first")]
    first = rows.groupBy(*_identity(spec)).agg(*others)
    return first.select(*_identity(spec), "first.*")


def _payload(spec: PanelSpec) -> list[str]:
    return [c for c in log_schema(spec).names if c not in (*_identity(spec), "dt")]


def realised_errors(
    forecasts: DataFrame, actuals: DataFrame, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Each forecast with the actual of its month, if there is one by now.

    ``error_pct`` is the forecast's signed error in per cent of the actual. A month without
    an actual leaves the forecast open: it is there with NULLs, not missing.
    """
    seen = actuals.select(
        *spec.series, F.col(spec.date).alias("target_month"), F.col(spec.target).alias("actual")
    )
    return (
        forecasts.select("run_id", "model_version", "source", *spec.series, "target_month", "prediction")
        .join(seen, [*spec.series, "target_month"], "left")
        .withColumn("error_pct", pct_change(F.col("prediction"), F.col("actual")))
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Per run and month: forecasts, those still open, wMAPE and bias of the others."""
    there = F.col("actual").isNotNull() & F.col("prediction").isNotNull()
    actual, predicted = F.when(there, F.col("actual")), F.when(there, F.col("prediction"))
    return errors.groupBy("run_id", "model_version", "target_month").agg(
        F.count(F.lit(1)).alias("n_forecasts"),
        F.count_if(F.col("actual").isNull()).alias("n_open"),
        (F.try_divide(F.sum(F.abs(actual - predicted)), F.sum(actual)) * 100.0).alias("wmape"),
        pct_change(F.sum(predicted), F.sum(actual)).alias("bias_pct"),
    )
