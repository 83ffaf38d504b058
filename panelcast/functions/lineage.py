"""Cutting lineage with tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only in local mode."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="panelcast-")
    return _local_folders[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and return the scan of what was written.

    Used where several branches of a plan read the same expensive result, or where
    later steps must see one fixed outcome (fitted values, physical partition ids).
    The files outlive executors, and the scan brings column pruning and real sizes,
    from which the optimizer decides about broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelcast-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
