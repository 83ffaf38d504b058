"""What each input adds to a tree ensemble's prediction of each row, by joins with the trees' nodes."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise, shared_folder
from panelcast.spec import PanelSpec

BASE = "base"


def tree_nodes(model: PipelineModel) -> DataFrame:
    """(tree, node, value, feature, is_category, split, left, right) of the last stage, written.

    Read from the ensemble's own saved form; ``value`` is the node's prediction times the
    tree's weight in the sum, and a leaf has no children.
    """
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    # the columns are told by their places: their names differ between versions
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
    split = F.col("nodeData.split")
    # a forest averages its trees, boosting adds them up
    forest = isinstance(model.stages[-1], RandomForestRegressionModel)
    share = 1.0 / len(model.stages[-1].trees) if forest else 1.0
    nodes = spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData").join(trees, "treeID")
    return materialise(
        nodes.select(
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            (F.col("nodeData.prediction") * F.col("weights") * share).alias("value"),
            split.getField("featureIndex").alias("feature"),
            (split.getField("numCategories") >= 0).alias("is_category"),
            split.getField("leftCategoriesOrThreshold").alias("split"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
        )
    )


def contributions(
    model: PipelineModel, rows: DataFrame, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """(key, feature, contribution): a row for each model input, and one for ``base``.

    A row walks down every tree. Where it goes from a node to a child, the change of the
    node's prediction is credited to the input that the node asks; the roots' predictions
    are the base. So a row's contributions sum to its prediction exactly, up to rounding.

    Rows are expanded once a tree and joined with the nodes once a level; the nodes are a
    written table of known size, broadcast while it is small. Contributions are summed per
    row and input with map-side combining.
    """
    nodes = tree_nodes(model)
    ensemble = model.stages[-1].trees
    depth = max(tree.depth for tree in ensemble)
    scored = model.transform(rows).select(*spec.key, vector_to_array("features").alias("_x"))
    roots = nodes.where("node = 0").select("tree", F.col("value").alias("_value"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(len(ensemble) - 1))).alias("tree")
    # every step that was credited so far: the input's number, -1 for the base, and the change
    walk = scored.select("*", trees).join(roots, "tree")
    credit = F.struct(F.lit(-1).alias("feature"), F.col("_value").alias("change"))
    walk = walk.withColumns({"_node": F.lit(0), "_steps": F.array(credit)})
    inner = nodes.where("left >= 0").select(
        "tree", F.col("node").alias("_node"), "feature", "is_category", "split", "left", "right"
    )
    values = nodes.select("tree", F.col("node").alias("_next"), F.col("value").alias("_new"))
    for _ in range(depth):
        at = F.get("_x", F.col("feature"))
        goes_left = F.when(F.col("is_category"), F.array_contains("split", at)).otherwise(
            at <= F.get("split", F.lit(0))
        )
        moved = walk.join(inner, ["tree", "_node"], "left").withColumn(
            "_next", F.when(goes_left, F.col("left")).otherwise(F.coalesce("right", "_node"))
        )
        step = F.struct("feature", (F.col("_new") - F.col("_value")).alias("change"))
        walk = moved.join(values, ["tree", "_next"]).select(
            *spec.key,
            "_x",
            "tree",
            F.col("_next").alias("_node"),
            F.col("_new").alias("_value"),
            F.when(F.col("feature").isNull(), F.col("_steps")).otherwise(F.concat("_steps", F.array(step))).alias("_steps"),
        )
    names = F.array(*[F.lit(c) for c in spec.feature_order])
    name = F.when(F.col("feature") < 0, BASE).otherwise(F.get(names, F.col("feature")))
    summed = (
        walk.select(*spec.key, F.inline("_steps"))
        .groupBy(*spec.key, name.alias("feature"))
        .agg(F.sum("change").alias("contribution"))
    )
    # inputs that no tree asked have no step: they add nothing
    every = F.explode(F.concat(names, F.array(F.lit(BASE)))).alias("feature")
    return (
        rows.select(*spec.key, every)
        .join(summed, [*spec.key, "feature"], "left")
        .withColumn("contribution", F.coalesce("contribution", F.lit(0.0)))
    )
