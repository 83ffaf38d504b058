"""Category codes: rank of each distinct value, ascending, from 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.lineage import materialise
from panelcast.functions.ordering import keys_to_split, running, salted_join
from panelcast.spec import PanelSpec


@dataclass(frozen=True)
class CodeMaps:
    """Fitted vocabularies, kept as (value, code) tables beside a model."""

    entity: DataFrame
    segment: DataFrame


def fit_codes(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> CodeMaps:
    """Both vocabularies from one pass over the distinct members.

    Members are numbered in one global order, entities first; a segment's code then
    leaves out the entities counted before it.
    """
    members = (
        panel.select(*spec.series)
        .distinct()
        .select(
            F.inline(
                F.array(
                    F.struct(F.lit(1).alias("is_entity"), F.col(spec.entity).alias("value")),
                    F.struct(F.lit(0).alias("is_entity"), F.col(spec.segment).alias("value")),
                )
            )
        )
        .where("value IS NOT NULL")
        .distinct()
    )
    order = [F.desc("is_entity"), F.col("value")]
    ranked = running(members, order, sums={"entities": "is_entity"})
    skipped = F.when(F.col("is_entity") == 0, F.col("entities")).otherwise(0)
    coded = materialise(
        ranked.select("is_entity", "value", (F.col("position") - 1 - skipped).cast("int").alias("code"))
    )

    def one(flag: int) -> DataFrame:
        return coded.where(F.col("is_entity") == flag).select("value", "code")

    return CodeMaps(one(1), one(0))


def apply_map(df: DataFrame, codes: DataFrame, column: str, code: str) -> DataFrame:
    """Look codes up; a value outside the vocabulary gets NULL.

    The map is a written table of known size: the optimizer broadcasts it while it is
    small and falls back to a shuffled join when it is not.
    """
    lookup = codes.select(F.col("value").alias(column), F.col("code").alias(code))
    return df.join(lookup, column, "left")


def apply_codes(df: DataFrame, codes: CodeMaps, spec: PanelSpec = PanelSpec()) -> DataFrame:
    with_entity = apply_map(df, codes.entity, spec.entity, spec.entity_code)
    return apply_map(with_entity, codes.segment, spec.segment, spec.segment_code)


def nominal_indexers(
    codes: CodeMaps, spec: PanelSpec = PanelSpec(), invalid: str = "error"
) -> list[StringIndexerModel]:
    """Pipeline stages that restore the categoricals with the full vocabulary.

    Built from the fitted maps, not from the rows being scored, so a payload with few
    members keeps every category in the column's ML metadata. The labels are held by
    the model on the driver, as a tree's categorical features must be anyway.
    """

    def stage(m: DataFrame, column: str, code: str) -> StringIndexerModel:
        labels = [r["value"] for r in m.orderBy("code").select("value").collect()]
        return StringIndexerModel.from_labels(
            labels, inputCol=column, outputCol=code, handleInvalid=invalid
        )

    return [
        stage(codes.entity, spec.entity, spec.entity_code),
        stage(codes.segment, spec.segment, spec.segment_code),
    ]


# So many rows of a member weigh as much as the mean of all members.
PRIOR_ROWS = 20.0
NEW_ROWS = -1  # instead of a fold: for rows that the encoding was not fitted on


def target_encoding(
    train: DataFrame, column: str, target: str, fold: Column, prior: float = PRIOR_ROWS
) -> DataFrame:
    """(column, fold, encoded): each member's mean target without the rows of a fold, written.

    The mean is drawn to that of all rows outside the fold, as if ``prior`` more rows had it.
    Fold ``NEW_ROWS`` uses every row; its entry with a NULL member is for unknown ones. The
    vocabulary stays a table: however many members there are, none of it passes the driver.
    """
    rows = train.where(F.col(target).isNotNull() & F.col(column).isNotNull())
    sums = materialise(
        rows.groupBy(column, fold.cast("int").alias("fold")).agg(
            F.sum(target).alias("_s"), F.count(F.lit(1)).alias("_n")
        )
    )
    whole = sums.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n"))).scalar()
    folds = sums.groupBy("fold").agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    members = sums.groupBy(column).agg(F.sum("_s").alias("_ms"), F.sum("_n").alias("_mn"))
    of_all = members.select("*", whole.alias("_w"))

    def drawn(s: Column, n: Column, mean: Column) -> Column:
        return ((s + F.lit(prior) * mean) / (n + F.lit(prior))).alias("encoded")

    total, count = F.col("_w.s"), F.col("_w.n")
    new = of_all.select(
        column, F.lit(NEW_ROWS).alias("fold"), drawn(F.col("_ms"), F.col("_mn"), total / count)
    )
    unknown = sums.groupBy().agg((F.sum("_s") / F.sum("_n")).alias("encoded")).where("encoded IS NOT NULL")
    unknown = unknown.select(
        F.lit(None).cast(train.schema[column].dataType).alias(column), F.lit(NEW_ROWS).alias("fold"), "encoded"
    )
    outside = (total - F.col("_fs")) / F.nullif(count - F.col("_fn"), F.lit(0))
    own = (
        sums.join(of_all, column)
        .join(materialise(folds), "fold")
        .select(
            column,
            "fold",
            drawn(F.col("_ms") - F.col("_s"), F.col("_mn") - F.col("_n"), F.coalesce(outside, total / count)),
        )
    )
    return materialise(own.unionByName(new).unionByName(unknown))


def apply_target_encoding(
    df: DataFrame, encoding: DataFrame, column: str, name: str, fold: Column | None = None
) -> DataFrame:
    """Add ``name``: the member's entry of the row's own fold, or that for new rows.

    A member without an entry, or a NULL one, has the value for unknown members. Members are
    counted in ``df`` first, so it should be written already: those with very many rows are
    split where the table is not broadcast, and the entries of all others are sent once.
    """
    of_fold = F.lit(NEW_ROWS) if fold is None else fold.cast("int")
    unknown = encoding.where(F.col(column).isNull()).agg(F.max("encoded")).scalar()
    lookup = encoding.where(F.col(column).isNotNull()).select(
        F.col(column), F.col("fold").alias("_fold"), F.col("encoded").alias(name)
    )
    salt = F.struct(*[F.col(c) for c in df.columns if c != column][:3])
    joined = salted_join(
        df.withColumn("_fold", of_fold), lookup, [column, "_fold"], salt, "left", keys_to_split(df, column)
    )
    return joined.drop("_fold").withColumn(name, F.coalesce(F.col(name), unknown))
