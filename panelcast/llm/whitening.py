"""Embedding whitening: principal components of distinct vectors by MLlib block matrices."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.ordering import running
from panelcast.llm.common import arrow_pass, materialise, task_number
from panelcast.llm.topk import finite

BLOCK_ROWS = 1024
# Blocks of one task of the scatter product; 1024 rows of 64 numbers are half a MB.
SCATTER_BLOCKS = 16
# The dimensions are cut into so many column blocks for the projection. MLlib deals a tall
# result to about the square root of its partitions; with split columns each of these is
# cut again, so that what meets in one task stays small.
PROJECTION_CUTS = 8
# Variances below this share of the largest are rounding, not variance.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fitted projection: ``matrix`` takes centred vectors to uncorrelated unit variances."""

    n: int  # vectors fitted
    sums: np.ndarray  # their sum in each dimension, as Python integers
    matrix: np.ndarray  # dimensions x components
    variances: np.ndarray  # of the components, falling
    explained: np.ndarray  # share of the whole variance
    identity_error: float  # largest deviation of the whitened covariance from the identity


def integer_vectors(
    df: DataFrame, *, id_col="vec_id", vector_col="embedding", scale: float = 256
) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each component; null and non-finite vectors go."""
    vector = F.col(vector_col).cast("array<double>")
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    rows = df.where(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return materialise(rows)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of an int64 matrix; shorter ones are padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: as int64 where that is surely wide enough, else as integers."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def packed(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` centred rows, numbered from 0 without gaps, written once.

    (block, ids, no_id, deviations, centred): little-endian binaries; a block has the rows of one
    task in their order, the last of a task may be shorter. ``no_id`` lists the positions
    of rows without id.
    """
    width = len(sums)

    def work(batches):
        held, nth, task = [], 0, task_number()

        def block(table):
            x = _integers(table.column("x").combine_chunks(), width)
            off = _deviation(x, n, sums)
            square = (off * off).sum(axis=1) if width else np.zeros(len(x), np.int64)
            if off.dtype == object and max(square, default=0) >= 1 << 63:
                raise OverflowError("a squared deviation does not fit 64 bits")
            ids = table.column("vec_id").combine_chunks()
            columns = [
                pa.array([task], pa.int32()),
                pa.array([nth], pa.int32()),
                pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                pa.array([np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist()], pa.list_(pa.int32())),
                pa.array([square.astype("<i8").tobytes()], pa.binary()),
                pa.array([(off / n).astype("<f8").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["_task", "_nth", "ids", "no_id", "deviations", "centred"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK_ROWS))
                nth += 1
                held = table.slice(BLOCK_ROWS).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    blocks = materialise(
        arrow_pass(
            rows.select("vec_id", "x"),
            work,
            "_task int, _nth int, ids binary, no_id array<int>, deviations binary, centred binary",
        )
    )
    order = ["_task", "_nth"]
    numbered = materialise(running(blocks.select(*order), [F.col(c) for c in order]))
    number = (F.col("position") - 1).cast("int").alias("block")
    return blocks.join(numbered, order).select(number, "ids", "no_id", "deviations", "centred")


def block_matrix(blocks: DataFrame, count: int, width: int, cols: int) -> BlockMatrix:
    """The centred rows as a distributed matrix; a short block is filled with zero rows."""

    def cut(row):
        values = np.frombuffer(row["centred"], "<f8").reshape(-1, width)
        full = np.zeros((BLOCK_ROWS, width))
        full[: len(values)] = values
        for j, lo in enumerate(range(0, width, cols)):
            part = full[:, lo : lo + cols]
            yield (row["block"], j), DenseMatrix(BLOCK_ROWS, part.shape[1], part.ravel(order="F"))

    return _distributed(blocks.sparkSession, blocks.select("block", "centred").rdd.flatMap(cut), BLOCK_ROWS, cols, count * BLOCK_ROWS, width)


def _distributed(spark: SparkSession, pieces: RDD, rows_per_block: int, cols_per_block: int, rows: int, cols: int) -> BlockMatrix:
    """What ``BlockMatrix`` makes of ((i, j), matrix) pairs, without checking each number's type."""
    schema = "struct<blockRowIndex:bigint,blockColIndex:bigint>"
    fields = T.StructType([T.StructField("blockIndex", T._parse_datatype_string(schema)), T.StructField("subMatrix", MatrixUDT())])
    df = spark.createDataFrame(pieces, fields, verifySchema=False)
    return BlockMatrix(
        callMLlibFunc("createBlockMatrix", df, rows_per_block, cols_per_block, rows, cols), rows_per_block, cols_per_block
    )


def multiply(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """``a.multiply(b)``, the inner blocks dealt to ``splits`` tasks for each part of the result.

    The JVM's method takes that number; the Python one only lacks the argument.
    """
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _projected(blocks: DataFrame, count: int, matrix: np.ndarray) -> DataFrame:
    """(block, whitened): the blocks' rows times the matrix, as little-endian binaries."""
    spark = blocks.sparkSession
    width, wide = matrix.shape
    cols = -(-width // PROJECTION_CUTS)
    pieces = [
        ((j, 0), DenseMatrix(len(matrix[lo : lo + cols]), wide, matrix[lo : lo + cols].ravel(order="F")))
        for j, lo in enumerate(range(0, width, cols))
    ]
    right = _distributed(spark, spark.sparkContext.parallelize(pieces, 1), cols, wide, width, wide)
    product = multiply(block_matrix(blocks, count, width, cols), right, len(pieces))

    def row(piece):
        (i, _), part = piece
        return int(i), bytearray(np.ascontiguousarray(part.toArray(), "<f8").tobytes())

    return spark.createDataFrame(product.blocks.map(row), "block int, whitened binary")


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Components of the different vectors among (vec_id, x); None without any vector.

    Counts and sums are exact. The scatter matrix is the product of the distributed blocks
    of centred rows with themselves; only it, dimensions squared, comes to the driver.
    Components without variance are left out.
    """
    width = vectors.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fitted = materialise(vectors.select(filled.alias("x")).distinct())
    n = fitted.count()
    sums = np.zeros(width, dtype=object)
    entries = fitted.select(F.posexplode("x").alias("pos", "x")).groupBy("pos")
    for row in entries.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total")).collect():
        sums[row["pos"]] = int(row["total"])
    if not width:
        none = np.zeros(0)
        return Whitening(n, sums, np.zeros((0, 0)), none, none, 0.0)

    blocks = packed(fitted.select(F.lit(0).cast("long").alias("vec_id"), "x"), n, sums)
    count = blocks.count()
    a = block_matrix(blocks, count, width, width).persist(StorageLevel.MEMORY_AND_DISK)  # both factors read it
    scatter = multiply(a.transpose(), a, -(-count // SCATTER_BLOCKS)).toLocalMatrix().toArray()
    a._java_matrix_wrapper.call("blocks").unpersist(False)
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors_ = values[order], vectors_[:, order]
    real = values > LEAST_SHARE * max(values.max(initial=0.0), np.finfo(float).tiny)
    values, vectors_ = values[real], vectors_[:, real]
    matrix = vectors_ / np.sqrt(values)
    trace = np.trace(covariance)
    explained = values / trace if len(values) else values
    if not len(values):
        return Whitening(n, sums, matrix, values, explained, 0.0)
    error = _identity_error(_projected(blocks, count, matrix), n, matrix.shape[1])
    return Whitening(n, sums, matrix, values, explained, error)


def _identity_error(projected: DataFrame, n: int, wide: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity.

    Each block gives its sums and centred products; padding rows are zero before and after
    the projection, so the count of rows is the true one.
    """

    def sums(batches):
        for batch in batches:
            total = np.zeros((len(batch), wide))
            for i, raw in enumerate(batch.column("whitened")):
                total[i] = np.frombuffer(raw.as_py(), "<f8").reshape(-1, wide).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(total.tolist(), pa.list_(pa.float64()))], ["sums"])

    def products(batches):
        for batch in batches:
            out = []
            for raw in batch.column("whitened"):
                rows = np.frombuffer(raw.as_py(), "<f8").reshape(-1, wide)
                rows = rows[rows.any(axis=1)] - mean
                out.append(np.append((rows.T @ rows).ravel(), len(rows)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["sums"])

    def added(work) -> np.ndarray:
        parts = arrow_pass(written, work, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        rows = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        return np.array([r["v"] for r in rows])

    written = materialise(projected)
    mean = added(sums) / n
    total = added(products)
    # rows that are exactly zero were skipped with the padding: each is minus the mean
    covariance = (total[:-1].reshape(wide, wide) + (n - total[-1]) * np.outer(mean, mean)) / n
    return float(np.abs(covariance - np.eye(wide)).max())


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, deviation, whitened) of every row of (vec_id, x), repeated rows included.

    ``deviation`` is the exact sum over dimensions of (n * x - sums)^2. ``whitened`` has a
    number for each component; rows never meet by vector, so a common vector is no hot key.
    """
    schema = "vec_id long, deviation long, whitened array<double>"
    if model is None or not model.matrix.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    wide = model.matrix.shape[1]
    blocks = packed(vectors, model.n, model.sums)
    projected = _projected(blocks, blocks.count(), model.matrix)

    def rows(batches):
        for batch in batches:
            for ids, no_id, deviations, whitened in zip(*batch.columns, strict=True):
                ids = np.frombuffer(ids.as_py(), "<i8")
                missing = np.zeros(len(ids), np.bool_)
                missing[no_id.as_py()] = True
                values = np.frombuffer(whitened.as_py(), "<f8")[: len(ids) * wide]
                ends = np.arange(0, len(values) + 1, wide, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=missing),
                        pa.array(np.frombuffer(deviations.as_py(), "<i8")),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    ],
                    ["vec_id", "deviation", "whitened"],
                )

    joined = blocks.drop("centred").join(projected, "block").select("ids", "no_id", "deviations", "whitened")
    return arrow_pass(joined, rows, schema)


def whitened_embeddings(
    df: DataFrame, components: int = 4, *, id_col="vec_id", vector_col="embedding", scale: float = 256
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row.

    A row for each vector and each of the leading components with variance, numbered from
    1. Null vectors and those with null or non-finite entries take no part; a shorter
    vector is filled with zeros, an empty one is all zeros. Copies are fitted once and
    projected each; rows without id keep a null id. One vector alone, or dimensions
    without variance, have no component, so an input without any gives an empty result. A
    squared deviation beyond 64 bits fails the job.
    """
    vectors = integer_vectors(df, id_col=id_col, vector_col=vector_col, scale=scale)
    model = fit(vectors, components)
    explained = [] if model is None else [float(e) for e in model.explained]
    error = math.nan if model is None else model.identity_error
    return (
        whiten(vectors, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
        .select(
            "vec_id",
            (F.col("_at") + 1).alias("component"),
            F.lit(0 if model is None else model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(F.array(*map(F.lit, explained or [math.nan])), F.col("_at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
