"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import materialise, small_batches

SLICES = 4
ROWS_PER_TILE = 8192
QUERIES_PER_TILE = 2048
STRIP = 128  # queries whose scores a task holds at a time
EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    """A vector that is there, with only finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 x) of each vector as float64; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _parts(queries: np.ndarray, rows: np.ndarray, slices: int) -> np.ndarray:
    """Integer partial inner products, (slices, queries, rows).

    Doubles hold them exactly below 2^53; beyond it Python's integers are used. Where partial
    scores could add up to 2^63 the job fails, so that no sum wraps.
    """
    bounds = np.linspace(0, queries.shape[1], slices + 1).astype(int)
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    out = np.empty((slices, len(queries), len(rows)), np.int64)
    room = 1 << 63
    if most >= EXACT:
        whole = np.vectorize(int, otypes=[object])
        queries, rows = whole(queries), whole(rows)
    for s, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        product = queries[:, lo:hi] @ rows[:, lo:hi].T if hi > lo else np.zeros(out.shape[1:])
        if most >= EXACT:
            product = np.vectorize(int, otypes=[object])(product) if product.size else product
            room -= int(np.abs(product).max(initial=0))
            if room <= 0:
                raise OverflowError("scores of these vectors do not fit 64 bits")
        out[s] = product
    return out


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (score, then smaller id) of each query."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    *,
    id_col="vec_id",
    vector_col="embedding",
    slices: int = SLICES,
    rows_per_tile: int = ROWS_PER_TILE,
    queries_per_tile: int = QUERIES_PER_TILE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query row, none of its own id.

    Vectors are cut into ``slices``, which play the nodes of the method, and the work into
    tiles of bounded size (a block of rows by a block of queries).

    1. Each tile sends, per query and slice, its k best partial scores and its least one.
       Partial scores seen, with the least for those not seen, bound scores from below;
       the k-th best bound is the query's cutoff.
    2. The cutoffs go to every tile. A row can only reach the cutoff if one of its
       partial scores reaches the slice's even share of it: such rows are sufficient.
    3. Sufficient rows whose upper bound reaches the cutoff get their exact score; a tile
       sends its k best, and the k best of those are the result.

    Null, NaN or infinite components and null ids take no part; shorter vectors count as
    padded with zeros; ties go to the smaller id; repeated rows are rows of their own.
    Fewer rows than k give fewer results; without rows or queries the result is empty.
    Components so large that scores, or bounds of them, could exceed 64 bits fail the job.
    """
    small_batches(df.sparkSession)
    vectors = materialise(
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q"))
        .where(F.col("vec_id").isNotNull() & finite(F.col("v")))
        .withColumn("row", F.monotonically_increasing_id())
    )
    n, n_queries, width = vectors.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)), F.max(F.size("v"))
    ).first()
    shards, blocks = max(1, -(-n // rows_per_tile)), max(1, -(-n_queries // queries_per_tile))
    width = max(width or 0, 1)

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    rows = vectors.select("row", "vec_id", "v").withColumns({"shard": dealt(shards), "block": every(blocks)})
    queries = (
        vectors.where("q")
        .select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
        .withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int"))
    )

    def tiles(queries: DataFrame, work, schema: str) -> DataFrame:
        spread = queries.withColumn("shard", every(shards))
        left, right = spread.groupBy("shard", "block"), rows.groupBy("shard", "block")
        return left.cogroup(right).applyInArrow(work, schema)

    def strips(q: pa.Table, r: pa.Table):
        """Queries in strips with the partial scores; own rows are marked."""
        of_rows, vec = _matrix(r.column("v"), width), r.column("vec_id").to_numpy()
        of_queries, ids = _matrix(q.column("qv"), width), q.column("query_id").to_numpy()
        for lo in range(0, len(ids), STRIP):
            at = slice(lo, lo + STRIP)
            yield at, _parts(of_queries[at], of_rows, slices), ids[at, None] == vec[None, :]

    lists = "query_row long, slice int, row long, part long"

    def local_lists(q: pa.Table, r: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if q.num_rows and r.num_rows:
            query_rows, row_ids = q.column("query_row").to_numpy(), r.column("row").to_numpy()
            for at, parts, own in strips(q, r):
                keep = min(k + 1, parts.shape[2])
                for s in range(slices):
                    part = parts[s]
                    top = np.argpartition(-part, keep - 1, axis=1)[:, :keep]
                    least = part.argmin(axis=1)[:, None]
                    for where, seen in ((top, True), (least, False)):
                        use = ~np.take_along_axis(own, where, 1).ravel() if seen else slice(None)
                        found[0].append(np.repeat(query_rows[at], where.shape[1])[use])
                        found[1].append(np.full(where.size, s, np.int32)[use])
                        found[2].append((row_ids[where].ravel() if seen else np.full(where.size, -1))[use])
                        found[3].append(np.take_along_axis(part, where, 1).ravel()[use])
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [
            pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, kinds, strict=True)
        ]
        return pa.table(arrays, names=["query_row", "slice", "row", "part"])

    gathered = materialise(tiles(queries, local_lists, lists))
    least = (
        gathered.where("row = -1")
        .groupBy("query_row", "slice")
        .agg(F.min("part").alias("least"))
    )
    base = least.groupBy("query_row").agg(
        F.sum("least").alias("base"),
        F.transform(F.array_sort(F.collect_list(F.struct("slice", "least"))), lambda x: x["least"]).alias("leasts"),
    )
    by_bound = Window.partitionBy("query_row").orderBy(F.desc("bound"))
    cutoff = (
        gathered.where("row >= 0")
        .join(least, ["query_row", "slice"])
        .groupBy("query_row", "row")
        .agg(F.sum(F.col("part") - F.col("least")).alias("bound"))
        .withColumn("n", F.row_number().over(by_bound))
        .where(F.col("n") == k)
        .select("query_row", "bound")
    )
    # a share rounded down keeps the cutoff safe
    share = F.floor(F.col("bound") / slices)
    cutoffs = base.join(cutoff, "query_row", "left").select(
        "query_row",
        (F.col("base") + F.col("bound")).alias("tau"),
        F.transform("leasts", lambda x: x + share).alias("cuts"),
    )

    def resolve(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if q.num_rows and r.num_rows:
            vec, row_ids = r.column("vec_id").to_numpy(), r.column("row").to_numpy()
            query_rows, ids = q.column("query_row").to_numpy(), q.column("query_id").to_numpy()
            tau = q.column("tau").to_pylist()
            cuts = q.column("cuts").to_pylist()
            lowest = np.iinfo(np.int64).min
            tau_of = np.array([lowest if t is None else t for t in tau])
            cut_of = np.array([[lowest // (2 * slices)] * slices if t is None else c for t, c in zip(tau, cuts, strict=True)])
            for at, parts, own in strips(q, r):
                cut, cutoff_of = cut_of[at].T[:, :, None], tau_of[at][:, None]
                sufficient = (parts >= cut).any(axis=0) & ~own
                upper = np.maximum(parts, cut).sum(axis=0)
                i, j = np.nonzero(sufficient & (upper >= cutoff_of))
                score = parts[:, i, j].sum(axis=0)
                enough = score >= tau_of[at][i]
                i, j, score = i[enough], j[enough], score[enough]
                best = _best(i, score, vec[j], k)
                i, j, score = i[best], j[best], score[best]
                for column, values in zip(out, (query_rows[at][i], ids[at][i], vec[j], score), strict=True):
                    column.append(values)
        arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
        return pa.table(arrays, names=["query_row", "query_id", "vec_id", "score"])

    result = "query_row long, query_id long, vec_id long, score long"
    entries = tiles(queries.join(cutoffs, "query_row", "left"), resolve, result)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        entries.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
