"""What the operators share: Arrow passes over texts, whole-table numbering, bounded filters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.lineage import materialise

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, size: int = 16 << 20, rows: int = 2000) -> None:
    """Bound what one Arrow batch of long texts holds, where the session has no tighter bound.

    Results never depend on batches; only memory does.
    """
    conf = spark.conf
    if int(conf.get(BATCH_ROWS, "10000")) > rows:
        conf.set(BATCH_ROWS, str(rows))
    current = conf.get(BATCH_BYTES, None)
    if current is None or not current.isdigit() or int(current) > size:
        conf.set(BATCH_BYTES, str(size))


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as make it none of the columns'."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text stays null."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def arrow_pass(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``mapInArrow`` with bounded batches; every column of the result may be null."""
    small_batches(df.sparkSession)
    if isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return df.mapInArrow(work, schema)


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The values as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def in_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def hash_share(column: str, share: Column, seed: int = 0) -> Column:
    """True for that share of the rows, decided by the value's hash alone."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 40)) / float(1 << 40)
    return unit < share


# A Bloom filter of bounded size: 16 bits a key, at most 16 MB whatever the input is. It
# only thins out rows before an exact decision; a full one thins out nothing.
BLOOM_MOST = 27  # log2 of the bits
BLOOM_HASHES = 3
BLOOM_BLOCK = 1 << 12  # 64-bit words


def _bloom_slots(keys: np.ndarray, log2: int) -> list[np.ndarray]:
    h = keys.astype(np.uint64)
    out = []
    for i in range(BLOOM_HASHES):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        out.append((h >> np.uint64(64 - log2)).astype(np.int64))
    return out


class Bloom:
    """Which keys of a long column may be there."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.log2 = len(words).bit_length() + 5

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each key, False only if it was surely not marked."""
        found = np.ones(len(keys), dtype=np.bool_)
        for slots in _bloom_slots(keys, self.log2):
            found &= (self.words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


# Blocks of tasks that one task unites at a time.
FAN = 64


def fold_blocks(parts: DataFrame, unite: Callable[[Iterator[bytes]], bytes]) -> dict[int, bytes]:
    """The united block of each place, from rows (at, task, block) with a row for each task.

    Blocks are united in rounds, at most ``FAN`` of a place in one group, so no group grows
    with the number of tasks; what reaches the driver is one block a place.
    """

    def fold(table: pa.Table) -> pa.Table:
        block = unite(zlib.decompress(value.as_py()) for value in table.column("block"))
        first = table.select(["at", "task"])[:1]
        return first.append_column("block", pa.array([zlib.compress(block, 1)], pa.binary()))

    parts = materialise(parts)
    last = parts.agg(F.max("task")).first()[0]
    while last is not None:
        task = F.floor(F.col("task") / FAN).cast("int")
        groups = parts.withColumn("task", task).groupBy("at", "task")
        parts = groups.applyInArrow(fold, "at int, task int, block binary")
        last = last // FAN or None
    return {row["at"]: zlib.decompress(row["block"]) for row in parts.select("at", "block").collect()}


def _block_rows(at: np.ndarray, blocks) -> pa.RecordBatch:
    data = [zlib.compress(np.ascontiguousarray(blocks[i]).tobytes(), 1) for i in at]
    task = pa.array(np.full(len(at), task_number(), np.int32))
    columns = [pa.array(at.astype(np.int32)), task, pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["at", "task", "block"])


BLOCKS = "at int, task int, block binary"


def bloom(df: DataFrame, key: str) -> Bloom:
    """The filter over the non-null values; tasks send compressed blocks of its bits."""
    n = df.select(key).count()
    log2 = min(BLOOM_MOST, max(18, (16 * n).bit_length()))

    def mark(batches):
        words = np.zeros(1 << (log2 - 6), np.uint64)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for slots in _bloom_slots(keys, log2):
                np.bitwise_or.at(words, slots >> 6, np.uint64(1) << (slots & 63).astype(np.uint64))
        blocks = words.reshape(-1, min(BLOOM_BLOCK, len(words)))
        yield _block_rows(np.flatnonzero(blocks.any(axis=1)), blocks)

    def unite(blocks) -> bytes:
        united = 0
        for block in blocks:
            united = np.frombuffer(block, np.uint64) | united
        return united.tobytes()

    words = np.zeros(1 << (log2 - 6), np.uint64)
    size = min(BLOOM_BLOCK, len(words))
    for at, block in fold_blocks(df.select(key).mapInArrow(mark, BLOCKS), unite).items():
        words[at * size : (at + 1) * size] = np.frombuffer(block, np.uint64)
    return Bloom(words)


def thin_out(df: DataFrame, key: str, marked: Bloom) -> DataFrame:
    """Rows whose key may be in the filter; rows with a null key go."""
    shared = df.sparkSession.sparkContext.broadcast(marked)

    def keep(batches):
        for batch in batches:
            keys = batch.column(key)
            found = shared.value.may_hold(keys.fill_null(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(found & keys.is_valid().to_numpy(zero_copy_only=False)))

    return arrow_pass(df, keep, df.schema)


FALSE_MOST = 1 << 20  # ids that a filter admits wrongly and that are broadcast, 8 MB


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows of ``docs`` (doc_id and more) that have a label, with it; exact.

    ``labels`` has doc_id and a column of a few integer values. For each value a filter of
    bounded size goes to the scan, with the exact list of the ids of ``docs`` that it would
    admit wrongly, found by a join of the ids alone: so texts do not cross the network.
    Should that list exceed ``FALSE_MOST``, the filtered rows are joined instead. Null ids
    and labels take no part; an id with two labels gives a row for each.
    """
    labels = labels.select("doc_id", F.col(label).cast("long").alias(label)).na.drop().distinct()
    tests = []
    for row in labels.select(label).distinct().orderBy(label).collect():
        ids = labels.where(F.col(label) == row[0]).select("doc_id")
        marked = bloom(ids, "doc_id")
        admitted = thin_out(docs.select("doc_id"), "doc_id", marked)
        wrong = admitted.join(ids, "doc_id", "left_anti").distinct().limit(FALSE_MOST + 1).toArrow()
        if wrong.num_rows > FALSE_MOST:
            return thin_out(docs, "doc_id", bloom(labels, "doc_id")).join(labels, "doc_id")
        tests.append((row[0], marked, np.sort(wrong.column(0).to_numpy())))
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def keep(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            for value, marked, wrong in shared.value:
                found = marked.may_hold(keys) & valid
                found &= ~np.isin(keys, wrong)
                rows = batch.filter(pa.array(found))
                column = pa.array(np.full(rows.num_rows, value, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, column], [*rows.schema.names, label]
                )

    return arrow_pass(docs, keep, docs.withColumn(label, F.lit(0).cast("long")).schema)


# Sums over a large fixed range of counters, kept as blocks.
COUNTER_BLOCK = 1 << 12


def counter_rows(counts: np.ndarray) -> pa.RecordBatch:
    """Non-empty blocks of an int64 (kinds, size) array as compressed rows (``BLOCKS``)."""
    kinds, size = counts.shape
    blocks = counts.reshape(kinds, size // COUNTER_BLOCK, COUNTER_BLOCK).transpose(1, 0, 2)
    return _block_rows(np.flatnonzero(blocks.any(axis=(1, 2))), blocks)


def sum_counters(rows: DataFrame, kinds: int, size: int) -> np.ndarray:
    """The summed array; ``kinds * size`` is fixed by the caller, so its size is bounded."""

    def add(blocks) -> bytes:
        total = np.zeros(kinds * COUNTER_BLOCK, dtype=np.int64)
        for block in blocks:
            total += np.frombuffer(block, dtype=np.int64)
        return total.tobytes()

    out = np.zeros((kinds, size), dtype=np.int64)
    for at, block in fold_blocks(rows, add).items():
        lo = at * COUNTER_BLOCK
        out[:, lo : lo + COUNTER_BLOCK] = np.frombuffer(block, dtype=np.int64).reshape(kinds, COUNTER_BLOCK)
    return out


__all__ = [
    "BLOCKS",
    "Bloom",
    "arrow_pass",
    "bloom",
    "counter_rows",
    "hash_share",
    "in_fold",
    "labelled",
    "materialise",
    "read",
    "small_batches",
    "spare",
    "sum_counters",
    "task_number",
    "texts",
    "thin_out",
    "utf8",
]
