"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_pass, materialise, spare, task_number, texts, utf8

BLOCK_BYTES = 4096
WINDOW_BYTES = 8 << 20
WHITE = b" \t\n\x0b\x0c\r"
TASK_SHIFT = 40  # names and row numbers: task number, then a counter within the task

REFS = [("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("blocks", pa.int32()),
        ("chars", pa.int64()), ("sha", pa.binary())]
SPARK_KIND = {"row": "long", "doc_id": "long", "pos": "int", "blocks": "int", "chars": "long", "sha": "binary"}


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows (held, block, who holds it), written: within a window of a task, equal blocks are one.

    So a text on a third of all rows crosses the network once a window, and ``held``
    numbers the rows of all tasks. White space is deleted first; a text without anything else is
    one empty block.
    """

    def work(batches):
        held: dict[bytes, list[tuple]] = {}
        size, counter, task = 0, 0, task_number() << TASK_SHIFT
        number = task

        def flush():
            nonlocal number
            for lo in range(0, len(held), 500):
                part = list(held.items())[lo : lo + 500]
                lists = []
                for i, (_, kind) in enumerate(REFS):
                    lists.append(pa.array([[r[i] for r in refs] for _, refs in part], pa.list_(kind)))
                numbers = pa.array(range(number, number + len(part)), pa.int64())
                number += len(part)
                yield pa.RecordBatch.from_arrays(
                    [numbers, pa.array([b for b, _ in part], pa.binary()), *lists],
                    ["held", "block", *(name for name, _ in REFS)],
                )

        for batch in batches:
            column = batch.column("text").fill_null("")
            chars = pc.utf8_length(column).to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for doc_id, n, raw in zip(ids, chars, utf8(column), strict=True):
                text = raw.translate(None, WHITE)
                sha = hashlib.sha256(text).digest()
                starts = range(0, max(1, len(text)), block_bytes)
                for pos, at in enumerate(starts):
                    block = text[at : at + block_bytes]
                    refs = held.get(block)
                    if refs is None:
                        refs = held[block] = []
                        size += len(block)
                    refs.append((task + counter, doc_id, pos, len(starts), n, sha if pos == 0 else None))
                    size += 60
                counter += 1
                if size > WINDOW_BYTES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    schema = "held long, block binary, " + ", ".join(f"{n} array<{SPARK_KIND[n]}>" for n, _ in REFS)
    return materialise(arrow_pass(docs, work, schema))


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """One row per (document, position) with the integer name of its block, written once.

    Blocks are dealt by content and sorted, so equal ones are neighbours; a name is the
    task's number with a counter that steps where the content changes. Contents are
    compared themselves, never their digests. Only one block is held at a time. What is dealt
    is a number and a content; who holds them is joined by that number, so the rows of a
    block that very many documents have stay spread over the tasks that found them.
    """

    def work(batches):
        last, name = None, (task_number() << TASK_SHIFT) - 1
        for batch in batches:
            names = np.empty(batch.num_rows, np.int64)
            for i, value in enumerate(batch.column("block")):
                block = value.as_py()
                if block != last:
                    last, name = block, name + 1
                names[i] = name
            yield pa.RecordBatch.from_arrays([batch.column("held"), pa.array(names)], ["held", "name"])

    dealt = blocks.select("held", "block").repartition("block").sortWithinPartitions("block")
    names = materialise(arrow_pass(dealt, work, "held long, name long"))
    refs = [n for n, _ in REFS]
    rows = blocks.select("held", F.arrays_zip(*refs).alias("refs")).join(names, "held")
    return materialise(rows.select(F.inline("refs"), "name"))


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, chars, sha, blocks, name): equal (blocks, name) means equal text.

    Round by round adjacent names are paired and each distinct pair gets a new name, until
    a document has one. Documents of as many blocks finish in the same round, so the
    number of blocks and the last name identify a text without any chance of collision.
    Distinct pairs are taken before names are given, so a repeated pair is sent once a task.
    """
    named = _named_blocks(_blocks(docs, block_bytes))
    done = named.where("blocks = 1").select("row", "doc_id", "chars", "sha", "blocks", "name")
    heads = named.where("blocks > 1 AND pos = 0").select("row", "doc_id", "chars", "sha", "blocks")
    level = named.where("blocks > 1").select("row", "pos", F.col("blocks").alias("left"), "name")
    most = named.agg(F.max("blocks")).first()[0] or 0
    finished = []
    while most > 1:
        odd = F.col("pos") % 2 == 1
        pairs = level.groupBy("row", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("r"),
            F.ceil(F.max("left") / 2).cast("int").alias("left"),
        )
        names = materialise(
            pairs.select("l", "r")
            .distinct()
            .sortWithinPartitions("l", "r")
            .withColumn("name", F.monotonically_increasing_id())
        )
        renamed = materialise(pairs.join(names, ["l", "r"]).select("row", "pos", "left", "name"))
        finished.append(renamed.where("left = 1").select("row", "name"))
        level = renamed.where("left > 1")
        most = -(-most // 2)
    for one in finished:
        done = done.unionByName(heads.join(one, "row"))
    return materialise(done)


def exact_copies(
    docs: DataFrame, *, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every row with its group of equal texts, white space ``[\\x20\\x09-\\x0D]`` aside.

    Columns doc_id, keep_id, group_size, kept, text_sha256, chars. The row with the most
    code points stays, then the smallest doc_id, then any one of repeated rows; rows
    without an id come last, and keep_id is null if only such rows are there. Null texts
    are empty ones. Groups are aggregated before they are joined back, so a group may
    hold any share of the rows.
    """
    named = name_documents(texts(docs, id_col, text_col), block_bytes)
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("m"), (-F.col("row")).alias("r")))
    groups = named.groupBy("blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"), best.alias("best")
    )
    return named.join(groups, ["blocks", "name"]).select(
        "doc_id",
        (-F.col("best.m")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.r")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "chars",
    )


def without_copies(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts.

    Rows are found again by id; where ids repeat, by id, text digest and length, and equal
    rows are merged. Rows without an id are kept as they are.
    """
    marks = materialise(exact_copies(docs, id_col=id_col, text_col=text_col))
    marks = marks.where("doc_id IS NOT NULL")
    repeats = marks.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeats:
        (gone,) = spare(docs, "_dropped")
        dropped = marks.where("NOT kept").select(F.col("doc_id").alias(gone))
        return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
    sha, chars, of_id, of_sha, of_chars = spare(docs, "_sha", "_chars", "_of_id", "_of_sha", "_of_chars")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns(
        {
            sha: F.sha2(F.translate(text, WHITE.decode(), ""), 256),
            chars: F.char_length(text).cast("long"),
        }
    )
    dropped = (
        marks.groupBy("doc_id", "text_sha256", "chars")
        .agg(F.max("kept").alias("kept"))
        .where("NOT kept")
        .select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_sha), F.col("chars").alias(of_chars))
    )
    on = (F.col(id_col) == F.col(of_id)) & (F.col(sha) == F.col(of_sha)) & (F.col(chars) == F.col(of_chars))
    left = keyed.join(dropped, on, "left_anti")
    unnamed = left.where(F.col(id_col).isNull())
    once = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, sha, chars])
    return once.unionByName(unnamed).drop(sha, chars)
