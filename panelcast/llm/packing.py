"""Best-fit packing of token sequences, in bulk-synchronous rounds over lengths."""

from __future__ import annotations

import bisect
import zlib
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.bpe import FAST_PATTERN, little_endian
from panelcast.llm.common import arrow_pass, materialise, task_number, texts

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long"
)


def _flat_coder(path: str):
    """Ids of a tokenizer file, as its library gives them: a special string is its own id.

    A byte-level BPE without normalizer encodes alike from its ranks, several times faster;
    ``tests/llm`` holds the two against each other. Other files use their own library.
    """
    import json

    with open(path, encoding="utf-8") as handle:
        spec = json.load(handle)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not model.get("ignore_merges")
        and _merges_follow_ids(model)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )
    if not plain:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    to_byte = _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {
        bytes(map(to_byte.__getitem__, token)): i
        for token, i in model["vocab"].items()
        if token not in special
    }
    coder = tiktoken.Encoding(
        "own", pat_str=FAST_PATTERN, mergeable_ranks=ranks, special_tokens=special
    )

    def encode(text: str) -> list[int]:
        if any(token in text for token in special):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode


def _merges_follow_ids(model: dict) -> bool:
    """Whether the merge order is the id order, so that ids serve as ranks."""
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [vocab["".join(pair)] for pair in pairs]
    return all(a < b for a, b in zip(made, made[1:], strict=False))


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_pieces(
    docs: DataFrame, path: str, capacity: int, end_id: int, *, id_col="doc_id", text_col="text"
) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens, written once.

    The first piece of a longer document takes the remainder. ``_task`` and ``_nth`` number
    the pieces of each length: within a task here, over all tasks in ``pack``.
    """

    def work(batches):
        encode, seen, task = _flat_coder(path), np.zeros(capacity + 1, np.int64), task_number()
        for batch in batches:
            rows = []
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, value in zip(ids_of, batch.column("text"), strict=True):
                ids = array("I", encode(value.as_py() or ""))
                ids.append(end_id)
                data, start = little_endian(ids), 0
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    size = end - start
                    rows.append(
                        (doc_id, piece, start, size, zlib.crc32(data[4 * start : 4 * end]), task, int(seen[size]))
                    )
                    seen[size] += 1
                    start = end
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"],
            )

    return materialise(arrow_pass(texts(docs, id_col, text_col), work, PIECES))


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the n-th piece of each length goes: best fit, longest pieces first.

    State is bounded by the capacity, not by the data: pieces and gaps are sorted into
    their lengths, and equal gaps are runs of numbered sequences. A round takes one length
    class. It sweeps the gap classes upwards from the first that is large enough (the
    successor); the pieces' numbers decide which piece gets which sequence of a run, then
    the run moves to its new gap and the round goes on until the class is placed.

    Rows are (length, from_nth, to_nth, first_sequence, per_sequence, offset).
    """
    plan = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    gaps: list[int] = []  # sorted keys of runs
    opened = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        nth, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = min(gap // length, left)
            used = min(n, left // per)
            plan.append((length, nth, nth + used * per, first, per, capacity - gap))
            free(gap - per * length, first, used)
            free(gap, first + used, n - used)
            nth, left = nth + used * per, left - used * per
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and gapless ``offset``.

    Numbers within a length: each task has numbered its own pieces, and the sums over the
    tasks before it (rows: tasks times lengths) are joined on (task, length), so equal
    lengths never meet in one task. The driver holds one count per length.
    """
    per_task = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = {
        row["length"]: row["_n"]
        for row in per_task.groupBy("length").agg(F.sum("_n").alias("_n")).collect()
    }
    plan = best_fit_rounds(counts, capacity)
    table = pieces.sparkSession.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 6))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = pieces.join(offsets.drop("_n"), ["_task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_nth") + F.col("_before")).alias("_nth")
    )

    def place(batches):
        rows = table.value
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        wide = int(rows[:, 2].max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("_nth").to_numpy()
            row = rows[np.searchsorted(keys, length * wide + nth, side="right") - 1]
            sequence = row[:, 3] + (nth - row[:, 1]) // row[:, 4]
            offset = row[:, 5] + (nth - row[:, 1]) % row[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return arrow_pass(numbered, place, schema)


def pack_documents(
    docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Tokenize, cut and pack every row; one row per piece.

    Null and empty texts are the end id alone. Only documents longer than ``capacity`` are
    cut. Repeated rows are packed each for itself; ties of length are ordered by position
    in the input. An empty table gives an empty result.
    """
    return pack(token_pieces(docs, path, capacity, end_id, id_col=id_col, text_col=text_col), capacity)
