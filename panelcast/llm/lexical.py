"""Ranked lexical search: accumulator-limited term-at-a-time over parts of the documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.ordering import running
from panelcast.llm.common import arrow_pass, materialise, task_number, texts, utf8

# Terms of items that are broadcast at a time; an item's terms stay together.
BLOCK_TERMS = 1 << 18
# A part of the documents that is searched at a time: so many, or with so many postings.
PART_DOCS = 1 << 15
PART_POSTINGS = 1 << 20
STRIP_BYTES = 1 << 20

# A term is a run of ASCII letters and digits and of all bytes of other characters.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(raw: bytes | None) -> Counter:
    """How often each term occurs in a whole UTF-8 text; long texts are split in strips."""
    counts: Counter = Counter()
    data, lo = (raw or b"").translate(_FOLD), 0
    while lo < len(data):
        hi = data.find(b" ", lo + STRIP_BYTES)
        hi = len(data) if hi < 0 else hi
        counts.update(data[lo:hi].split())
        lo = hi
    return counts


def item_terms(items: DataFrame, *, id_col="item_id", text_col="text") -> DataFrame:
    """(item_id, term): the different terms of each item; rows of one id are one item."""

    def work(batches):
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = [w.decode() for w in terms_of(raw)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(words), pa.int64()), pa.array(words, pa.string())],
                    ["item_id", "term"],
                )

    rows = texts(items, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return arrow_pass(rows, work, "item_id long, term string").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term, written once.

    ``n`` counts all its terms; the lists hold those of the vocabulary, by their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        number = shared.value.get
        for batch in batches:
            keep, n, ends, terms, tfs = [], [], [0], [], []
            for i, raw in enumerate(utf8(batch.column("text"))):
                counts = terms_of(raw)
                if not counts:
                    continue
                keep.append(i)
                n.append(counts.total())
                for word, tf in counts.items():
                    at = number(word)
                    if at is not None:
                        terms.append(at)
                        tfs.append(tf)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(keep, pa.int64())),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    schema = "doc_id long, n long, terms array<int>, tfs array<long>"
    return materialise(arrow_pass(docs, work, schema))


@dataclass(frozen=True)
class Block:
    """Items that are searched together: their terms, rarest first, and the terms' weights."""

    items: list[int]
    terms: list[np.ndarray]
    weights: np.ndarray
    docs: int  # documents with a term
    length: int  # all their terms, with repeats


@dataclass(frozen=True)
class Part:
    """The postings of some documents, by term."""

    ids: np.ndarray
    at: np.ndarray  # position of the document
    add: np.ndarray  # what the term adds to its score
    starts: np.ndarray  # of each term, and the end
    most: np.ndarray  # largest addition of each term

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.starts[term], self.starts[term + 1]
        return self.at[lo:hi], self.add[lo:hi]


def _parts(batches, block: Block) -> Iterator[Part]:
    held, docs, rows = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs += batch.num_rows
        rows += len(batch.column("terms").flatten())
        if docs >= PART_DOCS or rows >= PART_POSTINGS:
            yield _part(held, block)
            held, docs, rows = [], 0, 0
    if held:
        yield _part(held, block)


def _part(batches, block: Block) -> Part:
    table = pa.Table.from_batches(batches).combine_chunks()
    terms = table.column("terms").combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    term = terms.flatten().to_numpy()
    tf = table.column("tfs").combine_chunks().flatten().to_numpy()
    # Python's integers: the product of a length and the number of documents may be wide
    n = table.column("n").to_pylist()
    m = np.array([50 + 50 * x * block.docs // block.length for x in n], np.int64)
    at = np.repeat(np.arange(len(n)), sizes)
    add = block.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(block.weights) + 1))
    most = np.zeros(len(block.weights), np.int64)
    np.maximum.at(most, term, add)
    return Part(table.column("doc_id").to_numpy(), at[order], add[order], starts, most)


def accumulate(part: Part, terms: np.ndarray, k: int, limit: int) -> tuple[np.ndarray, int]:
    """Scores of a part's documents for one item, and what the k-th best has at least.

    ``terms`` are in the order of processing. A document has an accumulator once a term
    has added to its score. Before each term, the largest additions of all terms that are
    left bound the score of documents without one: below the k-th partial score, or below
    ``limit`` that k documents elsewhere have, none is created any more, and those that
    exist are updated to their exact score.
    """
    terms = terms[part.most[terms] > 0]
    left = np.cumsum(part.most[terms][::-1])[::-1]
    scores = np.zeros(len(part.ids), np.int64)
    creating, top = True, 0
    for term, reach in zip(terms.tolist(), left.tolist(), strict=True):
        # the k-th score is at most the best, so it is looked for only when that would do
        if creating and reach < top and len(scores) >= k:
            limit = max(limit, int(np.partition(scores, -k)[-k]))
        creating = creating and reach >= limit
        at, add = part.of(term)
        if not creating:
            live = scores[at] > 0
            at, add = at[live], add[live]
        new = scores[at] + add
        scores[at] = new
        top = max(top, int(new.max(initial=0)))
    if len(scores) >= k:
        limit = max(limit, int(np.partition(scores, -k)[-k]))
    return scores, limit


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(index: DataFrame, block: Block, k: int) -> DataFrame:
    """(item_id, doc_id, score, _task): the k best of each item within each task."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def work(batches):
        block = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in block.items]
        for part in _parts(batches, block):
            for i, terms in enumerate(block.terms):
                known = int(best[i][0][-1]) if len(best[i][0]) == k else 0
                scores, limit = accumulate(part, terms, k, known)
                at = np.flatnonzero(scores >= max(limit, 1))
                if len(at):
                    best[i] = _best(
                        np.concatenate([best[i][0], scores[at]]),
                        np.concatenate([best[i][1], part.ids[at]]),
                        k,
                    )
        sizes = [len(scores) for scores, _ in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(block.items, np.int64), sizes)),
                pa.array(np.concatenate([none, *(ids for _, ids in best)])),
                pa.array(np.concatenate([none, *(scores for scores, _ in best)])),
                pa.array(np.full(sum(sizes), task_number(), np.int32)),
            ],
            ["item_id", "doc_id", "score", "_task"],
        )

    rows = index.where("doc_id IS NOT NULL")
    return arrow_pass(rows, work, "item_id long, doc_id long, score long, _task int")


def _blocks(terms: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``terms`` with ``block``, and the number of blocks; an item is in one block."""
    counts = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    upto = running(counts, [F.col("item_id")], {"_upto": "_n"})
    block = F.floor((F.col("_upto") - F.col("_n")) / F.lit(size)).cast("int")
    out = materialise(terms.join(upto.select("item_id", block.alias("block")), "item_id"))
    last = out.agg(F.max("block")).first()[0]
    return out, 0 if last is None else last + 1


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int,
    *,
    id_col="doc_id",
    text_col="text",
    item_id_col="item_id",
    item_text_col="text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Equal scores are ranked by doc_id. Rows of one item id are one item; an item without
    id, text or terms has no rows. Each document row is a document of its own, also where
    an id repeats; one without id counts in the statistics and is not ranked; null, empty
    and termless texts count nowhere. Very long texts are read whole, in strips.

    Items are taken in blocks of a bounded number of terms. For a block, one pass over the
    texts writes each document's counts of the block's terms, much smaller than the
    texts; totals and document frequencies are aggregates of that table. In the second
    pass each task inverts the counts of some thousand documents at a time and runs every
    item over them, term at a time (``accumulate``), with the scores of the k best so far
    as a first limit. Tasks send at most k rows an item; these are folded in two rounds,
    so no group grows with the number of tasks alone.
    """
    docs = texts(docs, id_col, text_col)
    of_items, blocks = _blocks(item_terms(items, id_col=item_id_col, text_col=item_text_col), block_terms)
    found = None
    for number in range(blocks):
        rows = of_items.where(F.col("block") == number).select("item_id", "term").toArrow()
        part = _search_block(docs, rows, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


def _search_block(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    words = sorted(set(rows.column("term").to_pylist()))
    vocabulary = {word.encode(): i for i, word in enumerate(words)}
    index = postings(docs, vocabulary)
    total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(words), np.int64)
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[counted.column("term").to_numpy()] = counted.column("count").to_numpy()
    weights = np.array(
        [math.floor(1000 * math.log((2 * total[0] + 2) / (2 * int(n) + 1))) for n in df], np.int64
    )
    weights[df == 0] = 0
    by_item: dict[int, list[int]] = {}
    for item, word in zip(rows.column("item_id").to_pylist(), rows.column("term").to_pylist(), strict=True):
        by_item.setdefault(item, []).append(vocabulary[word.encode()])
    ordered = [np.array(sorted(terms, key=lambda t: (df[t], t)), np.int64) for terms in by_item.values()]
    block = Block(list(by_item), ordered, weights, total[0], total[1] or 1)

    local = materialise(_search(index, block, k))
    tasks = local.agg(F.max("_task")).first()[0] or 0
    salt = (F.col("_task") % math.isqrt(tasks + 1)).alias("_salt")
    best = [F.col("score").desc(), F.col("doc_id")]
    folded = (
        local.select("item_id", "doc_id", "score", salt)
        .withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*best)))
        .where(F.col("rank") <= k)
    )
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    return folded.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )
