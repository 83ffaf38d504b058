"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import (
    BLOCKS,
    arrow_pass,
    counter_rows,
    materialise,
    sum_counters,
    texts,
    utf8,
)

ORDERS = (3, 4, 5)
SLOTS = 1 << 20
FEATURES = 8192
# The weights are fitted on so many different labelled texts of each class, or all where it
# has fewer, drawn by a hash; the log-count ratios and the choice of features use all rows.
FIT_ROWS = 2000
SMOOTHING = 1.0
PENALTY = 1e-3
STEPS = 200
PAD = np.zeros(max(ORDERS) - 1, np.uint32)
STRIP_BYTES = 1 << 17


@dataclass(frozen=True)
class Model:
    """Slot of each feature, its scaled weight, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float


def _codes(raw: bytes) -> np.ndarray:
    """Code points of the lower-cased text, whatever comes before or after it."""
    text = raw.decode("utf-8", "replace").lower().replace("\u03c2", "\u03c3")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _strips(raw: bytes):
    """A long text's code points in strips, each begun with the last ones of the strip before.

    So every n-gram lies in a strip; those at the ends of the text have zeros around them.
    """
    before, lo = PAD, 0
    while lo < len(raw):
        hi = lo + STRIP_BYTES
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1  # not inside a character
        codes = np.concatenate([before, _codes(raw[lo:hi])])
        yield codes if hi < len(raw) else np.concatenate([codes, PAD])
        before, lo = codes[-len(PAD) :], hi


def _hashed(codes: np.ndarray):
    """Slots of all n-grams, an array for each order; n-gram j starts at code point j."""
    mixed = codes
    for n in range(2, max(ORDERS) + 1):
        mixed = mixed[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            yield (mixed ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(12)


def _slots(group) -> tuple[np.ndarray, np.ndarray]:
    """For every n-gram of (position, code points) pairs: the pair's number, and its slot.

    Each text follows enough zeros that no n-gram touches two texts.
    """
    codes = np.concatenate([part for _, text in group for part in (PAD, text)] + [PAD])
    owner = np.repeat(
        np.arange(len(group), dtype=np.int32), [len(PAD) + len(text) for _, text in group]
    )
    parts = [(owner[: len(slots)], slots[: len(owner)]) for slots in _hashed(codes)]
    return np.concatenate([o for o, _ in parts]), np.concatenate([s for _, s in parts])


def _distinct(owners: np.ndarray, keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    narrow = (int(owners[-1]) + 1) * wide <= 1 << 32 if len(owners) else True
    pairs = owners.astype(np.uint32 if narrow else np.int64)
    pairs *= pairs.dtype.type(wide)
    pairs += keys.astype(pairs.dtype)
    pairs.sort()
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    return pairs // wide, pairs % wide


def _sets(values, feature_of: np.ndarray | None = None):
    """(position of a text, its slot or feature), each pair once and positions ascending.

    Texts are hashed in groups of about a strip. A longer one is hashed strip by strip and
    leaves only its set, so memory follows the strip and not the text.
    """

    def found(slots: np.ndarray) -> np.ndarray:
        return slots if feature_of is None else feature_of[slots]

    def flush():
        owners, slots = _slots(group)
        what = found(slots)
        hit = what >= 0
        who, what = _distinct(owners[hit], what[hit], SLOTS)
        return np.array([i for i, _ in group])[who], what

    group, size = [], 0
    for i, raw in enumerate(values):
        raw = raw or b""
        if group and size + len(raw) + len(PAD) > STRIP_BYTES:
            yield flush()
            group, size = [], 0
        if len(raw) > STRIP_BYTES:
            seen = np.zeros(SLOTS, np.bool_)
            for codes in _strips(raw):
                for slots in _hashed(codes):
                    what = found(slots)
                    seen[what[what >= 0]] = True
            what = np.flatnonzero(seen)
            yield np.full(len(what), i), what
            continue
        group.append((i, _codes(raw)))
        size += len(raw) + len(PAD)
    if group:
        yield flush()


def fit(labelled: DataFrame, *, text_col="text", label_col="toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The model of labelled rows; rows with a null label take no part, null texts are empty.

    The rows are written first, so that what finds them runs once. One pass counts, for every hashed n-gram, the texts of each class that have it (a fixed
    number of counters, summed over tasks in compressed blocks). The n-grams that differ
    most between the classes become features. Weights are fitted to a bounded sample.
    With a class missing, every score is that of the other class.
    """
    rows = materialise(
        labelled.select(
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
            F.col(label_col).cast("int").alias("label"),
        ).where("label IN (0, 1)")
    )
    digests = materialise(rows.groupBy("label", F.xxhash64("text").alias("digest")).count())
    totals = {r[0]: r[1] for r in digests.groupBy("label").agg(F.sum("count")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    empty = Model(np.array([], np.int64), np.array([]), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n0 or not n1:
        return empty

    def count(batches):
        counts = np.zeros((2, SLOTS), np.int64)
        flat = counts.reshape(-1)
        for batch in batches:
            labels = batch.column("label").to_numpy().astype(np.int64)
            for who, slots in _sets(utf8(batch.column("text"))):
                of = labels[who]
                np.add.at(flat, of * SLOTS + slots, 1)
        yield counter_rows(counts)

    have = sum_counters(arrow_pass(rows, count, BLOCKS), 2, SLOTS)
    q, p = have + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    pooled = have.sum(axis=0) / (n0 + n1)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n0 + 1 / n1))
    score = np.abs(have[1] / n1 - have[0] / n0) / spread
    slots = np.argsort(-score, kind="stable")[:FEATURES]
    slots = np.sort(slots[have.sum(axis=0)[slots] > 0])
    feature_of = np.full(SLOTS, -1, np.int32)
    feature_of[slots] = np.arange(len(slots), dtype=np.int32)

    def sets(batches):
        for batch in batches:
            parts = [([], [])] + list(_sets(utf8(batch.column("text")), feature_of))
            who = np.concatenate([np.asarray(w, np.int64) for w, _ in parts])
            what = np.concatenate([np.asarray(x, np.int64) for _, x in parts])
            ends = np.searchsorted(who, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(what, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "features"])

    last = _last_digests(digests, fit_rows)
    limit = F.when(F.col("label") == 1, last[1]).otherwise(last[0])
    once = rows.where(F.xxhash64("text") <= limit).dropDuplicates(["label", "text"])
    sample = arrow_pass(once, sets, "label int, features array<int>").limit(4 * fit_rows).toArrow()
    labels = sample.column("label").to_numpy()
    lists = sample.column("features").combine_chunks()
    if not 0 < labels.sum() < len(labels):
        return empty
    weights, intercept = _logistic(labels, lists, ratio[slots])
    # the classes were drawn at different rates; the intercept follows the true ones
    drawn = labels.sum() / (len(labels) - labels.sum())
    return Model(slots, weights * ratio[slots], float(intercept + np.log(n1 / n0 / drawn)))


def _last_digests(digests: DataFrame, fit_rows: int) -> dict[int, int]:
    """For each class the largest digest of its ``fit_rows`` smallest ones, exactly.

    Only digests up to a bound that surely holds enough of them are sorted.
    """
    last = {}
    for label, n in digests.groupBy("label").count().collect():
        share = min(1.0, (8 * fit_rows + 100) / n)
        bound = int(share * ((1 << 64) - 1)) - (1 << 63) if share < 1 else (1 << 63) - 1
        few = digests.where((F.col("label") == label) & (F.col("digest") <= F.lit(bound)))
        last[label] = few.orderBy("digest").limit(fit_rows).agg(F.max("digest")).first()[0]
    return last


def _logistic(labels: np.ndarray, lists: pa.ListArray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on the scaled binary features, by accelerated descent."""
    what = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    who = np.repeat(np.arange(len(labels)), sizes)
    x = scale[what]
    w, v, b, vb = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    norm = np.bincount(who, weights=x * x, minlength=len(labels)).mean() + 1.0
    step = 1.0 / (0.25 * norm + PENALTY)
    for i in range(STEPS):
        momentum = i / (i + 3)
        at, at_b = w + momentum * v, b + momentum * vb
        z = np.bincount(who, weights=x * at[what], minlength=len(labels)) + at_b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.bincount(what, weights=x * error[who], minlength=len(scale)) / len(labels)
        new, new_b = at - step * (gradient + PENALTY * at), at_b - step * error.mean()
        w, v, b, vb = new, new - w, new_b, new_b - b
    return w, b


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.feature_of = np.full(SLOTS, -1, np.int32)
        self.feature_of[model.slots] = np.arange(len(model.slots), dtype=np.int32)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each whole text of a batch; null and empty texts have the intercept's."""
        z = np.full(len(column), self.model.intercept)
        if len(self.model.slots):
            for who, what in _sets(utf8(column), self.feature_of):
                z += np.bincount(who, weights=self.model.weights[what], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(df: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, predicted) of every row from its text alone; narrow, no shuffle.

    Repeated rows are scored each; null and empty texts have the score of a text without
    features; very long texts are hashed whole, in strips.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    schema = "doc_id long, score double, predicted int"
    return arrow_pass(texts(df, id_col, text_col), work, schema)


def keep_clean(df: DataFrame, model: Model, *, text_col="text") -> DataFrame:
    """``df`` with all its columns, without the rows predicted toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(text_col)) < 0.5))

    return arrow_pass(df, work, df.schema)
