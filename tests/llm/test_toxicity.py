from __future__ import annotations

import random

import numpy as np
import pytest
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401

from panelcast.llm import common, toxicity
from panelcast.llm.common import bloom, labelled
from panelcast.llm.toxicity import (
    FEATURES,
    ORDERS,
    PENALTY,
    SLOTS,
    SMOOTHING,
    _codes,
    _distinct,
    _logistic,
    _sets,
    _slots,
    fit,
    keep_clean,
    score,
)

BAD = ["grumpf", "zilch", "blarg"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    syllables = "ka to mi re lo sa nu ve hi pa ko lu".split()
    rows = []
    for i in range(600):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 7 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD).upper())
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(corpus):
    model = fit(corpus.where("doc_id % 5 <> 0"))
    found = score(corpus.where("doc_id % 5 = 0"), model).join(corpus.select("doc_id", "toxic"), "doc_id")
    wrong = found.where("predicted <> toxic").count()
    assert wrong <= 2 and found.count() == 120
    assert found.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    kept = keep_clean(corpus, model)
    assert kept.columns == corpus.columns and kept.where("toxic = 1").count() <= 2
    assert kept.where("toxic = 0").count() >= 510


def test_repeated_fit_is_the_same(corpus):
    one, two = fit(corpus), fit(corpus.repartition(5))
    assert np.array_equal(one.slots, two.slots)
    assert np.allclose(one.weights, two.weights) and np.isclose(one.intercept, two.intercept)


def test_slots_of_a_text_do_not_depend_on_its_neighbours():
    texts = [_codes(t) for t in (b"abc", b"", b"abcdefgh", b"x" * 50, "\u00c4\u044f\u65e5\U0001f44d".encode())]
    owners, slots = _distinct(*_slots(list(enumerate(texts))), 1 << 20)
    for i, t in enumerate(texts):
        alone = _distinct(*_slots([(0, t)]), 1 << 20)[1]
        assert set(slots[owners == i]) >= set(alone)
        assert len(set(slots[owners == i]) - set(alone)) <= len(ORDERS) * 4


def test_odd_rows(odd_docs, no_docs, corpus):  # noqa: F811
    model = fit(corpus)
    rows = score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert score(no_docs, model).count() == 0
    for frame in (corpus.where("toxic = 0"), corpus.where("false"), corpus.selectExpr("text", "null AS toxic")):
        one_sided = fit(frame)
        assert len(one_sided.slots) == 0
        assert score(odd_docs, one_sided).where("score IS NULL").count() == 0


def test_labelled_rows_are_found_exactly(spark, corpus, monkeypatch):
    rows = [(3, 1), (5, 0), (5, 0), (6, 1), (6, 0), (9999, 1), (None, 1), (7, None)]
    labels = spark.createDataFrame(rows, "doc_id long, good int")
    expected = [(3, 1), (5, 0), (6, 0), (6, 1)]
    assert rows_of(labelled(corpus, labels, "good"), "doc_id", "good") == expected
    # filters that admit everything, with and without room for the list of wrong ids
    monkeypatch.setattr(common.Bloom, "may_hold", lambda self, keys: np.ones(len(keys), bool))
    assert rows_of(labelled(corpus.limit(20), labels, "good"), "doc_id", "good") == expected
    monkeypatch.setattr(common, "FALSE_MOST", 3)
    assert rows_of(labelled(corpus, labels, "good"), "doc_id", "good") == expected


def test_filter(spark):
    marked = bloom(spark.range(0, 50_000).withColumnRenamed("id", "k"), "k")
    assert marked.may_hold(np.arange(50_000)).all()
    assert marked.may_hold(np.arange(100_000, 200_000)).mean() < 0.02


def test_copies_do_not_empty_the_sample(spark, corpus):
    toxic = [r.text for r in corpus.where("toxic = 1").limit(12).collect()]
    rows = [(t, 1) for t in toxic * 400]
    rows += [(r.text, 0) for r in corpus.where("toxic = 0").collect()] * 12
    labelled_rows = spark.createDataFrame(rows, "text string, toxic int")
    model = fit(labelled_rows, fit_rows=40)
    assert len(model.slots)
    found = score(spark.createDataFrame(list(enumerate(toxic)), "doc_id long, text string"), model)
    assert found.where("predicted = 1").count() == len(toxic)


def test_every_class_fills_its_sample(spark):
    rows = [(0, d) for d in range(-(1 << 63), 1 << 63, 1 << 50)] + [(1, 7), (1, -3)]
    digests = spark.createDataFrame(rows, "label int, digest long")
    last = toxicity._last_digests(digests, 30)
    assert last[1] == 7
    assert digests.where(f"label = 0 AND digest <= {last[0]}").count() == 30


def hashed(gram):
    """The slot of a tuple of code points, step by step."""
    mixed = gram[0]
    for c in gram[1:]:
        mixed = (mixed * 0x01000193 + c) % (1 << 32)
    return ((mixed ^ (len(gram) * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1 % (1 << 32)) >> 12


def plain_sets(text):
    """Slots of a text's character n-grams, with zeros before and after it."""
    padded = [0] * 4 + [ord(c) for c in (text or "").lower().replace("\u03c2", "\u03c3")] + [0] * 4
    ends = len(padded) - 4
    return {
        hashed(padded[i : i + n]) for n in ORDERS for i in range(ends) if i + n <= len(padded)
    }


TEXTS = ["", None, "a", "Stra\u00dfe \u00c4\u00d6\u00dc", "\u041f\u0420\u0418\u0412\u0415\u0422 \u043c\u0438\u0440", "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8", "\u039f\u0394\u039f\u03a3 \u03a3\u03a3", "\U0001f44d\U0001f3fd x", "z" * 40]


@pytest.mark.parametrize("strip", [1 << 18, 9])
def test_sets_are_those_of_the_characters(monkeypatch, strip):
    monkeypatch.setattr(toxicity, "STRIP_BYTES", strip)
    got = [set() for _ in TEXTS]
    last = -1
    for who, slots in _sets([None if t is None else t.encode() for t in TEXTS]):
        assert (np.diff(who) >= 0).all() and (not len(who) or who[0] > last)
        last = who[-1] if len(who) else last
        for i, slot in zip(who.tolist(), slots.tolist(), strict=True):
            assert slot not in got[i]
            got[i].add(slot)
    assert got == [plain_sets(t) for t in TEXTS]


def test_capital_letters_of_any_script_are_folded():
    for text in ("\u041f\u0420\u0418\u0412\u0415\u0422", "\u00c4\u00d6\u00dc\u00c9", "\u039b\u038c\u0393\u039f\u03a3"):
        assert (_codes(text.encode()) == _codes(text.lower().encode())).all()


def test_a_very_long_text_in_bounded_memory():
    import tracemalloc

    raw = ("grumpf \u043f\u0440\u0438\u0432\u0435\u0442 " * 1_000_000).encode()
    assert len(raw) >= 20_000_000
    tracemalloc.start()
    ((who, slots),) = list(_sets([raw]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and set(slots.tolist()) >= plain_sets("grumpf \u043f\u0440\u0438\u0432\u0435\u0442 ") & plain_sets("x grumpf \u043f\u0440\u0438\u0432\u0435\u0442 x")


def test_equals_a_plain_fit(spark, corpus):
    """Ratios, choice of features and weights by loops over sets and a direct solver."""
    rows = [(r.text, r.toxic) for r in corpus.where("doc_id < 150").collect()]
    df = spark.createDataFrame(rows, "text string, toxic int")
    model = fit(df.repartition(3))
    sets = [plain_sets(t) for t, _ in rows]
    have = np.zeros((2, SLOTS))
    for s, (_, label) in zip(sets, rows, strict=True):
        have[label, list(s)] += 1
    n = [sum(label == k for _, label in rows) for k in (0, 1)]
    ratio = np.log((have[1] + SMOOTHING) / (have[1] + SMOOTHING).sum()) - np.log((have[0] + SMOOTHING) / (have[0] + SMOOTHING).sum())
    pooled = have.sum(axis=0) / sum(n)
    z = np.abs(have[1] / n[1] - have[0] / n[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0] + 1 / n[1]))
    telling = set(np.flatnonzero(z > 0).tolist())
    assert len(telling) < FEATURES and telling <= set(model.slots.tolist())
    assert (have.sum(axis=0)[model.slots] > 0).all()

    # the penalised loss at the model's weights, and that no step along an axis lowers it
    x = np.zeros((len(rows), len(model.slots)))
    at = {slot: j for j, slot in enumerate(model.slots.tolist())}
    for i, s in enumerate(sets):
        for slot in s & at.keys():
            x[i, at[slot]] = ratio[slot]
    y = np.array([label for _, label in rows])
    w, b = model.weights / ratio[model.slots], model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = x.T @ (p - y) / len(y) + PENALTY * w
    start = x.T @ (0.5 - y) / len(y)
    assert np.abs(gradient).max() < 0.05 * np.abs(start).max()
    got = {r.doc_id: r.score for r in score(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - p[i]) < 1e-9 for i in range(len(rows)))


def test_blocks_are_united_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN", 3)
    keys = spark.range(0, 3000).withColumnRenamed("id", "k").repartition(40)
    marked = bloom(keys, "k")
    assert marked.may_hold(np.arange(3000)).all()
    assert (marked.words == bloom(keys.coalesce(1), "k").words).all()
    assert not bloom(keys.where("false"), "k").words.any()
