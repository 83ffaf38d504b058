from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401

from panelcast.llm import lexical
from panelcast.llm.lexical import Part, accumulate, search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    """Every score by its definition."""
    lists = [(i, words(t)) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n_docs, total = len(lists), sum(len(w) for _, w in lists)
    df = {}
    for _, w in lists:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None and words(t):
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in lists:
            m = 50 + 50 * len(w) * n_docs // total
            score = 0
            for t in terms & set(w):
                tf = w.count(t)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def frames(spark, docs, items):
    docs = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, term string, n int, score int")
    return docs, spark.createDataFrame([(*i, 7, "y") for i in items], "item_id long, text string, rank int, block string")


COLUMNS = ("item_id", "rank", "doc_id", "score")


def test_terms():
    text = "Ab-c9 ÄÖ x_\x7fz \U0001f44d\t" * 3
    assert terms_of(text.encode()) == {w.encode(): words(text).count(w) for w in words(text)}
    assert not terms_of(None) and not terms_of(b"") and not terms_of(b" .,\n")


def test_long_texts_in_strips(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["aa", "Bé", "c" * 50, "d."]) for _ in range(2000))
    whole = terms_of(text.encode())
    monkeypatch.setattr(lexical, "STRIP_BYTES", 7)
    assert terms_of(text.encode()) == whole == {w.encode(): words(text).count(w) for w in set(words(text))}


@pytest.mark.parametrize(("part", "block"), [(1 << 15, 1 << 18), (8, 20)])
def test_equals_brute_force(spark, monkeypatch, part, block):
    rng = random.Random(3)
    letters = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(letters, weights, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(400 + i, docs[0][1]) for i in range(80)]  # copies: ties beyond k
    docs += [(600, "word " * 5000 + "w3")]
    items = [(i, " ".join(rng.choices(letters, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(20, docs[0][1]), (21, "nowhere"), (3, "w59 w58")]
    monkeypatch.setattr(lexical, "PART_DOCS", part)
    got = search(*[f.repartition(3) for f in frames(spark, docs, items)], 10, block_terms=block)
    assert rows_of(got, *COLUMNS) == brute(docs, items, 10)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "seven été"), (1, "alpha"), (2, None), (3, ""), (None, "one"), (4, "ONE one 日本語"), (5, "..."), (6, "alpha " * 30000)]
    _, asked = frames(spark, [], items)
    assert rows_of(search(odd_docs, asked, 50), *COLUMNS) == brute(docs, items, 50)
    assert search(no_docs, asked, 50).count() == 0
    assert search(odd_docs, asked.where("false"), 50).count() == 0
    assert search(odd_docs, asked, 50).columns == list(COLUMNS)


def test_accumulators_are_limited():
    """Documents with a common term alone get no accumulator once the rare ones decide."""
    at = np.array([0, 1, 0, 1, 2, 3], np.int64)
    add = np.array([1000, 900, 5, 4, 9, 8], np.int64)
    part = Part(np.arange(4), at, add, np.array([0, 2, 6]), np.array([1000, 9]))
    scores, limit = accumulate(part, np.array([0, 1]), 2, 0)
    assert scores.tolist() == [1005, 904, 0, 0] and limit == 904
    scores, _ = accumulate(part, np.array([0, 1]), 3, 0)  # the third best needs them
    assert scores.tolist() == [1005, 904, 9, 8]
    scores, _ = accumulate(part, np.array([0, 1]), 3, 9)  # a tie may still win by its id
    assert scores.tolist() == [1005, 904, 9, 8]
    scores, _ = accumulate(part, np.array([0, 1]), 3, 10)
    assert scores.tolist() == [1005, 904, 0, 0]
