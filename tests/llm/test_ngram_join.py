from __future__ import annotations

import random

import numpy as np
import pytest
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401

from panelcast.llm import ngram_join
from panelcast.llm.components import components
from panelcast.llm.ngram_join import (
    Rule,
    document_links,
    gram_sets,
    linked_classes,
    one_of_each,
    similar_documents,
)


def grams(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, rule):
    sets = [grams(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            r = find(parent, i)
            least[r] = min(least.get(r, doc_id), doc_id)
    out = [
        (d, len(s), least.get(find(parent, i)) if s else d)
        for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))
    ]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


COLUMNS = ("doc_id", "n_shingles", "component_id")


def corpus(seed, families, size, edits, line=False):
    """Families of near copies, some with a common line, some texts of a few words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(400)]
    common = " ".join(rng.choices(vocabulary, k=25))
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 9, 12, 30, 80, 150]))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
                words = words or ["x"]
            text = " ".join(words)
            texts.append(text.upper() if rng.random() < 0.1 else text)
            if line and rng.random() < 0.5:
                texts[-1] += "\n" + common
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100), Rule(1, 51, 100)])
@pytest.mark.parametrize("tile", [(4096, 64), (8, 3)])
def test_equals_brute_force(spark, rule, tile, monkeypatch):
    rows = corpus(rule.words, 25, 14, 5, line=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "TILE", tile[0])
    monkeypatch.setattr(ngram_join, "SMALL_TILE", tile[1])
    assert rows_of(similar_documents(df, rule), *COLUMNS) == brute(rows, rule)


def brute_links(rows, rule):
    """Each row's class and number of links, and the links between classes."""
    sets = [grams(t, rule.words) for _, t in rows]
    members = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s:
            members.setdefault(s, []).append(d)
    near = {
        s: [o for o in members if o != s and rule.den * len(s & o) >= rule.num * len(s | o)] for s in members
    }
    least = {s: min((d for d in ids if d is not None), default=None) for s, ids in members.items()}
    out = [
        (d, len(s), least[s] if s else d, len(members[s]) - 1 + sum(len(members[o]) for o in near[s]) if s else 0)
        for (d, _), s in zip(rows, sets, strict=True)
    ]
    pairs = {tuple(sorted((least[s], least[o]))) for s in near for o in near[s] if None not in (least[s], least[o])}
    return sorted(out, key=lambda r: [(x is not None, x) for x in r]), sorted(pairs)


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100), Rule(2, 100, 100)])
@pytest.mark.parametrize("tile", [(4096, 64), (6, 3)])
def test_every_link_is_found(spark, rule, tile, monkeypatch):
    rows = corpus(rule.words + 20, 12, 20, 4, line=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "TILE", tile[0])
    monkeypatch.setattr(ngram_join, "SMALL_TILE", tile[1])
    documents, pairs = brute_links(rows, rule)
    assert rows_of(document_links(df, rule), "doc_id", "n_shingles", "class_id", "n_links") == documents
    assert rows_of(linked_classes(df, rule), "a", "b") == pairs


def test_bands_hold_every_pair_that_sizes_allow():
    import math

    for num, den in ((51, 100), (80, 100), (90, 100), (99, 100)):
        step = math.log(den / num) + 1e-6
        for a in [*range(1, 400), 12345, 10**6, 10**7 + 1]:
            most = a * den // num  # the largest set that a can link to
            assert math.floor(math.log(most) / step) - math.floor(math.log(a) / step) <= 1


def test_a_large_group_meets_only_neighbouring_bands(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 50)
    rule = Rule(3, 90, 100)
    rows = [(1, n, 1000 * n + i, 0, n) for n in range(10, 200, 10) for i in range(20)]
    df = spark.createDataFrame(rows, "gram long, n long, fp long, pos long, root long")
    dealt = ngram_join._banded(df, rule)
    tiles = dealt.groupBy("x", "y").agg({"n": "max"}).collect()
    assert dealt.count() < 4 * len(rows)  # each row is sent to a few tiles, not to all blocks
    ranges = dealt.selectExpr("x", "y", "n").groupBy("x", "y").agg({"n": "min"}).collect()
    low = {(r["x"], r["y"]): r["min(n)"] for r in ranges}
    assert all(r["max(n)"] <= 1.3 * low[r["x"], r["y"]] for r in tiles)


def test_one_large_family(spark):
    """Members that differ from each other by about as much as the rule allows."""
    rule = Rule(3, 90, 100)
    rows = corpus(11, 1, 250, 3) + [(10_000 + i, "w" + str(i) + " common words here") for i in range(40)]
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(150)]
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4])):
            words[at] = "z" + str(rng.randrange(10_000))
        rows.append((20_000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(similar_documents(df, rule), *COLUMNS) == brute(rows, rule)


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    rule = Rule(3, 90, 100)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(similar_documents(odd_docs, rule), *COLUMNS) == brute(rows, rule)
    assert similar_documents(no_docs, rule).count() == 0
    documents, pairs = brute_links(rows, rule)
    assert rows_of(document_links(odd_docs, rule), "doc_id", "n_shingles", "class_id", "n_links") == documents
    assert rows_of(linked_classes(odd_docs, rule), "a", "b") == pairs
    assert document_links(no_docs, rule).count() == 0 and linked_classes(no_docs, rule).count() == 0
    kept = one_of_each(odd_docs, rule)
    assert kept.columns == odd_docs.columns
    assert rows_of(kept.where("doc_id IS NOT NULL"), "doc_id") == [(1,), (3,), (4,), (5,), (6,), (7,)]
    assert kept.where("doc_id IS NULL").count() == 2
    with pytest.raises(ValueError):
        Rule(3, 1, 2)


def test_grams_do_not_depend_on_the_strip():
    texts = [b"a b c d e", b"", b" ", b"a b", b"b a", b"a\x0bb\x0cc", b"x " * 50]
    for k in (1, 2, 3, 5):
        owner, gram = gram_sets(texts, k)
        for i, t in enumerate(texts):
            alone = gram_sets([t], k)[1]
            assert np.array_equal(gram[owner == i], alone)
            assert len(alone) == len(grams(t.decode(), k))
    assert len({*gram_sets([b"a b"], 3)[1].tolist(), *gram_sets([b"b a"], 3)[1].tolist()}) == 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (None, 7)]
    parent = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {x: find(parent, x) for x in parent if x in got}
    assert all(x in got for a, b in edges if a is not None and a != b for x in (a, b))
    assert components(df.where("false"), "a", "b").count() == 0
