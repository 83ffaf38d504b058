from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401
from pyspark.sql import functions as F

from panelcast.llm import quality as q

PAD = b"\0" * (q.ORDER - 1)


class Brute:
    """The textbook recursion over plain dictionaries."""

    def __init__(self, texts):
        self.counts = {q.ORDER: Counter()}
        for t in texts:
            data = PAD + t
            self.counts[q.ORDER].update(data[i : i + q.ORDER] for i in range(len(t)))
        for k in range(q.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.held, self.total, self.d = {}, {}, {}
        for k, c in self.counts.items():
            n = [sum(1 for v in c.values() if v == i) for i in range(5)]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
                d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(raw, 1)]
            else:
                d = [0.5, 0.75, 0.9]
            self.d[k] = d
            self.held[k], self.total[k] = defaultdict(float), defaultdict(int)
            for g, v in c.items():
                self.held[k][g[:-1]] += d[min(v, 3) - 1]
                self.total[k][g[:-1]] += v

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        below = self.p(gram[1:])
        context = gram[:-1]
        if not self.total[k].get(context):
            return below
        v = self.counts[k].get(gram, 0)
        less = self.d[k][min(v, 3) - 1] if v else 0
        return (v - less + self.held[k][context] * below) / self.total[k][context]

    def log_ppl(self, t):
        data = PAD + t
        return -sum(math.log(self.p(data[i : i + q.ORDER])) for i in range(len(t))) / len(t)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    syllables = "ka to mi ré lo sa nu ve".split()

    def good():
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(2, 60)))

    rows = [(i, good(), "xx" if i % 2 else "yy", 1) for i in range(200)]
    rows += [(300 + i, good().upper().replace(" ", "## "), "xx", 0) for i in range(40)]
    rows += [(400 + i, good(), None if i % 2 else "zz", 0) for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_equals_the_recursion(spark, corpus):
    trusted = corpus.where("quality = 1")
    brute = Brute([r.text.encode() for r in trusted.collect()])
    expected = {r.doc_id: brute.log_ppl(r.text.encode()) for r in corpus.collect()}
    model = q.train(trusted.repartition(3))
    # with all entries at once, and in shards
    for entries in (1 << 20, 300):
        got = q.log_perplexity(corpus, model, entries).collect()
        assert len(got) == len(expected)
        assert all(math.isclose(r.log_ppl, expected[r.doc_id], rel_tol=1e-5) for r in got)
    assert len(q.shards(model, 300)) > 1


def test_every_context_sums_to_one(corpus):
    model = q.train(corpus.where("quality = 1"))
    shard = q._load(model, list(range(256)))
    import numpy as np

    for context in (b"kato", b"\0\0\0\0", b"zzzz", b" ka\xc3"):
        base = int.from_bytes(context, "big") << 8
        assert math.isclose(np.exp(shard.log_p(base + np.arange(256))).sum(), 1, rel_tol=1e-4)


def test_keeps_clean_rejects_junk(corpus):
    out = q.quality(corpus, corpus.where("quality = 1")).join(corpus.select("doc_id", "quality"), "doc_id")
    assert out.where("doc_id >= 300 AND doc_id < 400 AND keep").count() <= 2
    assert out.where("quality = 1 AND NOT keep").count() <= 2
    assert out.where("doc_id >= 400 AND NOT keep").count() <= 1  # other and no language: kept by the common limit


def test_odd_rows(odd_docs, no_docs, corpus):  # noqa: F811
    trusted = corpus.where("quality = 1")
    rows = q.quality(odd_docs, trusted).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.log_ppl is None) == (not r.keep and r.doc_id in (3, 4, None)) or r.log_ppl is not None for r in rows)
    assert q.quality(no_docs, trusted).count() == 0
    nothing = q.quality(odd_docs, trusted.where("false"))
    assert nothing.where("keep").count() == odd_docs.where("length(text) > 0").count()
    blank = trusted.select(F.lit(None).cast("string").alias("text"), "lang")
    assert q.quality(odd_docs, blank).count() == odd_docs.count()


def test_long_texts_in_strips(spark, corpus, monkeypatch):
    model = q.train(corpus.where("quality = 1"))
    whole = rows_of(q.log_perplexity(corpus, model), "doc_id", "log_ppl")
    shard = q._load(model, list(range(256)))
    monkeypatch.setattr(q, "STRIP_BYTES", 10)
    import pyarrow as pa

    texts = corpus.orderBy("doc_id").select("text").toArrow().column(0).combine_chunks()
    sums, sizes = q._log_sums(pa.array(texts.to_pylist()), shard)
    assert all(math.isclose(-s / n, e, rel_tol=1e-9) for s, n, (_, e) in zip(sums, sizes, whole, strict=True))


def test_limits_come_from_unseen_texts(spark, corpus):
    rng = random.Random(60)
    syllables = "ka to mi ré lo sa nu ve".split()
    strange = "zu xo wi qé ru gy".split()

    def text(of):
        return " ".join("".join(rng.choices(of, k=rng.randint(1, 3))) for _ in range(40))

    trusted = [(text(syllables), "xx") for _ in range(150)] + [(text(strange), "rare") for _ in range(8)]
    trusted += trusted[-1:] * 200  # copies do not make many texts
    model, limits = q.fit(spark.createDataFrame(trusted, "text string, lang string"))
    assert limits["rare"] >= limits[q.ANY]
    unseen = [(i, text(syllables), "xx") for i in range(150)] + [(200 + i, text(strange), "rare") for i in range(100)]
    docs = spark.createDataFrame(unseen, "doc_id long, text string, lang string")
    out = q.judged(docs, model, limits)
    assert out.where("lang = 'xx' AND NOT keep").count() <= 6
    assert out.where("lang = 'rare' AND NOT keep").count() <= 10
    junk = docs.where("lang = 'xx'").withColumn("text", F.expr("replace(upper(text), ' ', '## ')"))
    assert q.judged(junk, model, limits).where("keep").count() <= 2


def test_fold_models_are_those_of_the_other_texts(corpus):
    trusted = corpus.where("quality = 1").select("doc_id", "text", q._fold().alias("fold"))
    models = q.train(trusted, q.FOLDS)
    for fold in (q.ALL, *range(q.FOLDS)):
        others = trusted.where(F.col("fold") != fold)
        brute = Brute([r.text.encode() for r in others.collect()])
        for r in q.log_perplexity(trusted.limit(40), q.of_fold(models, fold)).collect():
            assert math.isclose(r.log_ppl, brute.log_ppl(r.text.encode()), rel_tol=1e-5)
