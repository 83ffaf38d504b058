"""The whole pipeline on planted documents, against what each stage should do with them."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
from llm_rows import CLASHES, no_docs, odd_docs, rows_of  # noqa: F401
from test_ngram_join import brute as near_groups
from test_packing import brute_best_fit, check

import corpus_pipeline
from panelcast.functions.lineage import materialise
from panelcast.llm import quality
from panelcast.llm.ngram_join import Rule

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(12)
    syllables = "ka to mi re lo sa nu ve hi pa".split()

    def words(n):
        return ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]

    rows, labels, kind = [], [], {}

    def add(text, what, toxic=0, quality=1, labelled=True):
        doc_id = len(rows)
        rows.append((doc_id, text, "xx" if doc_id % 2 else "yy", "s", len(text or "")))
        kind[doc_id] = what
        if labelled:
            labels.append((doc_id, quality, toxic))

    clean = [" ".join(words(rng.randint(20, 120))) for _ in range(400)]
    for i, text in enumerate(clean):
        add(text, "clean", labelled=i % 2 == 0)
    for i in range(60):
        bad = words(rng.randint(20, 60))
        bad.insert(rng.randrange(len(bad)), rng.choice(["grumpf", "zilch"]))
        add(" ".join(bad), "toxic", toxic=1, labelled=i % 3 > 0)
    for i in range(40):
        add(" ".join(f"{w.upper()}##" for w in words(50)), "junk", quality=0, labelled=i % 2 == 0)
    for text in clean[:30]:
        add(text + rng.choice(["", " ", "\n"]), "copy", labelled=False)
    for text in clean[30:60]:
        add(text + " ve", "near", labelled=False)
    add(None, "empty", labelled=False)
    add("", "empty", labelled=False)
    return rows, labels, kind


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, _ = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_classifier", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"
    ]
    assert corpus_pipeline.NEAR == Rule(5, 80, 100)


def test_every_stage_on_planted_documents(spark, folder):
    rows, _, kind = planted()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder))
        assert docs.columns == columns
        kept.append({r[0] for r in rows_of(docs, "doc_id")})
        assert len(kept[-1]) == docs.count()
    tox, good, unique, apart = kept

    def gone(before, after, what):
        return [d for d in before - after if kind[d] == what]

    every = set(kind)
    assert len(gone(every, tox, "toxic")) >= 55 and not gone(every, tox, "clean")
    assert len(gone(tox, good, "junk")) >= 39 and len(gone(tox, good, "clean")) <= 4
    assert not [d for d in good if kind[d] == "empty"]

    text = {r[0]: r[1] for r in rows}
    groups = {}
    for d in sorted(good):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text[d]), []).append(d)
    assert unique == {min(g, key=lambda d: (-len(text[d]), d)) for g in groups.values()}

    near = near_groups([(d, text[d]) for d in sorted(unique)], corpus_pipeline.NEAR)
    assert apart == {component for _, _, component in near}

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    sequences = check(docs.collect(), packed, 1024)
    assert sequences == brute_best_fit([r.length for r in packed], 1024)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == apart


def test_empty_and_repeated_tables(spark, tmp_path):
    rows, labels, _ = planted()
    for name, docs in (("none", []), ("twice", rows[:40] * 2)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
        marks = labels if docs else []
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path)
        assert out.count() == out.select("doc_id", "piece").distinct().count()
        assert (out.count() > 0) == bool(docs)
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_columns_of_the_caller_stay(spark, odd_docs, folder):  # noqa: F811
    """Whatever the columns are called, a stage returns them as they came."""
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 2"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r["keep"] for r in rows} <= {"USER"}
        assert all(r[name] == name for r in rows for name in CLASHES)
    assert rows


def test_another_text_column(spark, folder):
    rows = [(1, "ka tomi relo", "not this"), (2, "", "ka tomi"), (3, None, "ka")]
    docs = spark.createDataFrame([(*r, "xx") for r in rows], "doc_id long, body string, text string, lang string")
    trusted = spark.createDataFrame([("ka tomi relo sanu", "xx")] * 3, "text string, lang string")
    kept = quality.keep_good(docs, *quality.fit(trusted), text_col="body")
    assert rows_of(kept, *docs.columns) == [(*rows[0], "xx")]
