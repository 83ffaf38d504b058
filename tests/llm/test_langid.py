from __future__ import annotations

import random

import pytest
import zstandard
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401

from panelcast.llm import langid
from panelcast.llm.langid import Languages, identify, learn

WORDS = {
    "xx": "ka tomi relo sanu vehi pako lumi".split(),
    "yy": "grbst plöm knirf tschab zwurx hrampf".split(),
}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, "xx" if i % 3 else "yy", rng.randint(3, 60)), "xx" if i % 3 else "yy") for i in range(300)]
    rows += [(1000 + i, rows[1][1], "xx") for i in range(150)]  # a third are copies
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(corpus):
    languages = learn(corpus.where("doc_id % 2 = 0"))
    assert set(languages.content) == {"xx", "yy"}
    assert all(len(c) <= 512 * (4 * 512 + 1) for c in languages.content.values())
    found = identify(corpus.where("doc_id % 2 = 1"), languages).join(corpus, "doc_id")
    assert found.where("lang_pred <> lang").count() == 0
    assert found.where("score < 0 OR score > 1").count() == 0
    # a fixed result whatever the partitions
    again = identify(corpus.repartition(5), learn(corpus.where("doc_id % 2 = 0").repartition(3)))
    columns = ("doc_id", "lang_pred", "score", "reliable")
    assert rows_of(again, *columns) == rows_of(identify(corpus, languages), *columns)


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    languages = learn(odd_docs)
    assert set(languages.content) == {"en", "fr", "de"}
    rows = identify(odd_docs, languages).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    for doc_id in (3, 4, 6):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score, by_id[doc_id].reliable) == ("und", 0.0, False)
    assert by_id[5].lang_pred == "en" and by_id[7].lang_pred == "fr"
    assert identify(no_docs, languages).count() == 0
    assert learn(no_docs) == Languages({})
    assert {r.lang_pred for r in identify(odd_docs, Languages({})).collect()} == {"und"}
    assert {r.lang_pred for r in identify(odd_docs, Languages({"q": b"abc"})).collect()} == {"und", "q"}


def test_copies_do_not_empty_a_dictionary(spark):
    rng = random.Random(80)
    few = [text(rng, "yy", 40) for _ in range(4)]
    many = [text(rng, "xx", 40) for _ in range(600)]
    rows = [(t, "yy") for t in few * 1000] + [(t, "xx") for t in many * 10]
    languages = learn(spark.createDataFrame(rows, "text string, lang string"), sample_texts=5)
    assert set(languages.content) == {"xx", "yy"}
    assert sorted(languages.content["yy"].decode().split("\n")) == sorted(t[:512] for t in few)
    parts = languages.content["xx"].decode().split("\n")
    assert len(set(parts)) == 5 and set(parts) <= {t[:512] for t in many}


def plain(text, languages):
    """Language and margin from the sizes of each block in each language's coding."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, sizes = text.encode(), []
    for name in sorted(languages.content):
        size = 0
        for lo in range(0, len(data), langid.BLOCK_BYTES):
            words = zstandard.ZstdCompressionDict(languages.content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(
                level=langid.LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            size += len(coder.compress(data[lo : lo + langid.BLOCK_BYTES]))
        sizes.append((size, name))
    (best, name), (second, _) = sorted(sizes)[:2]
    return name, (second - best) / second


def test_equals_a_plain_loop(spark, corpus):
    languages = learn(corpus.where("doc_id % 2 = 0"))
    rows = [(r.doc_id, r.text) for r in corpus.where("doc_id < 60").collect()]
    rows += [(900, None), (901, "12 34"), (902, rows[0][1] + " " + rows[1][1] * 80), (903, "x"), (904, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, languages).collect()}
    for doc_id, text_ in rows:
        name, margin = plain(text_, languages)
        assert got[doc_id][0] == name and got[doc_id][1] == pytest.approx(margin), doc_id


def test_many_languages_have_whole_excerpts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(text(rng, "xx", 30), f"l{i % 20}") for i in range(400)]
    monkeypatch.setattr(langid, "DICTIONARIES_BYTES", 20 * 3 * (4 * 100 + 1))
    languages = learn(spark.createDataFrame(rows, "text string, lang string"), excerpt_chars=100)
    assert len(languages.content) == 20
    whole = {t for t, _ in rows}
    for content in languages.content.values():
        parts = content.decode().split("\n")
        assert len(parts) == 3 and all(any(p in t for t in whole) for p in parts)
