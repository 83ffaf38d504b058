from __future__ import annotations

import array
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401
from tokenizers import Tokenizer

from panelcast.llm import token_store
from panelcast.llm.token_store import (
    PerfectHash,
    Shard,
    _coder,
    lookup,
    read_store,
    shard_content,
    write_store,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def brute(library, docs):
    """Rows in ascending order of ids, repeated ids as they come, and each row's ids."""
    out, start = [], 0
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = encoded(library, text)
        out.append((key, start, ids))
        start += len(ids)
    return out


def digest(rows):
    return [(k, s, len(ids), zlib.crc32(array.array("I", ids).tobytes())) for k, s, ids in rows]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.r_[rng.integers(-(2**63), 2**63 - 1, n // 2), np.arange(n - n // 2)])
    slots = PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert len(PerfectHash.build(keys).bits) * 64 < 8 * max(n, 100)


def test_shard_by_key():
    content = shard_content([None, 3, 5, 5, 9], [1, 2, 1, 3, 1], np.arange(8, dtype="<u4").tobytes())
    shard = Shard(content)
    got = {k: [(at, ids.tolist()) for at, ids in shard.documents(k)] for k in (3, 5, 9)}
    assert got == {3: [(1, [1, 2])], 5: [(3, [3]), (4, [4, 5, 6])], 9: [(7, [7])]}
    absent = np.setdiff1d(np.arange(-20000, 20000), [3, 5, 9])
    assert (shard.first(absent) >= 0).sum() <= 1  # a fingerprint of 32 bits
    assert not [k for k in range(-2000, 2000) if k not in got and list(shard.documents(k))]
    with pytest.raises(ValueError):
        Shard(content[:-4])
    with pytest.raises(ValueError):
        Shard(b"x" * len(content))


def test_words_encode_as_the_library(library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHED_WORDS", 50)
    monkeypatch.setattr(token_store, "STRIP_WORDS", 4)
    rng = random.Random(6)
    parts = ["Ab", " ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|endof",
             "text|>", "é", "é", "́", "日本", "👍🏽", "12", "'s", "'S", "İ", "Σ", "ς", "it's", "...", "​", "가",
             "  ", "ﬁ", "x" * 100]
    parts += ["word", "Word", "wörter", "Straße", "ſ", "ŉ", "DŽ", "İstanbul", "ªº", "ⅷ", "ʰ", "Ångström.", "ñandú,", "x²", "a.b", "end?!", "don't.", "ŷes"]
    encode = _coder.__wrapped__(PATH)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == encoded(library, text)[:-1], repr(text)


@pytest.mark.parametrize("tokens", [1 << 20, 40])
def test_round_trip_and_lookup(spark, library, tokens):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma.", "<|endoftext|>", "δέλτα", "x1"]
    docs = [(rng.randint(-500, 500) * 2, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for _ in range(200)]
    docs = list({k: (k, t) for k, t in docs}.values())
    docs += [(777, "the same words"), (777, "the same words")] * 30 + [(None, "no id"), (2001, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, part int, content string")
    store = write_store(df.repartition(5), PATH, 1, shard_tokens=tokens)
    want = brute(library, docs)
    assert rows_of(read_store(store), *COLUMNS) == sorted(digest(want), key=lambda r: [(x is not None, x) for x in r])

    asked = [777, docs[0][0], docs[5][0], docs[5][0], 2001, 1, -5001, 99999, None]
    keys = spark.createDataFrame([(k, 1) for k in asked], "doc_id long, part int")
    got = sorted((r["doc_id"], r["start"], r["ids"]) for r in lookup(store, keys).collect())
    assert got == sorted(r for r in want if r[0] is not None and r[0] in asked)
    assert lookup(store, keys.where("false")).count() == 0


def test_odd_rows(spark, library, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = rows_of(read_store(write_store(odd_docs, PATH, 1)), *COLUMNS)
    want = digest(brute(library, docs))
    assert [(k, n, c) for k, _, n, c in got if k is not None] == [(k, n, c) for k, _, n, c in want if k is not None]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    ends = sorted((s, s + n) for _, s, n, _ in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    empty = write_store(no_docs, PATH, 1)
    assert read_store(empty).count() == 0 and read_store(empty).columns == list(COLUMNS)
    assert lookup(empty, odd_docs).count() == 0
    only = write_store(odd_docs.where("doc_id IS NULL"), PATH, 1)
    assert rows_of(read_store(only), "doc_id", "start") == [(None, 0), (None, len(encoded(library, docs[5][1])))]
