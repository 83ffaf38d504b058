from __future__ import annotations

import base64
import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401

from panelcast.llm.bpe import ByteBpe, decode_ids, encode_texts, load, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "abcé日 '’sT 12½\n\t\u00a0\u2003\x1c.,!?👍🏽\u0301"


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_tree_equals_the_library(plain):
    rng = random.Random(1)
    samples = ["", " ", "a" * 500, " " * 333, "don't we'll " * 50, "x\n \ny" * 40]
    samples += ["".join(rng.choices(ALPHABET, k=rng.randint(1, 300))) for _ in range(400)]
    samples += [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(80)) for _ in range(50)]
    for leaf in (1, 2, 7, 40):
        coder = ByteBpe(PATH, leaf_chars=leaf)
        for text in samples:
            ids = coder.encode(text)
            assert ids.tolist() == plain.encode_ordinary(text), (leaf, text)
            assert coder.decode(ids) == text.encode()


def test_odd_rows(spark, odd_docs, no_docs, plain):
    got = rows_of(round_trip(odd_docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = []
    for row in odd_docs.collect():
        ids = plain.encode_ordinary(row.text or "")
        expected.append((
            row.doc_id,
            len(ids),
            hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
            hashlib.sha256((row.text or "").encode()).hexdigest(),
        ))
    assert got == sorted(expected, key=lambda r: [(x is not None, x) for x in r])
    assert round_trip(no_docs, PATH).count() == 0
    assert load(PATH) is load(PATH)


def test_encode_and_decode_are_inverse(odd_docs):
    back = decode_ids(encode_texts(odd_docs.where("doc_id is not null"), PATH), PATH)
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    assert all(bytes(r.content) == texts[r.doc_id] for r in back.collect())
