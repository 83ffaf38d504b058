from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_rows import no_docs, odd_docs  # noqa: F401

from panelcast.llm.packing import best_fit_rounds, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_rounds_equal_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, placed = defaultdict(list), defaultdict(int)
    for length, lo, hi, first, per, offset in best_fit_rounds(counts, capacity):
        assert lo == placed[length]
        placed[length] = hi
        for i in range(hi - lo):
            filled[first + i // per].append((offset + i % per * length, length))
    assert dict(placed) == counts
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(filled) == brute_best_fit(lengths, capacity)


def check(docs, rows, capacity):
    """Every document's ids are there once, in order, and every sequence is gapless."""
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for row in docs:
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        ends = range(first, len(ids) + 1, capacity)
        start = 0
        for piece, end in enumerate(ends):
            crc = zlib.crc32(array("I", ids[start:end]).tobytes())
            expected.append((row.doc_id, piece, start, end - start, crc))
            start = end
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_odd_rows(odd_docs, no_docs):
    rows = pack_documents(odd_docs, PATH, capacity=64).collect()
    n = check(odd_docs.collect(), rows, 64)
    assert n == brute_best_fit([r.length for r in rows], 64)
    assert pack_documents(no_docs, PATH).count() == 0


def test_many_tasks(spark):
    rng = random.Random(5)
    words = ["the", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endof", "naïve", "日本", "x1\n\n", "don't"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = pack_documents(df, PATH, capacity=50).collect()
    assert check(df.collect(), rows, 50) == brute_best_fit([r.length for r in rows], 50)
