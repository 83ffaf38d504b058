from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from llm_rows import no_docs, odd_docs, rows_of  # noqa: F401

from panelcast.llm import exact_dedup
from panelcast.llm.exact_dedup import exact_copies, without_copies

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, doc_id, text or ""))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-len(m[2]), m[1] is None, m[1] or 0, m[0]))
        for i, doc_id, _ in members:
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((doc_id, best[1], len(members), i == best[0], digest))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(exact_copies(odd_docs), *COLUMNS) == brute(rows)
    assert exact_copies(no_docs).count() == 0


def test_many_blocks_and_tasks(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choices("ab é\n", k=n)) for n in (0, 1, 3, 4, 5, 8, 9, 17, 40, 41, 100, 333)]
    bases += [bases[-1][:-1] + "c", "c" + bases[-1][1:], bases[-1][:160] + "c" + bases[-1][161:]]
    rows = [(i, rng.choice(bases)) for i in range(400)]
    rows = [(i, t if rng.random() < 0.5 else t + " " * rng.randint(0, 3)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for block in (1, 4, 64):
        assert rows_of(exact_copies(df, block_bytes=block), *COLUMNS) == brute(rows)


def test_rows_that_stay(odd_docs, spark):  # noqa: F811
    kept = without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    # row 2 repeats row 1; 3, 4 and 6 are empty texts, of which 6 has most code points
    assert rows_of(kept, "doc_id") == [(None,), (None,), (1,), (5,), (6,), (7,)]
    plain = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert rows_of(without_copies(plain), "doc_id") == [(1,), (5,), (6,), (7,)]
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a ")], "doc_id long, text string")
    assert rows_of(without_copies(twice), "doc_id", "text") == [(1, "b"), (2, "a ")]


def test_a_block_on_most_rows_stays_spread(spark):
    """One text on most rows, over many tasks and windows: who has it is not gathered by content."""
    rng = random.Random(3)
    rows = [(i, "the same words again " * 3 if i % 3 else f"text {rng.random()}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert rows_of(exact_copies(df), *COLUMNS) == brute(rows)
    held = exact_dedup._blocks(df, 4096)
    hot = held.where("block = unhex(hex('thesamewordsagainthesamewordsagainthesamewordsagain'))")
    assert hot.count() == 16 and hot.selectExpr("sum(size(row)) AS n").first()["n"] == 2000
    assert held.select("held").distinct().count() == held.count()
