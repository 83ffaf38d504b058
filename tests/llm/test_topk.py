from __future__ import annotations

import math
import random

import pytest
from llm_rows import rows_of
from pyspark.sql import functions as F

from panelcast.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k, every):
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA)


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("tiles", [(8192, 2048), (7, 3)])
def test_equals_brute_force(spark, tiles):
    rng = random.Random(4)
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(10)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies: ties
    rows += [(i, [f32(rng.choice([-1, 0, 1])) for _ in range(10)]) for i in range(300, 360)]
    got = top_k(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, 5,
                rows_per_tile=tiles[0], queries_per_tile=tiles[1])
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 5, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (None, [9.0]),
        (10, [-1.0, 0.5]),
    ]
    got = top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 5, 10)
    assert top_k(frame(spark, []), F.col("vec_id") % 10 == 0, 5).count() == 0
    assert top_k(frame(spark, rows[:1]), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [f32(2.0**22 + 2.0**8 * i), 1.0, f32(-(2.0**18) * i)]) for i in range(0, 12)]
    rows += [(20, [2.0**22, 0.0, 0.0]), (21, [2.0**23, 0.0])]  # the inner product is 2^61
    got = rows_of(top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 3), "query_id", "rank", "vec_id", "score")
    assert got == brute(rows, 3, 10)
    assert (20, 1, 21, 1 << 61) in got


def test_too_large_components_fail(spark):
    rows = [(i, [2.0**23, 2.0**23]) for i in range(0, 12)]
    with pytest.raises(Exception, match="64 bits"):
        top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 3).collect()
