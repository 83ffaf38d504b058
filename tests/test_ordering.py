"""Global positions and running sums against a sorted list."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from panelcast.functions.ordering import position_within, running


def test_running_matches_a_sorted_list(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 50), rng.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, k int, n int")
    got = running(df, [F.desc("k"), F.col("id")], sums={"upto": "n"}).collect()
    total, want = 0, {}
    for pos, (i, k, n) in enumerate(sorted(data, key=lambda t: (-t[1], t[0])), start=1):
        total += n
        want[i] = (pos, total)
    assert {r["id"]: (r["position"], r["upto"]) for r in got} == want


def test_running_over_many_merged_ranges(spark):
    settings = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(20000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), "id")
        got = running(df, [F.col("k"), F.col("id")], sums={"upto": "id"}).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total = 0
    for pos, r in enumerate(sorted(got, key=lambda r: (r["k"], r["id"])), start=1):
        total += r["id"]
        assert (r["position"], r["upto"]) == (pos, total)


def test_running_of_nothing(spark):
    df = spark.createDataFrame([], "k int, n int")
    assert running(df, [F.col("k")], sums={"upto": "n"}).collect() == []


def test_position_within_a_hot_group(spark):
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 else f"g{i % 7}", rng.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, g string, v double")
    got = position_within(df, ["g"], [F.desc("v"), F.col("id")], position="rank").collect()
    groups: dict[str, list] = {}
    for i, g, v in data:
        groups.setdefault(g, []).append((-v, i))
    want = {
        i: pos for members in groups.values() for pos, (_, i) in enumerate(sorted(members), start=1)
    }
    assert {r["id"]: r["rank"] for r in got} == want
