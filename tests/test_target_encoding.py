from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelcast.functions import ordering
from panelcast.operators import encoding
from panelcast.operators.encoding import NEW_ROWS, apply_target_encoding, target_encoding


def test_no_row_sees_its_own_fold(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcde"), i % 3, rng.gauss(0, 1)) for i in range(90)] + [(200, "f", 0, 5.0), (201, None, 1, 1.0), (202, "a", 1, None)]
    df = spark.createDataFrame(rows, "id int, part string, fold int, y double")
    table = target_encoding(df, "part", "y", F.col("fold"), prior=4.0)
    got = {r["id"]: r["e"] for r in apply_target_encoding(df, table, "part", "e", F.col("fold")).collect()}
    used = [r for r in rows if r[1] is not None and r[3] is not None]
    for i, part, fold, y in rows:
        others = [r[3] for r in used if r[2] != fold]
        own = [r[3] for r in used if r[2] != fold and r[1] == part]
        overall = sum(r[3] for r in used) / len(used)
        if part is None or y is None and not any(r[1] == part and r[2] == fold for r in used):
            assert got[i] == pytest.approx(overall)
        else:
            assert got[i] == pytest.approx((sum(own) + 4.0 * sum(others) / len(others)) / (len(own) + 4.0)), i
    assert len(got) == len(rows)


def test_new_rows_and_unknown_members(spark):
    train = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 8.0)], "part string, fold int, y double")
    table = target_encoding(train, "part", "y", F.col("fold"), prior=2.0)
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "part string")
    got = {r["part"]: r["e"] for r in apply_target_encoding(new, table, "part", "e").collect()}
    assert got == {"a": pytest.approx(12 / 4), "b": pytest.approx(16 / 3), "z": 4.0, None: 4.0}
    assert table.where(F.col("fold") == NEW_ROWS).count() == 3


def test_one_fold_alone_falls_back_to_all_rows(spark):
    train = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0)], "part string, fold int, y double")
    table = target_encoding(train, "part", "y", F.col("fold"), prior=2.0)
    got = apply_target_encoding(train, table, "part", "e", F.col("fold")).collect()
    assert {r["e"] for r in got} == {2.0}
    nothing = target_encoding(train.where("false"), "part", "y", F.col("fold"))
    assert nothing.count() == 0
    assert {r["e"] for r in apply_target_encoding(train, nothing, "part", "e").collect()} == {None}


def test_only_members_with_very_many_rows_are_sent_more_than_once(spark, monkeypatch):
    """Without broadcasts: the same values, and one entry per member and fold but for the split ones."""
    rows = [(i, "hot" if i % 2 else f"m{i % 40}", i % 3, float(i % 7)) for i in range(400)] + [(900 + i, None, 0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, part string, fold int, y double")
    table = target_encoding(df, "part", "y", F.col("fold"))
    want = {r["id"]: r["e"] for r in apply_target_encoding(df, table, "part", "e", F.col("fold")).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(encoding, "keys_to_split", lambda rows, key: ordering.keys_to_split(rows, key, least=100))
    sent = []
    explode = F.explode
    monkeypatch.setattr(ordering.F, "explode", lambda c: sent.append(c) or explode(c))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = apply_target_encoding(df, table, "part", "e", F.col("fold"))
        assert {r["id"]: r["e"] for r in joined.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    split = ordering.keys_to_split(df, "part", least=100)
    assert [r["part"] for r in split.collect()] == ["hot"]
    marked = table.where("part IS NOT NULL").join(split.withColumn("_split", F.lit(True)), "part", "left")
    copies = marked.select("part", explode(sent[0]).alias("salt")).groupBy("part").agg(F.countDistinct("salt").alias("n"))
    assert {r["part"]: r["n"] for r in copies.collect()} == {r["part"]: 8 if r["part"] == "hot" else 1 for r in copies.collect()}
    assert copies.count() == 21
