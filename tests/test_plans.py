import pytest
from pyspark.sql import functions as F

from edgeloom.plans import durable, skew
from edgeloom.plans.ranking import dense_index, ranked, running_sums, top_within


def test_ranks_with_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 7 % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = {(r.g, r.h): r["rank"] for r in ranked(df, ["g"], ["h"]).collect()}
    by = {}
    for g, h in sorted(got):
        by.setdefault(g, []).append(h)
    assert got == {(g, h): i for g, hs in by.items() for i, h in enumerate(hs, 1)}


def test_null_group_and_empty(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert sorted((r.g or "", r.v, r["rank"]) for r in ranked(df, ["g"], ["v"]).collect()) == [("", 1, 1), ("", 2, 2), ("a", 5, 1)]
    assert ranked(df.limit(0), ["g"], ["v"]).count() == 0


def test_running_sums(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.lit(1).alias("x"))
    out = running_sums(df, ["g"], "o", {"s": "x"}).collect()
    assert all(r.s == r.o // 2 + 1 for r in out) and len(out) == 2000


def test_dense_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert {r.v: r.idx for r in dense_index(df, "v").collect()} == {"a": 0, "b": 1}


def test_top_within(spark):
    df = spark.createDataFrame([("g", 1), ("g", 3), ("g", 2)], "g string, v int")
    assert [r.v for r in top_within(df, ["g"], [F.desc("v")], 2).orderBy("rank").collect()] == [3, 2]


def test_join_of_hot_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    hot = skew.join_hot(rows, groups, ["k"], "n", hot_rows=100)
    assert sorted(map(tuple, hot.select("id", "first").collect())) == sorted(map(tuple, rows.join(groups, "k").select("id", "first").collect()))
    assert skew.hot_from(groups, ["k"], "n", 100) == (100, 1) and skew.hot_from(groups.limit(0), ["k"], "n", 100) == (100, 0)
    assert skew.join_hot(rows.limit(0), groups.limit(0), ["k"], "n").count() == 0


@pytest.mark.parametrize(("most", "size"), [(2, 64 << 20), (100_000, 3 * (skew.ROW_BYTES + 2))])
def test_more_hot_keys_than_may_be_broadcast(spark, monkeypatch, most, size):
    # The limit rises until the hot keys are few enough, and the hottest stays split.
    monkeypatch.setattr(skew, "MOST_HOT", most)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", size)
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 30).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    limit, hot = skew.hot_from(groups, ["k"], "n", 1)
    assert hot == 1 and limit > 50
    got = skew.join_hot(rows, groups, ["k"], "n", hot_rows=1)
    assert got.count() == 3000 and "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_cut_is_a_table_in_the_shared_folder(spark):
    cut = durable.materialise(spark.range(5))
    assert cut.count() == 5 and cut._edgeloom_path.startswith(durable.shared_dir(spark))
    durable.discard(cut)
    with pytest.raises(Exception):
        spark.read.parquet(cut._edgeloom_path).count()
