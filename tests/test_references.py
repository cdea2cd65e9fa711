import random
from datetime import datetime

from edgeloom.operators import references
from edgeloom.operators.references import bloom_blocks, orphan_references, probe

REF = "id int, k string, at timestamp_ntz, always int"
PAR = "k string, a timestamp_ntz, b timestamp_ntz, ever boolean, id int"


def day(n):
    return datetime(2025, 1, n)


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS k")
    bits, blocks = bloom_blocks(keys, "k")
    assert probe(keys, "k", bits, blocks).filter("NOT _may_exist").count() == 0
    assert probe(spark.range(5000).selectExpr("concat('x', id) AS k"), "k", bits, blocks).filter("_may_exist").count() < 100


def test_time_nulls_repeats_and_clashing_names(spark):
    refs = spark.createDataFrame([(1, "a", day(5), 0), (2, "a", day(1), 0), (3, "zz", day(5), 0), (4, None, day(5), 0), (5, "b", None, 0), (6, "c", day(9), 0), (6, "c", day(9), 0), (7, "e", None, 0), (8, "", day(5), 0)], REF)
    parents = spark.createDataFrame([("a", day(2), None, False, 1), ("a", day(2), None, False, 1), ("b", day(1), None, False, 2), ("c", day(1), day(9), False, 3), ("d", None, None, False, 4), ("e", None, None, True, 5), (None, day(1), None, False, 6)], PAR)
    out = orphan_references(refs, parents, "k", "at", "a", "b", "ever")
    assert sorted(r.id for r in out.collect()) == [2, 3, 5, 6, 6, 8]
    assert out.columns == refs.columns


def test_without_time(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    parents = spark.createDataFrame([("a", 1)], "k string, id int")
    assert [r.id for r in orphan_references(refs, parents, "k").collect()] == [2]


def test_empty_tables(spark):
    refs = spark.createDataFrame([(1, "a")], "id int, k string")
    none = spark.createDataFrame([], "k string")
    assert orphan_references(refs, none, "k").count() == 1
    assert orphan_references(refs.limit(0), none, "k").count() == 0


def test_hot_key(spark):
    refs = spark.range(20_000).selectExpr("CAST(id AS INT) AS id", "IF(id % 3 = 0, 'hot', concat('k', id)) AS k")
    parents = spark.createDataFrame([("hot",)], "k string")
    assert orphan_references(refs, parents, "k").count() == refs.filter("k <> 'hot'").count()


def test_many_versions_against_brute_force(spark):
    rng = random.Random(5)
    parents = [(f"k{rng.randrange(40)}", day(a := rng.randint(1, 25)) if rng.random() < 0.95 else None, day(max(1, a + rng.randint(-1, 5))) if rng.random() < 0.9 else None, rng.random() < 0.01, 0) for _ in range(250)]
    parents += [("hot", day(n), day(n + 1), False, 0) for n in range(1, 28, 2) for _ in range(30)]
    refs = [(i, rng.choice(["hot", f"k{rng.randrange(44)}"]), day(rng.randint(1, 30)), 0) for i in range(1500)]
    want = {i for i, k, t, _ in refs if not any(p == k and (ever or (a and a <= t and (b is None or b > t))) for p, a, b, ever, _ in parents)}
    out = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), "k", "at", "a", "b", "ever")
    assert sorted(r.id for r in out.collect()) == sorted(want) and 0 < len(want) < 1500


def test_a_filter_of_several_slices_has_the_same_plan(spark, monkeypatch):
    parents = spark.range(30_000).selectExpr("concat('k', id) AS k")
    refs = spark.range(3000).selectExpr("CAST(id AS INT) AS id", "concat('k', id * 20) AS k")
    rows, plans = [], []
    for size in (64 << 20, 3 * references.BLOCK_BYTES):
        monkeypatch.setattr(references.skew, "BROADCAST_BYTES", size)
        bits, blocks = bloom_blocks(parents, "k")
        plans.append(probe(refs, "k", bits, blocks)._jdf.queryExecution().executedPlan().toString())
        rows.append(sorted(r.id for r in orphan_references(refs, parents, "k").collect()))
    assert rows[0] == rows[1] == list(range(1500, 3000))
    assert [p.count("BroadcastHashJoin") for p in plans] == [1, 5] and not any("SortMergeJoin" in p or "Cartesian" in p for p in plans)
