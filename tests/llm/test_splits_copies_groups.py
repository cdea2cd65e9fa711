import random

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import formatting_copies as C
from edgeloom.llm import grouped_splits as S
from edgeloom.llm import match_groups as M

EDGE = "edge_id bigint, node1 string, node2 string, node1_type string, node2_type string, relation string, database string, scope string, split int"
CATALOG = "relation string, database string, node1_type string, node2_type string, is_symmetric boolean, edge_id int"


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, "X", "Y", r, d, "clash", 1) for i, a, b, r, d in rows], EDGE)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("sym", "d", "G", "G", True, 1), ("dir", "d", "G", "G", False, 1), ("bi", "d", "G", "D", False, 1), ("bi", "e", "G", "D", None, 1), (None, "d", "G", "D", True, 1)], CATALOG)


def test_iterative_stratification_by_hand():
    demand = {"a": [7.0, 1.0, 2.0], "b": [1.4, 0.2, 0.4]}
    out = S.place([(f"k{i}", {"a": 1.0}) for i in range(10)] + [("x", {"b": 1.0}), ("y", {"b": 1.0})], demand)
    assert out["x"] == 0 and len(out) == 12
    assert [sum(v == s for k, v in out.items() if k[0] == "k") for s in range(3)] == [7, 1, 2]
    assert S.place([], {}) == {}


def test_one_split_a_source_and_exact_shares(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        node = "hub" if rng.random() < 0.34 else f"n{rng.randint(0, 700)}"
        rows.append((i, rng.choice([node, node.upper(), f" {node}-", f"[{node}]"]), "t", "r", rng.choice(["d1", "D1", "d2"])))
    rows += [(5000 + i, None if i % 2 else " ", "t", "r", None) for i in range(300)] + [(9000, "solo", "t", "s", "d"), (9001, "solo", "t", None, "d")]
    out = S.grouped_split(S.edge_records(edges(spark, rows)))
    got = out.toPandas()
    assert sorted(got["id"]) == sorted(r[0] for r in rows)
    assert got.groupby(["scope", "component"])["split"].nunique().max() == 1
    r = got[got.scope == "r"]["split"].value_counts(normalize=True)
    assert abs(r["train"] - 0.7) < 0.01 and abs(r["validation"] - 0.1) < 0.01 and abs(r["test"] - 0.2) < 0.01
    assert got[got.component == "n:hub"]["split"].nunique() == 1


def test_a_source_larger_than_its_split(spark):
    rows = [(i, "hub", "t", "r", "d") for i in range(90)] + [(100 + i, f"n{i}", "t", "r", "d") for i in range(10)]
    got = S.grouped_split(S.edge_records(edges(spark, rows))).toPandas()
    assert set(got[got.component == "n:hub"]["split"]) == {"train"} and len(got) == 100


def test_a_scope_without_a_heavy_source(spark):
    rows = [(i, f"n{i}", "t", "r", "d") for i in range(2001)] + [(5000 + i, "hub", "t", "s", "d") for i in range(10)]
    got = S.grouped_split(S.edge_records(edges(spark, rows))).toPandas()
    shares = got[got.scope == "r"]["split"].value_counts()
    assert len(got) == 2011 and got[got.scope == "s"]["split"].nunique() == 1
    assert abs(shares["train"] - 1400.7) < 2 and abs(shares["validation"] - 200.1) < 2 and abs(shares["test"] - 400.2) < 2


def test_no_edges_to_split(spark):
    assert S.grouped_split(S.edge_records(edges(spark, [(1, "a", "b", "r", "d")]).limit(0))).count() == 0


def test_copies(spark, catalog):
    rows = [
        (5, "A-1", "b", "sym", "db"), (2, "B", "a1", "sym", "D_B"), (9, "a1", "b", "dir", "db"), (8, "b", "a1", "dir", "db"), (7, "[A1]", "B", "dir", "db."), (7, "[A1]", "B", "dir", "db."),
        (3, "d", "g", "bi", None), (4, "g", "d", "bi", ""), (10, None, "g", "bi", "x"), (11, " ", "g", "bi", "x"), (12, "q", "r", None, "x"), (13, "q", "r", None, "x"), (14, "x", "y", "P-new-Q", "d"), (15, "y", "x", "P-new-Q", "d"), (16, "x", "y", "P-new-P", "d"), (17, "y", "x", "P-new-P", "d"),
    ]
    marked = C.edge_fingerprints(edges(spark, rows), catalog)
    assert sorted(map(tuple, C.copies(marked).collect())) == [(2, 5), (3, 4), (7, 9), (14, 15)]
    assert {r.keep_id: r.n_copies for r in C.collapsed_edges(edges(spark, rows), catalog).collect()} == {2: 2, 3: 2, 7: 3, 8: 1, 14: 2, 16: 1, 17: 1}
    assert C.copies(marked.limit(0)).count() == 0


def test_a_third_of_rows_is_one_edge(spark, catalog, monkeypatch):
    monkeypatch.setattr("edgeloom.llm.formatting_copies.join_hot", lambda a, b, k, s: __import__("edgeloom.plans.skew", fromlist=["x"]).join_hot(a, b, k, s, hot_rows=100))
    e = spark.range(3000).select(F.col("id").alias("edge_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("node1"), F.lit("t").alias("node2"), F.lit("dir").alias("relation"), F.lit("d").alias("database"))
    out = C.copies(C.edge_fingerprints(e, catalog))
    assert out.count() == 999 and out.select("keep_id").distinct().count() == 1


def test_colliding_hashes_are_told_apart(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "c")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    marked = C.fingerprints(df, "id", F.col("t")).withColumn("_h", F.unhex(F.lit("00")))
    assert sorted(map(tuple, C.copies(marked).collect())) == [(1, 3), (4, 5)]


def brute_groups(pairs):
    nbrs, out = {}, {}
    for a, b in pairs:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    for n in sorted(nbrs):
        todo = [n] if n not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += nbrs[x]
    return out


def test_groups_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    pairs = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(400)] + [("hub", f"s{i}") for i in range(300)] + [("loop", "loop"), ("b", "a"), ("a", "b"), ("a", "b")]
    pairs += [(f"r{rng.randint(0, 150)}", f"r{rng.randint(0, 150)}") for _ in range(120)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(*p, None) for p in pairs] + [(None, "x", 1), ("x", None, 1)], "p string, q string, node_id int")
    got = {r.node_id: r.group_id for r in M.match_groups(df, "p", "q").collect()}
    assert got == brute_groups(pairs)


def test_no_pairs(spark):
    assert M.match_groups(spark.createDataFrame([], "p string, q string"), "p", "q").count() == 0


def test_records_linked_over_several_keys(spark):
    rows = [(1, "ann", "s1"), (2, "ann", "s2"), (3, None, "s2"), (4, "bob", "s3"), (5, None, None), (6, "s3", None)]
    got = {r.id: r.component for r in S.linked_components(spark.createDataFrame(rows, "i bigint, author string, source string"), "i", ["author", "source"]).collect()}
    assert got["1"] == got["2"] == got["3"] and len({got[str(i)] for i in (1, 4, 5, 6)}) == 4
