import math
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import mapping as P
from edgeloom.operators import metrics as M
from edgeloom.operators import splits as S
from edgeloom.operators import stats as T
from edgeloom.operators import vectors as V

EDGE = "edge_id bigint, node1 string, node2 string, node1_type string, node2_type string, relation string, database string, d int"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(1, "A", "b-", "X", "Y", "r", "DB"), (2, "a ", "B", "X", None, "r", "d b"), (3, "B", "A", "Y", "X", "r", "db2"), (4, None, "B", "X", "Y", "r", "db"), (5, " ", "B", "X", "Y", "r", "db"), (6, "c", "c", "X", "X", "s", None), (7, "c", "a", "X", "X", None, "db")]
    return spark.createDataFrame([(*r, 0) for r in rows], EDGE)


def test_edge_table(raw):
    e = E.edge_table(raw)
    assert sorted(r.edge_id for r in e.collect()) == [1, 2, 3, 6, 7]
    assert {r.node1 for r in e.collect()} == {"a", "b", "c"}
    assert e.filter("node2_type = 'DESCONOCIDO'").count() == 1


def test_edge_aggregates_of_nulls_and_nothing(raw):
    e = E.edge_table(raw)
    assert {r.node: r.degree for r in E.degree_rows(e).collect()} == {"a": 4, "b": 3, "c": 3}
    assert {r.node: r.degree for r in E.degree_distinct(e).collect()} == {"a": 2, "b": 1, "c": 2}
    assert {r.relation: r.symmetry_pct for r in E.symmetry(e).collect()} == {"r": 100.0, "s": 100.0, None: 0.0}
    over = E.source_overlap(e).collect()
    assert [(r.database_a, r.database_b, r.n_a, r.n_b, r.n_shared) for r in over] == [("db", "db2", 1, 1, 1)]
    none = e.limit(0)
    for f in (E.summary, E.totals, E.node_universe, E.degree_rows, E.degree_distinct, E.duplicate_audit, E.symmetry, E.source_overlap):
        assert f(none).count() == 0
    assert {r.metric: r.value for r in E.graph_metrics(none).collect()}["total_edges"] == 0


def test_sets(spark, raw):
    e = E.edge_table(raw)
    held = spark.createDataFrame([("r", "b", "a")], "relation string, n1 string, n2 string")
    assert sorted(r.edge_id for r in E.exclude_pairs(e, held).collect()) == [6, 7]
    assert sorted(r.edge_id for r in E.drop_relations(e, ["s"]).collect()) == [1, 2, 3, 7]
    with pytest.raises(ValueError):
        E.drop_relations(e, ["nope"]).count()


def test_mappings(spark):
    m = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("l", None, 1), (None, "x", 1), ("l", "c", 3)], "key string, value string, ord int")
    assert {r.key: r.value for r in P.first_wins(m).collect()} == {"k": "a", "l": "c"}
    assert {r.key: r.value for r in P.last_wins(m).collect()} == {"k": "b", "l": "c"}
    pairs = spark.createDataFrame([("k", "l"), ("l", "k"), ("k", "k"), ("k", "?"), (None, "k")], "p string, q string")
    assert sorted(map(tuple, P.expand_pairs(pairs, "p", "q", m).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert P.unmapped(pairs, "p", m.dropna()).count() == 1
    c = spark.createDataFrame([("g", "p2", True, False), ("g", "p1", True, True), ("h", None, None, None), ("i", "q", False, None)], "key string, value string, reviewed boolean, has_vector boolean")
    assert {r.key: (r.value, r.state) for r in P.best_candidate(c).collect()} == {"g": ("p1", "reviewed_by_vector"), "h": (None, "none"), "i": ("q", "unreviewed")}


def test_metrics_by_hand(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (None, 0.4), (1, None)]
    s = spark.createDataFrame([("g", *r) for r in rows], "g string, label int, score double")
    r = M.ranking_report(s, ["g"]).first()
    assert (r.auroc, r.auprc, r.n_test) == (0.625, 0.583333, 4)
    assert M.f1_threshold(s, ["g"]).first().threshold == 0.5
    c = M.confusion(s, ["g"], 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision) == (2, 1, 0, 1, 0.666667)
    only = s.filter("label = 1")
    assert M.auroc(only, ["g"]).first().auroc is None
    assert M.ranking_report(s.limit(0), ["g"]).count() == 0


def test_metrics_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    s = spark.createDataFrame(rows, "label int, score double")
    r = M.ranking_report(s, []).first()
    pos, neg = [x for y, x in rows if y], [x for y, x in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({x for _, x in rows}, reverse=True):
        here = sum(x == t for x in pos)
        up = [y for y, x in rows if x >= t]
        ap += here / len(pos) * sum(up) / len(up)
        seen += here
    assert math.isclose(r.auroc, want, abs_tol=1e-6) and math.isclose(r.auprc, ap, abs_tol=1e-6)


def test_hits(spark):
    rows = [("q", True, 0.5), ("q", False, 0.9), ("q", False, 0.5), ("r", True, 0.1), ("z", False, 0.3)]
    r = M.hits_and_mrr(spark.createDataFrame(rows, "q string, is_true boolean, score double"), [], "q", 1).first()
    assert (r.hits_at_k, r.mrr, r.n_queries) == (0.5, 0.75, 2)


def test_components_against_search(spark):
    rng = random.Random(5)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{rng.randint(0, 40)}", f"m{rng.randint(0, 40)}") for _ in range(30)] + [("z", "z")]
    e = spark.createDataFrame([(a, b) for a, b in pairs], "node1 string, node2 string")
    got = {r.node: r.component for r in G.connected_components(E.closure(e)).collect()}
    seen = {}
    nbrs = {}
    for a, b in pairs:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    for n in sorted(nbrs):
        if n not in seen:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = n
                    todo += nbrs[x]
    assert got == seen


def test_neighbour_scores(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("h", "x")] + [("h", f"k{i}") for i in range(20)], "node1 string, node2 string")
    pairs = spark.createDataFrame([("a", "b", 1), ("h", "a", 0), ("a", "gone", 0), ("y", "k1", 0)], "n1 string, n2 string, label int")
    got = {(r.n1, r.n2): (r.preferential_attachment, r.common_neighbors, round(r.jaccard, 6)) for r in G.neighbour_scores(E.closure(e), pairs).collect()}
    assert got == {("a", "b"): (2.0, 1.0, 0.5), ("h", "a"): (21.0, 1.0, 0.047619), ("y", "k1"): (1.0, 0.0, 0.0)}


def test_walks_stay_on_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "node1 string, node2 string")
    adj = E.closure(e)
    links = {(r.node, r.nbr) for r in adj.collect()}
    for p, q in ((1.0, 1.0), (0.25, 4.0)):
        for r in G.random_walks(adj, adj, 6, 3, p, q).collect():
            assert len(r.path) == 6 and all(x in links for x in zip(r.path, r.path[1:]))


def test_splits_and_negatives(spark):
    pairs = spark.createDataFrame([(f"a{i % 20}", f"b{i}") for i in range(100)] + [("a0", "b1")], "n1 string, n2 string")
    e = pairs.select(F.col("n1").alias("node1"), F.col("n2").alias("node2"), F.lit("A").alias("node1_type"), F.lit("B").alias("node2_type"))
    e = e.union(e).union(spark.createDataFrame([("a0", "lone", "A", "B")], "node1 string, node2 string, node1_type string, node2_type string"))
    split = {r.split: r.n for r in S.split_edges(pairs, e).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split == {"train": 71, "val": 10, "test": 20}
    cold = S.cold_start(pairs, e)
    assert cold.groupBy("n1").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    nodes = lambda c: pairs.select(F.col(c).alias("node"))
    neg = S.negatives(nodes("n1"), nodes("n2"), pairs, 150)
    assert neg.count() == 150 and neg.select("n1", "n2").distinct().count() == 150
    assert neg.join(pairs, ["n1", "n2"]).count() == 0
    full = spark.createDataFrame([(a, b) for a in "xy" for b in "pq"], "n1 string, n2 string")
    assert S.negatives(full.select(F.col("n1").alias("node")), full.select(F.col("n2").alias("node")), full, 5).count() == 0


def test_rescue_takes_one_edge_a_node(spark):
    held = spark.createDataFrame([(0, "A", "B"), (1, "B", "C")], "ord int, n1 string, n2 string")
    none = spark.createDataFrame([], "n1 string, n2 string")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    assert sorted(map(tuple, S.rescue(held, none, nodes).collect())) == [(0, "A", "B"), (1, "B", "C")]
    assert S.rescue(held, held.select("n1", "n2"), nodes).count() == 0


def test_samples_nest(spark):
    rows = spark.range(500).selectExpr("id", "IF(id % 10 = 0, 'rare', 'often') AS s")
    small, large = (S.stratified_sample(rows, "s", ["id"], f) for f in (0.1, 0.3))
    assert {r.s: r.n for r in small.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"rare": 5, "often": 45}
    assert small.join(large, "id", "left_anti").count() == 0


def test_statistics(spark):
    m = spark.createDataFrame([("s1", "g", 1.0), ("s2", "g", 1.0), ("s1", "h", 0.0), ("s2", "h", 10.0), ("s1", "i", None), ("s2", "i", float("nan"))], "sample string, gene string, value double")
    assert {(r.sample, r.gene): r.value for r in T.robust_scaled(m).collect()} == {("s1", "g"): 0.0, ("s2", "g"): 0.0, ("s1", "h"): -1.0, ("s2", "h"): 1.0}
    q = {(r.sample, r.gene): r.value for r in T.quantile_normalised(m).collect()}
    assert q == {("s1", "h"): 0.5, ("s1", "g"): 5.5, ("s2", "g"): 0.5, ("s2", "h"): 5.5}
    g = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("b", 0.0), ("b", 5.0), ("c", float("nan"))], "k string, v double")
    assert {r.k: round(r.geomean, 9) for r in T.geometric_mean(g, ["k"], "v").collect()} == {"a": 4.0, "b": 0.0}
    t = spark.createDataFrame([("d", "a", 0.9), ("d", "b", 0.8), ("d", "c", 0.75), ("d", "e", 0.4)], "d string, g string, s double")
    assert T.top_with_override(t, "d", "g", "s", 0.7, 0.3, 2).count() == 3
    few = spark.createDataFrame([("a", 1), ("b", 100)], "k string, n int")
    assert T.zscore_outliers(few, "k", "n", 0.1).count() == 0


def test_space_comparison_of_equal_spaces(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    both = spark.createDataFrame([(n, v, v) for n, v in rows], "node string, va array<double>, vb array<double>")
    assert round(V.linear_cka(both), 6) == 1.0
    assert V.ridge_r2(both, alpha=1e-6)[0] > 0.999
    sims = V.sample_similarities(both)
    assert V.spearman(sims.filter("x < y"), "sa", "sb").first().spearman == 1.0
    assert V.neighbour_jaccard(sims, [5]).first().jaccard == 1.0
    assert V.linear_cka(both.limit(0)) is None


def test_negatives_of_a_dense_universe_end(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(4)], "node string")
    other = spark.createDataFrame([(f"m{i}",) for i in range(4)], "node string")
    one = spark.createDataFrame([("n0", "m0"), ("n0", "m0"), ("n9", "m1")], "n1 string, n2 string")
    all_free = [(r.n1, r.n2) for r in S.negatives(nodes, other, one, 40).orderBy("place").collect()]
    assert len(all_free) == len(set(all_free)) == 15 and ("n0", "m0") not in all_free
    assert [(r.n1, r.n2) for r in S.negatives(nodes, other, one, 9).orderBy("place").collect()] == all_free[:9]
    few = S.negatives(nodes, other, one, 7).collect()
    assert len({(r.n1, r.n2) for r in few}) == 7
    own = spark.createDataFrame([("n1", "n0"), ("n2", "n2")], "n1 string, n2 string")
    got = {(r.n1, r.n2) for r in S.negatives(nodes, nodes, own, 9, symmetric=True).collect()}
    assert got == {("n0", "n2"), ("n0", "n3"), ("n1", "n2"), ("n1", "n3"), ("n2", "n3")}
    assert len({(r.n1, r.n2) for r in S.negatives(nodes, nodes, own, 2, symmetric=True).collect()}) == 2


@pytest.mark.parametrize("last", [200_000, 40, 0])
def test_components_of_long_paths_and_hubs(spark, monkeypatch, last):
    monkeypatch.setattr(G, "LAST_LINKS", last)
    pairs = [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)] + [("hub", f"h{i}") for i in range(200)] + [("z", "z"), ("b", "a"), ("a", "b")]
    e = spark.createDataFrame(pairs, "node1 string, node2 string")
    got = {r.node: r.component for r in G.connected_components(E.closure(e)).collect()}
    assert {got[f"p{i:03}"] for i in range(151)} == {"p000"} and {got["hub"], *(got[f"h{i}"] for i in range(200))} == {"h0"}
    assert got["z"] == "z" and got["a"] == got["b"] == "a" and len(got) == 151 + 201 + 3
    assert G.connected_components(E.closure(e).limit(0)).count() == 0


def test_lists_of_a_hub_come_in_blocks(spark):
    e = spark.createDataFrame([("hub", f"n{i:02}") for i in range(25)] + [("hub", "hub")], "node1 string, node2 string")
    rows = {(r.node, r.block): r.nbrs for r in G.adjacency_lists(e, 10).collect()}
    assert [len(rows["hub", b]) for b in range(3)] == [10, 10, 5] and rows["hub", 2] == [f"n{i}" for i in range(20, 25)] and rows["n00", 0] == ["hub"]


def test_hits_among_scores_against_pairs(spark):
    rng = random.Random(3)
    rows = [("r", f"q{rng.randrange(4)}", int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(300)] + [("s", "q", 1, 0.5), ("s", "q", None, 0.9), ("t", "q", 0, 0.5)]
    got = {r.g: (r.hits_at_k, r.mrr, r.n_queries) for r in M.hits_among_scores(spark.createDataFrame(rows, "g string, q string, label int, score double"), ["g"], ["q"], 3).collect()}
    ranks = [1 + sum(b == q and l == 0 and s > x for _, b, l, s in rows[:300]) for _, q, k, x in rows[:300] if k == 1]
    assert got["r"] == (round(sum(r <= 3 for r in ranks) / len(ranks), 6), round(sum(1 / r for r in ranks) / len(ranks), 6), len(ranks))
    assert got["s"] == (1.0, 1.0, 1) and "t" not in got
