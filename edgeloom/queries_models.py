"""Queries on splits, features, metrics, classifiers, embeddings and their comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from edgeloom.functions.text import alnum_key
from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import metrics as M
from edgeloom.operators import models as L
from edgeloom.operators import splits as S
from edgeloom.operators import vectors as V
from edgeloom.plans.durable import materialise
from edgeloom.queries_edges import CLEAN, ENDS, alnum, edges
from edgeloom.queries_graph import AREAS, TASK, draw_sql, task_pairs, whole_adjacency
from edgeloom.session import table


def _edges(s, d):
    """The cleaned edges' ends, types and relations: what the splits read several times, written once without the other columns."""
    return materialise(edges(s, d).select("node1", "node2", "node1_type", "node2_type", "relation"), "edges")


def _split(s, d):
    e = _edges(s, d)
    return S.split_edges(task_pairs(e), e)


def _negatives(s, d):
    """Typed negatives, as many as the task's positives, dealt to the splits in the positives' numbers."""
    e = _edges(s, d)
    pairs = task_pairs(e)
    universe = lambda t: E.ends(e).filter(F.col("node_type") == t).select("node")
    return S.negatives(universe("GEN"), universe("DIS"), pairs, pairs.count())


def _train_graph(s, d):
    e = _edges(s, d)
    held = S.split_edges(task_pairs(e), e).filter("split <> 'train'").withColumn("relation", F.lit(TASK))
    return E.exclude_pairs(e, held).groupBy("relation").agg(F.count("*").alias("n_edges"))


def _strict_train_graph(s, d):
    """The graph for the split by node: without any edge of the task that a held-out node has; n_left counts what stayed, which must be none."""
    e = _edges(s, d)
    cold = materialise(S.cold_start(task_pairs(e), e), "cold")
    held = cold.filter("split <> 'train'")
    kept = E.exclude_pairs(e, held.withColumn("relation", F.lit(TASK)))
    nodes = held.select(F.col("n1").alias("node")).distinct().withColumn("held", F.lit(True))
    left = task_pairs(kept).join(nodes, F.col("n1") == F.col("node"), "left_semi").agg(F.count("*").alias("n_left"))
    return kept.agg(F.count("*").alias("n_edges")).crossJoin(left)


def _rescue(s, d):
    """Held-out pairs of the task that must return so that no node of the graph loses its last edge."""
    e = _edges(s, d)
    split = materialise(S.split_edges(task_pairs(e), e, 0.3, 0.4), "split")
    held = split.filter("split <> 'train'")
    train = E.exclude_pairs(e, held.withColumn("relation", F.lit(TASK))).select(F.col("node1").alias("n1"), F.col("node2").alias("n2"))
    ord_ = F.when(F.col("split") == "val", 0).otherwise(1).alias("ord")
    return S.rescue(held.select(ord_, "n1", "n2"), train, E.ends(e))


def _leaks(s, d):
    e = _edges(s, d)
    split = materialise(S.split_edges(task_pairs(e), e), "split")
    universe = lambda t: E.ends(e).filter(F.col("node_type") == t).select("node")
    n = split.groupBy("split").count().toPandas().set_index("split")["count"].to_dict()
    neg = S.negatives(universe("GEN"), universe("DIS"), task_pairs(e), sum(n.values()))
    val, test = n.get("val", 0), n.get("test", 0)
    dealt = neg.withColumn("split", F.when(F.col("place") <= val, "val").when(F.col("place") <= val + test, "test").otherwise("train"))
    return S.leak_checks(split, dealt)


def _stratified(s, d):
    share = F.when(F.col("relation") == "GEN-cex-GEN", 0.015).when(F.col("relation").isin("GEN-ass-DIS", "GEN-ppi-GEN"), 1.0).otherwise(0.25)
    return S.stratified_sample(edges(s, d).select("edge_id", "relation"), "relation", ["edge_id"], share)


def _nested(s, d):
    """By relation: edges in the 25, 50 and 75 % samples, and how many of each lie in the next (all of them)."""
    e = edges(s, d).select("edge_id", "relation")
    marked = None
    for p in (25, 50, 75):
        one = S.stratified_sample(e, "relation", ["edge_id"], p / 100).select("edge_id", F.lit(True).alias(f"in_{p}"))
        marked = e.join(one, "edge_id", "left") if marked is None else marked.join(one, "edge_id", "left")
    inside = lambda a, b: F.count_if(F.coalesce(F.col(a) & F.col(b), F.lit(False)))
    return marked.groupBy("relation").agg(F.count("in_25").alias("n_25"), F.count("in_50").alias("n_50"), F.count("in_75").alias("n_75"), inside("in_25", "in_50").alias("n_25_in_50"), inside("in_50", "in_75").alias("n_50_in_75"))


def labelled_pairs(s, d):
    """(pair_id, relation, split, label, n1, n2, source): distinct pairs of known runs."""
    runs = table(s, d, "seccion12_tabla_completa").select("run_id", "source").distinct()
    pairs = table(s, d, "eval_pairs").select("pair_id", "run_id", "relation", "split", "label", alnum_key("n1").alias("n1"), alnum_key("n2").alias("n2")).distinct()
    return pairs.join(runs, "run_id").drop("run_id")


def pair_vectors(s, d):
    """Labelled pairs with both ends' vectors of the run's source."""
    vectors = V.latest_vectors(table(s, d, "embedding_catalog").filter("seed IN (0, 42)"), alnum_key("node_id")).drop("seed")
    return V.pair_vectors(labelled_pairs(s, d), vectors, ["source"])


def scores(s, d):
    """(pair_id, relation, split, label, score): the cosine of the two ends."""
    return pair_vectors(s, d).select("pair_id", "relation", "split", "label", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("score"))


def _features(s, d):
    f = pair_vectors(s, d).select("pair_id", V.features(F.col("a"), F.col("b")).alias("f"), V.feature_sum(F.col("a"), F.col("b")).alias("t"))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double")), 3)
    return f.select("pair_id", F.size("f").alias("n_features"), total(F.col("f")).alias("feature_total"), total(F.col("t")).alias("sum_total"))


def _chosen_confusion(s, d):
    """Test rows judged at each relation's threshold of the highest F1 on val."""
    x = materialise(scores(s, d), "scores")
    t = M.f1_threshold(x.filter("split = 'val'"), ["relation"])
    return M.confusion(x.filter("split = 'test'").join(t, "relation"), ["relation"], "threshold")


def _hits(s, d):
    """Each positive test pair among the negative pairs of its relation that share its first node."""
    x = pair_vectors(s, d).filter("split = 'test'").select("relation", "label", "n1", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("score"))
    return M.hits_among_scores(x, ["relation"], ["n1"], 10)


#: Nodes at most that the comparisons of spaces take as queries, as the reference does.
SAMPLE = 1500


def _spaces(s, d):
    v = materialise(V.latest_vectors(table(s, d, "embedding_catalog").filter("node_type = 'GEN' AND seed = 42"), alnum_key("node_id")), "vectors")
    return v.filter("source = 'gae'"), v.filter("source = 'node2vec'")


def _sample(s, d):
    a, b = _spaces(s, d)
    return materialise(V.common_sample(a, b, SAMPLE), "sample")


def _neighbour_sims(s, d):
    """Similarities of the sample's nodes, as queries, to all common nodes."""
    a, b = _spaces(s, d)
    return V.sample_similarities(materialise(V.common_sample(a, b, SAMPLE), "sample"), materialise(V.common(a, b), "common"))


def _cka(s, d):
    a, b = _spaces(s, d)
    both = materialise(a.select("node", F.col("vec").alias("va")).join(b.select("node", F.col("vec").alias("vb")), "node"), "both")
    ridge = V.ridge_r2(both)
    r = [("linear_cka", V.linear_cka(both)), ("ridge_r2", ridge and ridge[0]), ("ridge_r2_std", ridge and ridge[1])]
    return s.createDataFrame([(n, None if x is None else round(x, 4)) for n, x in r], "measure string, value double")


#: Models that are fitted at the same time.
AT_ONCE = 4


def _classified(s, d, model, unit=None):
    """By relation and source: the model chosen on val over all labelled pairs, and its areas on test; nulls where train lacks a class.

    With ``unit``, which fits arrays, all units that a task holds are fitted by one job.
    """
    f = pair_vectors(s, d).filter("label IS NOT NULL").select("relation", "source", "pair_id", "split", "label", V.features(F.col("a"), F.col("b"), raw=True).alias("features"))
    every = materialise(f.withColumn("unit", F.xxhash64("relation", "source")), "features", "unit")
    kinds = F.countDistinct(F.when(F.col("split") == "train", F.col("label")))
    units = every.groupBy("unit", "relation", "source").agg(kinds.alias("kinds"), (F.count("*") * F.max(F.size("features"))).alias("n_values")).orderBy("relation", "source").collect()
    held = [i for i, g in enumerate(units) if unit and g.kinds == 2 and 0 < g.n_values <= L.VALUES_A_TASK]

    def fitted(i):
        g = units[i]
        if g.kinds != 2 or i in held:
            return None
        rows = every.filter((F.col("unit") == g.unit) & F.col("relation").eqNullSafe(g.relation) & F.col("source").eqNullSafe(g.source)).drop("unit", "relation", "source")
        return model(L.standardised(L.balanced_weights(rows)))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        models = list(pool.map(fitted, range(len(units))))
    tests = [m[0].filter("split = 'test'").select(F.lit(i).alias("i"), "label", "score") for i, m in enumerate(models) if m]
    if held:
        index = s.createDataFrame([(units[i].relation, units[i].source, k) for k, i in enumerate(held)], "_r string, _s string, i int")
        rows = every.join(F.broadcast(index), F.col("relation").eqNullSafe(F.col("_r")) & F.col("source").eqNullSafe(F.col("_s")))  # one row a relation and source
        done = L.units_in_tasks(rows, len(held), unit)
        for r in done.select("i", "choice", "val_auprc").distinct().collect():
            models[held[r.i]] = (done, r.choice, r.val_auprc)
        tests.append(done.filter("split = 'test'").select(F.array(*map(F.lit, held))[F.col("i")].alias("i"), "label", "score"))
    areas = {r.i: (r.auroc, r.auprc, r.n_test, r.n_pos_test) for r in M.ranking_report(E.union_all(tests), ["i"]).collect()} if tests else {}
    out = [(g.relation, g.source, *((None, None) if m is None else (str(m[1]), float(m[2]))), *areas.get(i, (None,) * 4)) for i, (g, m) in enumerate(zip(units, models))]
    return s.createDataFrame(out, "relation string, source string, choice string, val_auprc double, auroc double, auprc double, n_test bigint, n_pos_test bigint")


def _pca(s, d):
    a, _ = _spaces(s, d)
    return L.pca2(a).select("node", F.round(F.abs("pc1"), 4).alias("pc1"), F.round(F.abs("pc2"), 4).alias("pc2"))


#: Base relation and type of X of the metapaths X-hub-X.
METAPATHS = {"GEN-ass-DIS": "GEN", "GEN-ass-TIS": "GEN", "GEN-ass-PWY": "GEN", "CPD-int-GEN": "GEN", "CLL-mut-GEN": "GEN", "CPD-trt-DIS": "CPD"}


def metapath_pairs(e):
    """(a, b, relation, n): X nodes one hub apart in walks X-hub-X-hub-X-hub-X from every X of the six metapaths."""
    out = []
    for relation, x in METAPATHS.items():
        own = e.filter(F.col("relation") == relation)
        starts = E.ends(own).filter(F.col("node_type") == x).select("node")
        walks = G.random_walks(materialise(E.closure(own, self_loops=False), "adjacency"), starts, 7)
        xs = walks.select(F.filter("path", lambda n, i: i % 2 == 0).alias("path"))
        out.append(G.walk_pairs(xs).withColumn("relation", F.lit(relation)))
    return E.union_all(out)


def _hin(s, d):
    e = _edges(s, d)
    v = L.hin_vectors(metapath_pairs(e), E.ends(e.filter(F.col("relation").isin(*METAPATHS))))
    return v.select("node", F.size("vec").alias("dimension"), F.round(V.norm(F.col("vec")), 4).alias("norm"))


def _shape(v):
    return v.select("node", F.size("vec").alias("dimension"), F.round(V.norm(F.col("vec")), 4).alias("norm"))


QUERIES = {
    "split_edges": _split,
    "split_cold_start": lambda s, d: (lambda e: S.cold_start(task_pairs(e), e))(_edges(s, d)),
    "negatives": _negatives,
    "train_graph": _train_graph,
    "strict_train_graph": _strict_train_graph,
    "rescue": _rescue,
    "leak_checks": _leaks,
    "stratified_sample": _stratified,
    "nested_sample": _nested,
    "pair_scores": scores,
    "pair_features": _features,
    "auroc": lambda s, d: M.auroc(scores(s, d), ["relation", "split"]),
    "auprc": lambda s, d: M.average_precision(scores(s, d), ["relation", "split"]),
    "f1_threshold": lambda s, d: M.f1_threshold(scores(s, d).filter("split = 'val'"), ["relation"]),
    "confusion": _chosen_confusion,
    "pr_curve": lambda s, d: M.pr_curve(scores(s, d).filter("split = 'test'"), ["relation"]),
    "roc_curve": lambda s, d: M.roc_curve(scores(s, d).filter("split = 'test'"), ["relation"]),
    "precision_at_k": lambda s, d: M.precision_at(scores(s, d), ["relation", "split"], "pair_id"),
    "hits_mrr": _hits,
    "embedding_sanity": lambda s, d: V.sanity(table(s, d, "embedding_catalog"), ["embedding_source", "training_condition", "seed"]),
    "cosine_knn": lambda s, d: (lambda x: x.withColumn("r", F.row_number().over(_by_a())).filter("r <= 10").select("x", "y", "r", F.round("sa", 6).alias("sa")))(_neighbour_sims(s, d)),
    "knn_jaccard": lambda s, d: V.neighbour_jaccard(_neighbour_sims(s, d), [10, 25, 50]),
    "spearman_similarity": lambda s, d: V.spearman(materialise(V.sample_similarities(_sample(s, d)).filter("x < y"), "sims"), "sa", "sb"),
    "space_comparison": _cka,
    "logistic_link": lambda s, d: _classified(s, d, L.logistic, L.logistic_unit),
    "svm_link": lambda s, d: _classified(s, d, L.svm),
    "pca_2d": _pca,
    "node2vec": lambda s, d: _shape(L.node2vec(whole_adjacency(s, d), p=0.5, q=2.0)),
    "spectral": lambda s, d: _shape(L.spectral(whole_adjacency(s, d))),
    "hin_vectors": _hin,
}


def _by_a():
    from pyspark.sql import Window

    return Window.partitionBy("x").orderBy(F.desc("sa"), "y")


def _md5(*c):
    return "md5(concat_ws('|', '42', " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in c) + "))"


_TASK = ENDS + f""", rowdeg AS (SELECT node, count(*) AS d FROM n GROUP BY 1),
pairs AS (SELECT DISTINCT CASE WHEN starts_with(node1, 'ensg') THEN node1 ELSE node2 END AS n1, CASE WHEN starts_with(node1, 'ensg') THEN node2 ELSE node1 END AS n2 FROM e WHERE relation = '{TASK}'),
prot AS (SELECT n1, n2, a.d = 1 OR b.d = 1 AS protected FROM pairs JOIN rowdeg a ON a.node = n1 JOIN rowdeg b ON b.node = n2)"""


def _splits_sql(val: float, test: float) -> str:
    return _TASK + f""", o AS (SELECT *, row_number() OVER (PARTITION BY protected ORDER BY {_md5('n1', 'n2')}, n1, n2) AS r, count(*) OVER () AS total FROM prot),
sp AS MATERIALIZED (SELECT n1, n2, protected, CASE WHEN protected THEN 'train' WHEN r <= round_even(total * {val}, 0) THEN 'val' WHEN r <= round_even(total * {val}, 0) + round_even(total * {test}, 0) THEN 'test' ELSE 'train' END AS split FROM o)"""


_SPLIT = _splits_sql(0.1, 0.2)
_NEG = f""", ga AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node FROM n WHERE node_type = 'GEN')), gb AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node FROM n WHERE node_type = 'DIS')),
size AS (SELECT (SELECT count(*) FROM ga) AS na, (SELECT count(*) FROM gb) AS nb, (SELECT count(*) FROM pairs) AS need),
d AS (SELECT id, {draw_sql(42, 'na', "'a'", 'id')} AS ia, {draw_sql(42, 'nb', "'b'", 'id')} AS ib, need FROM (SELECT unnest(generate_series(0, greatest(2000, 3 * need) - 1)) AS id, na, nb, need FROM size)),
f AS (SELECT ga.node AS n1, gb.node AS n2, min(id) AS id, any_value(need) AS need FROM d JOIN ga ON ga.i = ia JOIN gb ON gb.i = ib WHERE ga.node <> gb.node AND (ga.node, gb.node) NOT IN (SELECT (n1, n2) FROM pairs) GROUP BY 1, 2),
neg AS (SELECT n1, n2, row_number() OVER (ORDER BY id) AS place, need FROM f QUALIFY row_number() OVER (ORDER BY id) <= need)"""
_STRATA = CLEAN + ", o AS (SELECT edge_id, relation, row_number() OVER (PARTITION BY relation ORDER BY " + _md5("edge_id") + ", edge_id) AS r, count(*) OVER (PARTITION BY relation) AS total FROM e)"
_SCORES = f"""vec AS (SELECT DISTINCT ON (embedding_source, node) embedding_source AS source, node, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT *, {alnum('node_id')} AS node FROM embedding_catalog)
  WHERE seed IN (0, 42) AND len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) ORDER BY embedding_source, node, exported_at DESC, vec_id),
lp AS (SELECT DISTINCT pair_id, relation, split, label, {alnum('n1')} AS n1, {alnum('n2')} AS n2, source FROM eval_pairs JOIN (SELECT DISTINCT run_id, source FROM seccion12_tabla_completa) USING (run_id)),
pv AS (SELECT lp.*, a.v AS a, b.v AS b FROM lp JOIN vec a ON a.source = lp.source AND a.node = n1 JOIN vec b ON b.source = lp.source AND b.node = n2),
l AS (SELECT pair_id, relation, split, label, n1, round(CASE WHEN list_inner_product(a, a) > 0 AND list_inner_product(b, b) > 0 THEN list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) ELSE 0 END, 6) AS score FROM pv)"""


def _areas(keep: str, group: str, where: str = "true") -> str:
    return f"WITH {_SCORES.replace('FROM pv)', f'FROM pv WHERE label IS NOT NULL AND {where})')}" + AREAS.format(g=group) + keep


_SIMS = f"""one AS (SELECT DISTINCT ON (embedding_source, node) embedding_source AS source, node, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT *, {alnum('node_id')} AS node FROM embedding_catalog)
  WHERE seed = 42 AND node_type = 'GEN' AND len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) ORDER BY embedding_source, node, exported_at DESC, vec_id),
b AS (SELECT node, g.v AS va, h.v AS vb FROM (SELECT node, v FROM one WHERE source = 'gae') g JOIN (SELECT node, v FROM one WHERE source = 'node2vec') h USING (node) ORDER BY {_md5('node')}, node LIMIT 200),
sims AS MATERIALIZED (SELECT x.node AS x, y.node AS y, round(list_cosine_similarity(x.va, y.va), 8) AS sa, round(list_cosine_similarity(x.vb, y.vb), 8) AS sb FROM b x JOIN b y ON x.node <> y.node)"""

_COLD = f"""WITH {_TASK}, o AS (SELECT n1, d = 1 AS single, row_number() OVER (PARTITION BY d = 1 ORDER BY {_md5('n1')}, n1) AS r, count(*) OVER () AS total FROM (SELECT DISTINCT n1 FROM pairs) JOIN rowdeg ON node = n1),
cold AS (SELECT n1, n2, CASE WHEN single THEN 'train' WHEN r <= round_even(total * 0.1, 0) THEN 'val' WHEN r <= round_even(total * 0.1, 0) + round_even(total * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM pairs JOIN o USING (n1))"""

ORACLE = {
    "strict_train_graph": _COLD + f""" SELECT count(*) AS n_edges, count(DISTINCT (least(node1, node2), greatest(node1, node2))) FILTER (relation = '{TASK}' AND (node1 IN (SELECT n1 FROM cold WHERE split <> 'train') OR node2 IN (SELECT n1 FROM cold WHERE split <> 'train'))) AS n_left FROM e WHERE NOT (relation = '{TASK}' AND EXISTS (SELECT 1 FROM cold WHERE split <> 'train' AND least(n1, n2) = least(node1, node2) AND greatest(n1, n2) = greatest(node1, node2)))""",
    "embedding_sanity": """WITH c AS (SELECT *, embedding IS NOT NULL AND len(embedding) = dimension AS sized, CAST(embedding AS DOUBLE[]) AS v FROM embedding_catalog), k AS (SELECT *, sized AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN v]) AS fin FROM c), m AS (SELECT *, CASE WHEN fin THEN sqrt(list_inner_product(v, v)) END AS n FROM k)
SELECT embedding_source, training_condition, seed, count(*) AS n, count(*) - count(DISTINCT node_id) AS n_repeated, count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (embedding IS NOT NULL AND NOT sized) AS n_missized, count(*) FILTER (sized AND NOT fin) AS n_nonfinite, count(*) FILTER (n = 0) AS n_zero, round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm, round(avg(n), 5) AS avg_norm FROM m GROUP BY 1, 2, 3""",
    "cosine_knn": f"WITH {_SIMS} SELECT x, y, CAST(r AS INTEGER) AS r, round(sa, 6) AS sa FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sa DESC, y) AS r FROM sims) WHERE r <= 10",
    "knn_jaccard": f"WITH {_SIMS}, o AS (SELECT x, row_number() OVER (PARTITION BY x ORDER BY sa DESC, y) AS ra, row_number() OVER (PARTITION BY x ORDER BY sb DESC, y) AS rb FROM sims), k AS (SELECT unnest([10, 25, 50]) AS k), j AS (SELECT k, x, count(*) FILTER (ra <= k AND rb <= k) / count(*) FILTER (ra <= k OR rb <= k) AS j FROM o, k GROUP BY 1, 2) SELECT CAST(k AS INTEGER) AS k, round(avg(j), 6) AS jaccard FROM j GROUP BY 1",
    "spearman_similarity": f"WITH {_SIMS}, h AS (SELECT * FROM sims WHERE x < y), r AS (SELECT rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2.0 AS a, rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2.0 AS b FROM h) SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r",
    "split_edges": f"WITH {_SPLIT} SELECT * FROM sp",
    "split_cold_start": f"""WITH {_TASK}, o AS (SELECT n1, d = 1 AS single, row_number() OVER (PARTITION BY d = 1 ORDER BY {_md5('n1')}, n1) AS r, count(*) OVER () AS total FROM (SELECT DISTINCT n1 FROM pairs) JOIN rowdeg ON node = n1)
SELECT n1, n2, CASE WHEN single THEN 'train' WHEN r <= round_even(total * 0.1, 0) THEN 'val' WHEN r <= round_even(total * 0.1, 0) + round_even(total * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM pairs JOIN o USING (n1)""",
    "negatives": f"WITH {_TASK}{_NEG} SELECT n1, n2, place FROM neg",
    "train_graph": f"""WITH {_SPLIT} SELECT relation, count(*) AS n_edges FROM e WHERE NOT (relation = '{TASK}' AND EXISTS (SELECT 1 FROM sp WHERE split <> 'train' AND least(n1, n2) = least(node1, node2) AND greatest(n1, n2) = greatest(node1, node2))) GROUP BY 1""",
    "rescue": f"""WITH {_splits_sql(0.3, 0.4)}, h AS (SELECT CAST(CASE WHEN split = 'val' THEN 0 ELSE 1 END AS INTEGER) AS ord, n1, n2 FROM sp WHERE split <> 'train'),
kept AS (SELECT node1, node2 FROM e WHERE NOT (relation = '{TASK}' AND EXISTS (SELECT 1 FROM h WHERE least(n1, n2) = least(node1, node2) AND greatest(n1, n2) = greatest(node1, node2)))), there AS (SELECT node1 AS node FROM kept UNION SELECT node2 FROM kept),
s AS (SELECT node FROM n EXCEPT SELECT node FROM there), c AS (SELECT n1 AS node, * FROM h UNION ALL SELECT n2, * FROM h)
SELECT DISTINCT ord, n1, n2 FROM c JOIN s USING (node) QUALIFY row_number() OVER (PARTITION BY node ORDER BY ord, n1, n2) = 1""",
    "leak_checks": f"""WITH {_SPLIT}{_NEG}, c AS (SELECT count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'test') AS t FROM sp), z AS (SELECT n1, n2, CASE WHEN place <= v THEN 'val' WHEN place <= v + t THEN 'test' ELSE 'train' END AS split FROM neg, c),
k AS (SELECT 'train_val' AS "check", (SELECT count(*) FROM (SELECT n1, n2 FROM sp WHERE split = 'train' INTERSECT SELECT n1, n2 FROM sp WHERE split = 'val')) AS n UNION ALL SELECT 'train_test', (SELECT count(*) FROM (SELECT n1, n2 FROM sp WHERE split = 'train' INTERSECT SELECT n1, n2 FROM sp WHERE split = 'test'))
UNION ALL SELECT 'val_test', (SELECT count(*) FROM (SELECT n1, n2 FROM sp WHERE split = 'val' INTERSECT SELECT n1, n2 FROM sp WHERE split = 'test')) UNION ALL SELECT 'positive_negative', (SELECT count(*) FROM (SELECT n1, n2 FROM sp INTERSECT SELECT n1, n2 FROM z))
UNION ALL SELECT 'negatives_twice', (SELECT count(*) FROM (SELECT n1, n2 FROM z GROUP BY 1, 2 HAVING count(DISTINCT split) > 1))) SELECT "check", n, n = 0 AS ok FROM k""",
    "stratified_sample": f"WITH {_STRATA} SELECT edge_id, relation FROM o WHERE r <= greatest(1, round_even(total * CASE WHEN relation = 'GEN-cex-GEN' THEN 0.015 WHEN relation IN ('GEN-ass-DIS', 'GEN-ppi-GEN') THEN 1.0 ELSE 0.25 END, 0))",
    "nested_sample": f"""WITH {_STRATA}, k AS (SELECT relation, r <= greatest(1, round_even(total * 0.25, 0)) AS a, r <= greatest(1, round_even(total * 0.5, 0)) AS b, r <= greatest(1, round_even(total * 0.75, 0)) AS c FROM o)
SELECT relation, count(*) FILTER (a) AS n_25, count(*) FILTER (b) AS n_50, count(*) FILTER (c) AS n_75, count(*) FILTER (a AND b) AS n_25_in_50, count(*) FILTER (b AND c) AS n_50_in_75 FROM k GROUP BY 1""",
    "pair_features": f"WITH {_SCORES.replace('CAST(embedding AS DOUBLE[])', 'embedding')} SELECT pair_id, CAST(128 AS INTEGER) AS n_features, round(list_sum([CAST(a[i] * b[i] AS DOUBLE) FOR i IN range(1, 65)]) + list_sum([CAST(abs(a[i] - b[i]) AS DOUBLE) FOR i IN range(1, 65)]), 3) AS feature_total, round(list_sum([CAST(a[i] + b[i] AS DOUBLE) FOR i IN range(1, 65)]), 3) AS sum_total FROM pv",
    "pair_scores": f"WITH {_SCORES} SELECT pair_id, relation, split, label, score FROM l",
    "auroc": _areas(" SELECT relation, split, round(sum(p * (neg - fp + 0.5 * n)) / nullif(max(pos * neg), 0), 6) AS auroc FROM c GROUP BY 1, 2", "relation, split"),
    "auprc": _areas(" SELECT relation, split, round(sum(p / nullif(pos, 0) * tp / (tp + fp)), 6) AS auprc, CAST(sum(p + n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos FROM c GROUP BY 1, 2", "relation, split"),
    "f1_threshold": _areas(" SELECT DISTINCT ON (relation) relation, score AS threshold, round(2.0 * tp / (tp + fp + pos), 6) AS f1 FROM c WHERE pos > 0 ORDER BY relation, round(2.0 * tp / (tp + fp + pos), 12) DESC, score", "relation", "split = 'val'"),
    "confusion": f"WITH {_SCORES}, v AS (SELECT relation, score, label FROM l WHERE split = 'val'), t AS (SELECT relation, score, sum(label) AS p, sum(1 - label) AS n FROM v GROUP BY ALL), c AS (SELECT *, sum(p) OVER u AS tp, sum(n) OVER u AS fp, sum(p) OVER (PARTITION BY relation) AS pos FROM t WINDOW u AS (PARTITION BY relation ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), h AS (SELECT DISTINCT ON (relation) relation, score AS threshold FROM c WHERE pos > 0 ORDER BY relation, round(2.0 * tp / (tp + fp + pos), 12) DESC, score), k AS (SELECT relation, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label <> 1) AS tn FROM l JOIN h USING (relation) WHERE split = 'test' GROUP BY 1) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k",
    "pr_curve": _areas(" SELECT relation, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall FROM c", "relation", "split = 'test'"),
    "roc_curve": _areas(" SELECT relation, score AS threshold, round(fp / nullif(neg, 0), 6) AS fpr, round(tp / nullif(pos, 0), 6) AS tpr FROM c", "relation", "split = 'test'"),
    "precision_at_k": f"WITH {_SCORES} SELECT relation, split, round(avg(label), 6) AS precision_at_k, count(*) AS n_ranked FROM (SELECT *, row_number() OVER (PARTITION BY relation, split ORDER BY score DESC, pair_id) AS r FROM l WHERE label IS NOT NULL) WHERE r <= 10 GROUP BY 1, 2",
    "hits_mrr": f"WITH {_SCORES}, x AS (SELECT * FROM l WHERE split = 'test'), q AS (SELECT p.relation, p.pair_id, 1 + count(c.pair_id) AS rank FROM (SELECT * FROM x WHERE label = 1) p LEFT JOIN (SELECT * FROM x WHERE label = 0) c ON c.relation = p.relation AND c.n1 = p.n1 AND c.score > p.score GROUP BY 1, 2) SELECT relation, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_k, round(avg(1.0 / rank), 6) AS mrr, count(*) AS n_queries FROM q GROUP BY 1",
}
