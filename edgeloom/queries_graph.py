"""Queries on the graph: link heuristics, components, matrices, metapaths, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.hashing import draw
from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import metrics as M
from edgeloom.operators import splits as S
from edgeloom.plans.durable import materialise
from edgeloom.queries_edges import CLEAN, ENDS, edges
from edgeloom.session import table

TASK = "GEN-ass-DIS"
METHODS = ["preferential_attachment", "common_neighbors", "jaccard"]


def task_pairs(e: DataFrame, relation: str = TASK) -> DataFrame:
    """(n1, n2): the distinct pairs of a relation from genes to others, the gene first."""
    gene_first = F.col("node1").startswith("ensg")
    return e.filter(F.col("relation") == relation).select(F.when(gene_first, F.col("node1")).otherwise(F.col("node2")).alias("n1"), F.when(gene_first, F.col("node2")).otherwise(F.col("node1")).alias("n2")).distinct()


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n1, n2, label, three scores) of held-out pairs and ten typed negatives each, on the graph without the held-out pairs."""
    e = materialise(edges(spark, sf_dir).select("node1", "node2", "node1_type", "node2_type", "relation"), "edges")
    pairs = task_pairs(e)
    test = materialise(S.protected(pairs, e).filter(~F.col("protected") & (draw(S.SEED, 100, "n1", "n2") < 20)).select("n1", "n2"), "test")
    train = E.exclude_pairs(e, test.withColumn("relation", F.lit(TASK)))
    universe = lambda t: E.ends(e).filter(F.col("node_type") == t).select("node")
    negative = S.negatives(universe("GEN"), universe("DIS"), pairs, 10 * test.count())
    asked = test.withColumn("label", F.lit(1)).unionByName(negative.select("n1", "n2", F.lit(0).alias("label")))
    return G.neighbour_scores(materialise(E.closure(train), "adjacency"), asked)


def _eval(s, d):
    """The unlearned heuristics' areas under the two curves."""
    long = scored_pairs(s, d).unpivot(["label"], METHODS, "method", "score")
    return M.ranking_report(long, ["method"])


def _ranked(s, d, most_rounds=None):
    """Hits@10 and mean reciprocal rank of held-out pairs among 99 typed candidates each, by common neighbours."""
    e = materialise(edges(s, d).select("node1", "node2", "node1_type", "node2_type", "relation"), "edges")
    pairs = task_pairs(e)
    test = materialise(S.protected(pairs, e).filter(~F.col("protected") & (draw(S.SEED, 100, "n1", "n2") < 20)).select("n1", "n2"), "test")
    adjacency = materialise(E.closure(E.exclude_pairs(e, test.withColumn("relation", F.lit(TASK)))), "adjacency")
    asked = materialise(S.ranking_candidates(test, E.ends(e).filter("node_type = 'DIS'").select("node"), pairs, most_rounds=most_rounds), "candidates")
    scored = G.neighbour_scores(adjacency, asked.select("n1", F.col("candidate").alias("n2")).distinct())
    # As in neighbour_scores: the planner would broadcast a small file of many rows.
    ranked = asked.hint("merge").join(scored.select("n1", F.col("n2").alias("candidate"), F.col("common_neighbors").alias("score")), ["n1", "candidate"]).withColumn("query", F.struct("n1", "n2"))
    return M.hits_and_mrr(ranked, [], "query", 10)


def _components(s, d):
    return G.connected_components(materialise(E.closure(edges(s, d)), "adjacency"))


def _component_sizes(s, d):
    sizes = _components(s, d).groupBy("component").agg(F.count("*").alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count("*").alias("n_components"))


def _mutation_adjacency(s, d):
    return E.closure(edges(s, d).filter("relation = 'CLL-mut-GEN'"), self_loops=False)


def _walks(s, d):
    adj = materialise(_mutation_adjacency(s, d), "adjacency")
    return G.random_walks(adj, adj.filter(F.col("node").startswith("cvcl")), 5, seed=7)


def whole_adjacency(s, d):
    """The closure of the whole edge table; self-loops keep nodes that have nothing else."""
    return materialise(E.closure(edges(s, d)), "adjacency")


def _biased(s, d):
    """Second-order walks from every node of the graph, as many and as long as node2vec's."""
    adj = whole_adjacency(s, d)
    w = G.random_walks(adj, adj, 10, 4, p=0.25, q=4.0, seed=7)
    return w.select("walk_id", F.array_join("path", " ").alias("path"))


def _hub_walk_pairs(s, d):
    """Cell lines one hub apart in the metapath walks, and how often."""
    w = _walks(s, d)
    lines = w.select(F.filter("path", lambda x: x.startswith("cvcl")).alias("path"))
    return G.walk_pairs(lines)


def _propagated(adj):
    """One step of normalised message passing of each node's degree and of one."""
    x = adj.groupBy("node").agg(F.array(F.count_if(F.col("node") != F.col("nbr")).cast("double"), F.lit(1.0)).alias("x"))
    return G.propagate(G.normalised_adjacency(adj), x).select("node", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"))


def _attention(adj, nudge=0.0):
    """Softmax over each node's neighbours of the neighbours' log degree; ``nudge`` takes shares off the half at which rounding hangs on the last bit."""
    adj = adj.filter("node <> nbr")
    deg = adj.groupBy("node").agg(F.count("*").alias("n"))
    e = adj.join(deg.select(F.col("node").alias("nbr"), F.log("n").alias("e")), "nbr")
    return G.edge_softmax(e).select("node", "nbr", F.round(F.col("a") + nudge, 6).alias("a"))


QUERIES = {
    "heuristics_scores": lambda s, d: scored_pairs(s, d).select("n1", "n2", "label", "preferential_attachment", "common_neighbors", F.round("jaccard", 8).alias("jaccard")),
    "heuristics_eval": _eval,
    "heuristics_ranked": lambda s, d: _ranked(s, d, most_rounds=1),
    "heuristics_ranked_full": _ranked,
    "components": _components,
    "component_sizes": _component_sizes,
    "adjacency_lists": lambda s, d: G.adjacency_lists(edges(s, d)).select("node", "block", F.size("nbrs").alias("n"), F.md5(F.array_join("nbrs", ",")).alias("nbrs_md5")),
    "norm_adjacency": lambda s, d: G.normalised_adjacency(E.closure(edges(s, d))).select("node", "nbr", F.round("w", 8).alias("w")),
    "norm_laplacian": lambda s, d: G.normalised_laplacian(E.closure(edges(s, d))).select("node", "nbr", F.round("w", 8).alias("w")),
    "graph_shape": lambda s, d: G.graph_shape(edges(s, d)),
    "metapath_support": lambda s, d: G.metapath_support(edges(s, d), "node2"),
    "metapath_whatif": lambda s, d: G.hub_what_if(edges(s, d), "node2", [50, 75, 90, 95, 99]),
    "hub_cap": lambda s, d: G.cap_hubs(edges(s, d), "node2", 20).groupBy("relation").agg(F.count("*").alias("n_edges")),
    "random_walk": lambda s, d: _walks(s, d).select("walk_id", F.array_join("path", " ").alias("path")),
    "random_walk_biased": _biased,
    "walk_pairs": _hub_walk_pairs,
    "propagate": lambda s, d: _propagated(materialise(_mutation_adjacency(s, d), "adjacency")),
    "edge_softmax": lambda s, d: _attention(materialise(_mutation_adjacency(s, d), "adjacency")),
    "propagate_graph": lambda s, d: _propagated(whole_adjacency(s, d)),
    "edge_softmax_graph": lambda s, d: _attention(whole_adjacency(s, d), 1e-10),
}


def draw_sql(seed: int, n: str, *cols: str) -> str:
    """``draw`` in DuckDB."""
    parts = ", ".join(["'" + str(seed) + "'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT % ({n}))"


_MUT = CLEAN + ", adj AS (SELECT node1 AS node, node2 AS nbr FROM e WHERE relation = 'CLL-mut-GEN' AND node1 <> node2 UNION SELECT node2, node1 FROM e WHERE relation = 'CLL-mut-GEN' AND node1 <> node2), deg AS (SELECT node, count(*) AS d FROM adj GROUP BY 1)"
_WHOLE = CLEAN + ", adj AS (SELECT node1 AS node, node2 AS nbr FROM e WHERE node1 <> node2 UNION SELECT node2, node1 FROM e WHERE node1 <> node2), v AS (SELECT node1 AS node FROM e UNION SELECT node2 FROM e), deg AS (SELECT node, count(*) AS d FROM adj GROUP BY 1)"
_SCORES = f"""WITH {ENDS}, rowdeg AS (SELECT node, count(*) AS d FROM n GROUP BY 1),
pairs AS (SELECT DISTINCT CASE WHEN starts_with(node1, 'ensg') THEN node1 ELSE node2 END AS n1, CASE WHEN starts_with(node1, 'ensg') THEN node2 ELSE node1 END AS n2 FROM e WHERE relation = '{TASK}'),
test AS MATERIALIZED (SELECT n1, n2 FROM pairs JOIN rowdeg a ON a.node = n1 JOIN rowdeg b ON b.node = n2 WHERE a.d > 1 AND b.d > 1 AND {draw_sql(42, '100', 'n1', 'n2')} < 20),
train AS (SELECT node1, node2 FROM e WHERE NOT (relation = '{TASK}' AND EXISTS (SELECT 1 FROM test t WHERE least(node1, node2) = least(n1, n2) AND greatest(node1, node2) = greatest(n1, n2)))),
adj AS MATERIALIZED (SELECT node1 AS node, node2 AS nbr FROM train UNION SELECT node2, node1 FROM train), deg AS (SELECT node, count(*) AS d FROM adj GROUP BY 1),
ga AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node FROM n WHERE node_type = 'GEN')), gb AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node FROM n WHERE node_type = 'DIS')),
size AS (SELECT (SELECT count(*) FROM ga) AS na, (SELECT count(*) FROM gb) AS nb, (SELECT 10 * count(*) FROM test) AS need),
d AS (SELECT id, {draw_sql(42, 'na', "'a'", 'id')} AS ia, {draw_sql(42, 'nb', "'b'", 'id')} AS ib, need FROM (SELECT unnest(generate_series(0, greatest(2000, 3 * need) - 1)) AS id, na, nb, need FROM size)),
f AS (SELECT ga.node AS n1, gb.node AS n2, min(id) AS id, any_value(need) AS need FROM d JOIN ga ON ga.i = ia JOIN gb ON gb.i = ib WHERE ga.node <> gb.node AND (ga.node, gb.node) NOT IN (SELECT (n1, n2) FROM pairs) GROUP BY 1, 2),
neg AS (SELECT n1, n2 FROM f QUALIFY row_number() OVER (ORDER BY id) <= need),
q AS MATERIALIZED (SELECT n1, n2, 1 AS label FROM test UNION ALL SELECT n1, n2, 0 FROM neg),
cn AS (SELECT n1, n2, count(*) AS c FROM q JOIN adj x ON x.node = n1 JOIN adj y ON y.node = n2 AND y.nbr = x.nbr GROUP BY 1, 2),
s AS (SELECT n1, n2, label, CAST(a.d * b.d AS DOUBLE) AS preferential_attachment, CAST(coalesce(c, 0) AS DOUBLE) AS common_neighbors, coalesce(c, 0) / (a.d + b.d - coalesce(c, 0)) AS jaccard
  FROM q JOIN deg a ON a.node = n1 JOIN deg b ON b.node = n2 LEFT JOIN cn USING (n1, n2))"""
AREAS = """, t AS (SELECT {g}, score, sum(label) AS p, sum(1 - label) AS n FROM l GROUP BY ALL),
c AS (SELECT *, sum(p) OVER u AS tp, sum(n) OVER u AS fp, sum(p) OVER w AS pos, sum(n) OVER w AS neg FROM t WINDOW u AS (PARTITION BY {g} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY {g}))"""
COMPONENTS = f"""WITH RECURSIVE {CLEAN}, adj AS (SELECT node1 AS u, node2 AS v FROM e UNION SELECT node2, node1 FROM e),
walk(start, node) AS (SELECT u, u FROM adj UNION SELECT w.start, a.v FROM walk w JOIN adj a ON a.u = w.node WHERE w.start < a.v),
low AS (SELECT node, min(start) AS component FROM (SELECT start, node FROM walk) GROUP BY 1)"""
_HUBS = CLEAN + ", h AS (SELECT relation, node2, count(DISTINCT node1) AS d FROM e GROUP BY 1, 2)"

ORACLE = {
    "heuristics_scores": _SCORES + " SELECT n1, n2, label, preferential_attachment, common_neighbors, round(jaccard, 8) AS jaccard FROM s",
    "heuristics_eval": _SCORES
    + ", l AS (SELECT label, unnest(['preferential_attachment', 'common_neighbors', 'jaccard']) AS method, unnest([preferential_attachment, common_neighbors, jaccard]) AS score FROM s)"
    + AREAS.format(g="method")
    + " SELECT method, round(sum(p * (neg - fp + 0.5 * n)) / max(pos * neg), 6) AS auroc, round(sum(p / pos * tp / (tp + fp)), 6) AS auprc, CAST(sum(p + n) AS BIGINT) AS n_test, CAST(sum(p) AS BIGINT) AS n_pos_test FROM c GROUP BY 1",
    "heuristics_ranked": _SCORES
    + f""", c0 AS (SELECT n1, n2, i, {draw_sql(42, 'nb', "'rank'", 'n1', 'n2', 'i')} AS ib FROM (SELECT n1, n2, nb, unnest(generate_series(0, 197)) AS i FROM test, size)),
c1 AS (SELECT n1, n2, gb.node AS c, min(c0.i) AS i FROM c0 JOIN gb ON gb.i = ib WHERE gb.node <> n2 AND (n1, gb.node) NOT IN (SELECT (n1, n2) FROM pairs) AND (gb.node, n1) NOT IN (SELECT (n1, n2) FROM pairs) GROUP BY 1, 2, 3),
c2 AS (SELECT n1, n2, c, false AS t FROM c1 QUALIFY row_number() OVER (PARTITION BY n1, n2 ORDER BY i) <= 99 UNION ALL SELECT n1, n2, n2, true FROM test),
k AS (SELECT n1, c, count(*) AS s FROM (SELECT DISTINCT n1, c FROM c2) JOIN adj x ON x.node = n1 JOIN adj y ON y.node = c AND y.nbr = x.nbr GROUP BY 1, 2),
v AS (SELECT c2.n1, n2, t, coalesce(s, 0) AS s FROM c2 JOIN deg a ON a.node = c2.n1 JOIN deg b ON b.node = c2.c LEFT JOIN k ON k.n1 = c2.n1 AND k.c = c2.c),
r AS (SELECT v.n1, v.n2, 1 + count(*) FILTER (v.s > w.s) AS rank FROM v JOIN v w ON w.t AND w.n1 = v.n1 AND w.n2 = v.n2 GROUP BY 1, 2)
SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_k, round(avg(1.0 / rank), 6) AS mrr, count(*) AS n_queries FROM r""",
    "components": COMPONENTS + " SELECT node, component FROM low",
    "component_sizes": COMPONENTS + ", s AS (SELECT count(*) AS n_nodes FROM low GROUP BY component) SELECT n_nodes, count(*) AS n_components FROM s GROUP BY 1",
    "adjacency_lists": f"WITH {CLEAN}, adj AS (SELECT node1 AS node, node2 AS nbr FROM e WHERE node1 <> node2 UNION SELECT node2, node1 FROM e WHERE node1 <> node2), p AS (SELECT node, nbr, CAST((row_number() OVER (PARTITION BY node ORDER BY nbr) - 1) // 1000 AS INTEGER) AS block FROM adj) SELECT node, block, CAST(count(*) AS INTEGER) AS n, md5(string_agg(nbr, ',' ORDER BY nbr)) AS nbrs_md5 FROM p GROUP BY 1, 2",
    "norm_adjacency": f"""WITH {CLEAN}, a AS (SELECT node1 AS node, node2 AS nbr FROM e UNION SELECT node2, node1 FROM e UNION SELECT node1, node1 FROM e UNION SELECT node2, node2 FROM e), d AS (SELECT node, count(*) AS d FROM a GROUP BY 1)
SELECT a.node, a.nbr, round(1 / sqrt(x.d * y.d), 8) AS w FROM a JOIN d x ON x.node = a.node JOIN d y ON y.node = a.nbr""",
    "norm_laplacian": f"""WITH {CLEAN}, a AS (SELECT node1 AS node, node2 AS nbr FROM e WHERE node1 <> node2 UNION SELECT node2, node1 FROM e WHERE node1 <> node2), d AS (SELECT node, count(*) AS d FROM a GROUP BY 1)
SELECT a.node, a.nbr, round(-1 / sqrt(x.d * y.d), 8) AS w FROM a JOIN d x ON x.node = a.node JOIN d y ON y.node = a.nbr UNION ALL SELECT node, node, 1.0 FROM d""",
    "graph_shape": f"""WITH {CLEAN}, a AS (SELECT DISTINCT least(node1, node2) AS u, greatest(node1, node2) AS v FROM e WHERE node1 <> node2), n AS (SELECT u FROM a UNION SELECT v FROM a), c AS (SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM a) AS n_edges)
SELECT n_nodes, n_edges, round(2.0 * n_edges / nullif(n_nodes * (n_nodes - 1), 0), 8) AS density FROM c""",
    "metapath_support": f"""WITH {_HUBS} SELECT relation, CAST(sum(d) AS BIGINT) AS n_edges, count(*) AS n_hubs, min(d) AS min_degree, median(d) AS median_degree, max(d) AS max_degree, CAST(sum(d * (d - 1) / 2) AS BIGINT) AS n_instances,
round(max(d * (d - 1) / 2) / nullif(sum(d * (d - 1) / 2), 0), 6) AS top_hub_share FROM h GROUP BY 1""",
    "metapath_whatif": f"""WITH {_HUBS}, q AS (SELECT relation, quantile_cont(d, [0.5, 0.75, 0.9, 0.95, 0.99]) AS v FROM h GROUP BY 1), c AS (SELECT relation, unnest([50, 75, 90, 95, 99]) AS p, CAST(floor(unnest(v)) AS BIGINT) AS cap FROM q)
SELECT relation, p, cap, count(*) FILTER (d > cap) AS n_excluded, CAST(coalesce(sum(d * (d - 1) / 2) FILTER (d <= cap), 0) AS BIGINT) AS n_kept, round(coalesce(sum(d * (d - 1) / 2) FILTER (d <= cap), 0) / nullif(sum(d * (d - 1) / 2), 0), 6) AS share_kept FROM h JOIN c USING (relation) GROUP BY 1, 2, 3""",
    "hub_cap": f"WITH {_HUBS} SELECT e.relation, count(*) AS n_edges FROM e JOIN h ON h.relation = e.relation AND h.node2 = e.node2 WHERE h.d <= 20 GROUP BY 1",
    "random_walk": f"""WITH RECURSIVE {_MUT}, placed AS MATERIALIZED (SELECT a.node, nbr, row_number() OVER (PARTITION BY a.node ORDER BY nbr) - 1 AS i, d FROM adj a JOIN deg USING (node)),
w(walk_id, node, step, path) AS (SELECT node || '#0', node, 0, node FROM deg WHERE starts_with(node, 'cvcl')
  UNION ALL SELECT walk_id, p.nbr, step + 1, path || ' ' || p.nbr FROM w JOIN placed p ON p.node = w.node AND p.i = {draw_sql(7, 'p.d', 'walk_id', 'step + 1')} WHERE step < 4)
SELECT walk_id, path FROM w WHERE step = 4""",
    "walk_pairs": f"""WITH RECURSIVE {_MUT}, placed AS MATERIALIZED (SELECT a.node, nbr, row_number() OVER (PARTITION BY a.node ORDER BY nbr) - 1 AS i, d FROM adj a JOIN deg USING (node)),
w(walk_id, node, step, path) AS (SELECT node || '#0', node, 0, [node] FROM deg WHERE starts_with(node, 'cvcl') UNION ALL SELECT walk_id, p.nbr, step + 1, list_append(path, p.nbr) FROM w JOIN placed p ON p.node = w.node AND p.i = {draw_sql(7, 'p.d', 'walk_id', 'step + 1')} WHERE step < 4),
l AS (SELECT list_filter(path, lambda x: starts_with(x, 'cvcl')) AS p FROM w WHERE step = 4), k AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM l) SELECT p[i] AS a, p[i + 1] AS b, count(*) AS n FROM k GROUP BY 1, 2""",
    "propagate": f"""WITH {_MUT}, a AS (SELECT node, nbr FROM adj UNION ALL SELECT node, node FROM deg), s AS (SELECT node, count(*) AS d FROM a GROUP BY 1)
SELECT a.node, round(sum(deg.d / sqrt(x.d * y.d)), 6) AS x0, round(sum(1 / sqrt(x.d * y.d)), 6) AS x1 FROM a JOIN s x ON x.node = a.node JOIN s y ON y.node = a.nbr JOIN deg ON deg.node = a.nbr GROUP BY 1""",
    "edge_softmax": f"WITH {_MUT} SELECT a.node, nbr, round(d / sum(d) OVER (PARTITION BY a.node), 6) AS a FROM adj a JOIN deg ON deg.node = a.nbr",
    "propagate_graph": f"""WITH {_WHOLE}, a AS (SELECT node, nbr FROM adj UNION ALL SELECT node, node FROM v), s AS (SELECT node, count(*) AS d FROM a GROUP BY 1)
SELECT a.node, round(sum(coalesce(deg.d, 0) / sqrt(x.d * y.d)), 6) AS x0, round(sum(1 / sqrt(x.d * y.d)), 6) AS x1 FROM a JOIN s x ON x.node = a.node JOIN s y ON y.node = a.nbr LEFT JOIN deg ON deg.node = a.nbr GROUP BY 1""",
    "edge_softmax_graph": f"WITH {_WHOLE} SELECT a.node, nbr, round(d / sum(d) OVER (PARTITION BY a.node) + 1e-10, 6) AS a FROM adj a JOIN deg ON deg.node = a.nbr",
}
