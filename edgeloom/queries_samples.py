"""Queries on multi-scale samples, non-edges, hold-outs, guards, catalogs and reports of coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions.scalars import category_order
from edgeloom.functions.text import ensg, real_value
from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import mapping as P
from edgeloom.operators import splits as S
from edgeloom.plans.durable import materialise
from edgeloom.plans.ranking import ranked
from edgeloom.queries_edges import CLEAN, ENDS, edges
from edgeloom.queries_graph import COMPONENTS, draw_sql
from edgeloom.queries_models import labelled_pairs
from edgeloom.queries_tasks import _md5
from edgeloom.session import table

#: Shares of the scales, in percent.
SCALES = (25, 50, 75, 100)


def _multiscale(s, d):
    """(scale, n_edges, n_nodes, n_rescued, pct_nodes): of each nested sample by relation, with every edge of a node that has no other, and one edge of each node it would lose."""
    e = materialise(edges(s, d).select("edge_id", "node1", "node2", "relation"), "edges")
    scaled = materialise(S.scales(e, SCALES), "scaled")
    ends = scaled.select("scale", F.explode(F.array("node1", "node2")).alias("node")).groupBy("scale").agg(F.countDistinct("node").alias("n_nodes"))
    sizes = scaled.groupBy("scale").agg(F.count("*").alias("n_edges"), F.count_if("rescued").alias("n_rescued"))
    total = e.select(F.explode(F.array("node1", "node2")).alias("node")).agg(F.countDistinct("node").alias("_n"))
    return sizes.join(ends, "scale").crossJoin(total).select("scale", "n_edges", "n_nodes", "n_rescued", F.round(100.0 * F.col("n_nodes") / F.col("_n"), 4).alias("pct_nodes"))


def _non_edges(s, d):
    """(n1, n2, place): as many uniform pairs without an edge, of any types, as there are linked pairs."""
    e = edges(s, d)
    pairs = materialise(E.canonical(e).distinct(), "pairs")
    nodes = E.ends(e).select("node")
    return S.negatives(nodes, nodes, pairs, pairs.count(), symmetric=True)


def _hold_out(s, d):
    """(relation, n_kept, n_held): a tenth of each relation's positive train pairs, held out for validation by hash order."""
    positive = labelled_pairs(s, d).filter("label = 1 AND split = 'train'").select("pair_id", "relation").distinct()
    held = S.stratified_sample(materialise(positive, "positive"), "relation", ["pair_id"], 0.1).withColumn("held", F.lit(True))
    return positive.join(held.select("pair_id", "held"), "pair_id", "left").groupBy("relation").agg(F.count_if(F.col("held").isNull()).alias("n_kept"), F.count_if("held").alias("n_held"))


def _guards(s, d):
    """(relation, source, n_train, n_pos, n_val, n_test, verdict): whether a unit has the data that training needs, and what it lacks."""
    pair = labelled_pairs(s, d).filter("label IS NOT NULL")
    counts = pair.groupBy("relation", "source").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if((F.col("split") == "train") & (F.col("label") == 1)).alias("n_pos"), F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test"))
    return S.guarded_units(counts)


def _channels(s, d):
    """(l_suppkey, sum_a, sum_n, sum_r, total): a score's sums by channel of evidence, none as 0."""
    sums = table(s, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("double"))).na.fill(0.0)
    return sums.select("l_suppkey", F.col("A").alias("sum_a"), F.col("N").alias("sum_n"), F.col("R").alias("sum_r"), (F.col("A") + F.col("N") + F.col("R")).alias("total"))


def _exclusions(s, d):
    """(reason, n_genes, n_uniprot, n_genept, place): genes by why they have no mapping, or ``mapped``, and how many have outer vectors; mapped first, then the most frequent."""
    t = table(s, d, "gen_id_mapping_table").select(ensg("graph_node_id").alias("gene"), real_value("motivo_exclusion").alias("reason"), F.coalesce("uniprot_has_embedding", F.lit(False)).alias("u"), F.coalesce("genept_has_embedding", F.lit(False)).alias("g")).filter("gene IS NOT NULL")
    per = t.groupBy("gene").agg(F.coalesce(F.min("reason"), F.lit("mapped")).alias("reason"), F.max("u").alias("u"), F.max("g").alias("g"))
    return per.groupBy("reason").agg(F.count("*").alias("n_genes"), F.count_if("u").alias("n_uniprot"), F.count_if("g").alias("n_genept")).withColumn("place", category_order(F.col("reason"), ["mapped"]))


def _external(s, d):
    """(gene, accession, state, has_vector): each gene's accession by the ladder of candidates, and whether that accession has a vector."""
    rows = table(s, d, "gen_id_mapping_table").select(ensg("graph_node_id").alias("key"), real_value("uniprot_accession").alias("value"), F.lower(F.trim("estado_mapeo")).startswith("mapeado_revisado").alias("reviewed"), F.coalesce("uniprot_has_embedding", F.lit(False)).alias("has_vector")).filter("key IS NOT NULL")
    rows = materialise(rows, "candidates")
    held = rows.filter("value IS NOT NULL").groupBy("key", "value").agg(F.max("has_vector").alias("has_vector"))
    best = P.best_candidate(rows)
    return best.join(held, ["key", "value"], "left").select(F.col("key").alias("gene"), F.col("value").alias("accession"), "state", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


def _catalog(s, d):
    """(source, condition, seed, node_type, n_nodes, n_vectors, n_held, dimension): what the catalog holds of each space."""
    c = table(s, d, "embedding_catalog")
    return c.groupBy(F.col("embedding_source").alias("source"), F.col("training_condition").alias("condition"), "seed", F.coalesce("node_type", F.lit(E.UNKNOWN)).alias("node_type")).agg(
        F.countDistinct("node_id").alias("n_nodes"), F.count("embedding").alias("n_vectors"), F.count_if(F.col("retired_at").isNull()).alias("n_held"), F.max("dimension").alias("dimension")
    )


def _hin_input(s, d):
    """(relation, a, b): the distinct edges as numbers of their nodes, which count from 0 in the order of their ids."""
    e = materialise(edges(s, d).select("relation", "node1", "node2").distinct(), "edges")
    index = materialise(ranked(E.ends(e.withColumn("node1_type", F.lit("")).withColumn("node2_type", F.lit(""))).select("node").distinct(), [], ["node"], "_r").select("node", (F.col("_r") - 1).alias("i")), "index")
    a, b = index.toDF("node1", "a"), index.toDF("node2", "b")
    return e.join(a, "node1").join(b, "node2").select("relation", "a", "b")


def _rows_distinct(s, d):
    """(relation, n_rows, n_distinct): rows, and those left when rows equal in all columns but the id are one."""
    t = table(s, d, "graph_edges").drop("edge_id")
    return t.groupBy(*t.columns).agg(F.count("*").alias("n")).groupBy("relation").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"))


def _component_classes(s, d):
    """(kind, n_components, n_nodes): isolated nodes, small components and the giant one, which is the largest, the first by its smallest node."""
    sizes = G.connected_components(materialise(E.closure(edges(s, d)), "adjacency")).groupBy("component").agg(F.count("*").alias("n"))
    sizes = materialise(sizes, "sizes")
    top = sizes.agg(F.min(F.struct((-F.col("n")).alias("m"), "component")).alias("t")).select(F.col("t.component").alias("giant"))
    kind = F.when(F.col("component") == F.col("giant"), "giant").when(F.col("n") == 1, "isolated").otherwise("small")
    return sizes.crossJoin(top).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_components"), F.sum("n").alias("n_nodes"))


def _profile(s, d):
    """(n_nodes, n_edges, n_components, is_connected, top_degree, top_node) of the simple undirected graph."""
    adjacency = materialise(E.closure(edges(s, d)), "adjacency")
    linked = adjacency.filter("node <> nbr")
    degree = adjacency.groupBy("node").agg(F.count_if(F.col("node") != F.col("nbr")).alias("d"))
    best = degree.agg(F.count("*").alias("n_nodes"), F.min(F.struct((-F.col("d")).alias("m"), "node")).alias("t"))
    parts = G.connected_components(adjacency).agg(F.countDistinct("component").alias("n_components"))
    out = best.crossJoin(parts).crossJoin(linked.agg((F.count("*") / 2).cast("bigint").alias("n_edges")))
    return out.select("n_nodes", "n_edges", "n_components", (F.col("n_components") == 1).alias("is_connected"), (-F.col("t.m")).alias("top_degree"), F.col("t.node").alias("top_node"))


def _pair_stats(s, d):
    """(l_suppkey, n, total, smallest, largest, mean): several statistics of each group in one pass."""
    v = F.col("l_quantity").cast("double")
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("smallest"), F.max(v).alias("largest"), F.round(F.avg(v), 6).alias("mean"))


def _metric_pivots(s, d):
    """One row a source, with the mean of three metrics for each of three relations, side by side."""
    t = table(s, d, "seccion12_tabla_completa").filter("source IS NOT NULL")
    wide = t.groupBy("source").pivot("relation", PIVOTED).agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS])
    return wide.select("source", *[F.col(f"`{r}_{m}`").alias(f"{r}_{m}".replace("-", "_")) for r in PIVOTED for m in METRICS])


#: Relations and metrics of the side-by-side table.
PIVOTED = ["GEN-ass-DIS", "GEN-ppi-GEN", "CLL-mut-GEN"]
METRICS = ["test_auprc", "test_auroc", "test_f1"]

QUERIES = {
    "component_classes": _component_classes, "graph_profile": _profile, "pair_stats": _pair_stats, "metric_pivots": _metric_pivots,
    "multiscale": _multiscale, "non_edges": _non_edges, "hold_out_positives": _hold_out, "unit_guards": _guards, "channel_sums": _channels, "exclusion_report": _exclusions, "external_mapping": _external,
    "catalog_summary": _catalog, "hin_input": _hin_input, "rows_distinct": _rows_distinct,
}

_NUMBER = r"nullif(regexp_extract(regexp_replace(lower({}), '[^a-z0-9.]', '', 'g'), 'ensg\.?([0-9]+)', 1), '')"
_GENE = f"'ENSG' || lpad(CAST(CAST({_NUMBER.format('graph_node_id')} AS BIGINT) AS VARCHAR), 11, '0')"
_REAL = "CASE WHEN lower(trim({0}, ' \t\r\n')) NOT IN ('', 'none', 'nan', '-', 'n/a') THEN trim({0}, ' \t\r\n') END"
_SCALE = f"""{ENDS}, dg AS (SELECT node, count(*) AS d FROM n GROUP BY 1), o AS (SELECT edge_id, node1, node2, relation, row_number() OVER (PARTITION BY relation ORDER BY {_md5('edge_id')}, edge_id) AS r, count(*) OVER (PARTITION BY relation) AS t, a.d = 1 OR b.d = 1 AS lone FROM e JOIN dg a ON a.node = node1 JOIN dg b ON b.node = node2),
sc AS (SELECT unnest([{', '.join(map(str, SCALES))}]) AS scale), k AS MATERIALIZED (SELECT scale, edge_id, node1, node2, lone OR r <= greatest(1, round_even(t * (scale / 100.0), 0)) AS kept FROM o, sc),
th AS (SELECT DISTINCT scale, unnest([node1, node2]) AS node FROM k WHERE kept), ls AS (SELECT scale, node FROM sc, (SELECT DISTINCT node FROM n) EXCEPT SELECT scale, node FROM th),
c AS (SELECT scale, node, edge_id FROM k, unnest([node1, node2]) u(node) WHERE NOT kept), rs AS (SELECT DISTINCT scale, edge_id FROM (SELECT c.scale, c.node, min(edge_id) AS edge_id FROM c JOIN ls ON ls.scale = c.scale AND ls.node = c.node GROUP BY 1, 2)),
f AS (SELECT k.*, rs.edge_id IS NOT NULL AS rescued FROM k LEFT JOIN rs ON rs.scale = k.scale AND rs.edge_id = k.edge_id WHERE kept OR rs.edge_id IS NOT NULL)"""
_PAIRS = "lp AS (SELECT DISTINCT pair_id, relation, split, label, source FROM eval_pairs JOIN (SELECT DISTINCT run_id, source FROM seccion12_tabla_completa) USING (run_id))"
_LADDER = f"""m AS (SELECT {_GENE} AS key, {_REAL.format('uniprot_accession')} AS value, coalesce(starts_with(lower(trim(estado_mapeo)), 'mapeado_revisado'), false) AS rv, coalesce(uniprot_has_embedding, false) AS hv FROM gen_id_mapping_table WHERE {_NUMBER.format('graph_node_id')} IS NOT NULL),
a AS (SELECT key, count(DISTINCT value) FILTER (rv) AS nr, count(DISTINCT value) FILTER (rv AND hv) AS nrv, min(value) FILTER (rv) AS vr, min(value) FILTER (rv AND hv) AS vrv, count(DISTINCT value) FILTER (NOT rv) AS nu, count(DISTINCT value) FILTER (NOT rv AND hv) AS nuv, min(value) FILTER (NOT rv) AS vu, min(value) FILTER (NOT rv AND hv) AS vuv FROM m GROUP BY 1),
b AS (SELECT key, CASE WHEN nr = 1 THEN vr WHEN nr > 1 AND nrv >= 1 THEN vrv WHEN nr > 1 THEN vr WHEN nu = 1 THEN vu WHEN nu > 1 AND nuv >= 1 THEN vuv WHEN nu > 1 THEN vu END AS value,
  CASE WHEN nr = 1 THEN 'reviewed' WHEN nr > 1 AND nrv >= 1 THEN 'reviewed_by_vector' WHEN nr > 1 THEN 'reviewed_by_order' WHEN nu = 1 THEN 'unreviewed' WHEN nu > 1 AND nuv >= 1 THEN 'unreviewed_by_vector' WHEN nu > 1 THEN 'unreviewed_by_order' ELSE 'none' END AS state FROM a),
h AS (SELECT key, value, bool_or(hv) AS hv FROM m WHERE value IS NOT NULL GROUP BY 1, 2)"""

ORACLE = {
    "component_classes": COMPONENTS + ", s AS (SELECT component, count(*) AS n FROM low GROUP BY 1), t AS (SELECT component AS giant FROM s ORDER BY n DESC, component LIMIT 1) SELECT CASE WHEN component = giant THEN 'giant' WHEN n = 1 THEN 'isolated' ELSE 'small' END AS kind, count(*) AS n_components, CAST(sum(n) AS BIGINT) AS n_nodes FROM s, t GROUP BY 1",
    "graph_profile": COMPONENTS + ", g AS (SELECT u AS node, count(*) FILTER (u <> v) AS d FROM adj GROUP BY 1) SELECT (SELECT count(*) FROM g) AS n_nodes, (SELECT count(*) FROM adj WHERE u < v) AS n_edges, (SELECT count(DISTINCT component) FROM low) AS n_components, (SELECT count(DISTINCT component) FROM low) = 1 AS is_connected, (SELECT max(d) FROM g) AS top_degree, (SELECT node FROM g ORDER BY d DESC, node LIMIT 1) AS top_node",
    "pair_stats": "SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(min(l_quantity) AS DOUBLE) AS smallest, CAST(max(l_quantity) AS DOUBLE) AS largest, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean FROM lineitem GROUP BY 1",
    "metric_pivots": "SELECT source, " + ", ".join(f"round(avg({m}) FILTER (relation = '{r}'), 6) AS {r.replace('-', '_')}_{m}" for r in PIVOTED for m in METRICS) + " FROM seccion12_tabla_completa WHERE source IS NOT NULL GROUP BY 1",
    "multiscale": f"WITH {_SCALE} SELECT f.scale, count(*) AS n_edges, (SELECT count(DISTINCT x) FROM (SELECT unnest([node1, node2]) AS x FROM f g WHERE g.scale = f.scale)) AS n_nodes, count(*) FILTER (rescued) AS n_rescued, round(100.0 * (SELECT count(DISTINCT x) FROM (SELECT unnest([node1, node2]) AS x FROM f g WHERE g.scale = f.scale)) / (SELECT count(DISTINCT node) FROM n), 4) AS pct_nodes FROM f GROUP BY 1",
    "non_edges": f"""WITH {ENDS}, p AS (SELECT DISTINCT least(node1, node2) AS n1, greatest(node1, node2) AS n2 FROM e), g AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node FROM n)), z AS (SELECT (SELECT count(*) FROM g) AS na, (SELECT count(*) FROM p) AS need),
d AS (SELECT id, {draw_sql(42, 'na', "'a'", 'id')} AS ia, {draw_sql(42, 'na', "'b'", 'id')} AS ib FROM (SELECT unnest(generate_series(0, greatest(2000, 3 * need) - 1)) AS id, na FROM z)),
f AS (SELECT least(x.node, y.node) AS n1, greatest(x.node, y.node) AS n2, min(id) AS id FROM d JOIN g x ON x.i = ia JOIN g y ON y.i = ib WHERE x.node <> y.node GROUP BY 1, 2)
SELECT n1, n2, row_number() OVER (ORDER BY id) AS place FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n1 = f.n1 AND p.n2 = f.n2) QUALIFY place <= (SELECT need FROM z)""",
    "hold_out_positives": f"WITH {_PAIRS}, q AS (SELECT DISTINCT pair_id, relation FROM lp WHERE label = 1 AND split = 'train'), r AS (SELECT relation, row_number() OVER (PARTITION BY relation ORDER BY {_md5('pair_id')}, pair_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY relation) * 0.1, 0)) AS held FROM q) SELECT relation, count(*) FILTER (NOT held) AS n_kept, count(*) FILTER (held) AS n_held FROM r GROUP BY 1",
    "unit_guards": f"WITH {_PAIRS}, c AS (SELECT relation, source, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'train' AND label = 1) AS n_pos, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM lp WHERE label IS NOT NULL GROUP BY 1, 2) SELECT *, CASE WHEN n_train < 20 THEN 'too few train pairs' WHEN n_pos < 5 THEN 'too few positives' WHEN n_train - n_pos < 5 THEN 'too few negatives' WHEN n_val < 1 THEN 'no validation' WHEN n_test < 1 THEN 'no test' ELSE 'ok' END AS verdict FROM c",
    "channel_sums": "SELECT l_suppkey, " + ", ".join(f"CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = '{x}'), 0) AS DOUBLE) AS sum_{x.lower()}" for x in "ANR") + ", CAST(sum(l_quantity) FILTER (l_returnflag IN ('A', 'N', 'R')) AS DOUBLE) AS total FROM lineitem GROUP BY 1",
    "exclusion_report": f"WITH t AS (SELECT {_GENE} AS gene, {_REAL.format('motivo_exclusion')} AS reason, coalesce(uniprot_has_embedding, false) AS u, coalesce(genept_has_embedding, false) AS g FROM gen_id_mapping_table WHERE {_NUMBER.format('graph_node_id')} IS NOT NULL), p AS (SELECT gene, coalesce(min(reason), 'mapped') AS reason, bool_or(u) AS u, bool_or(g) AS g FROM t GROUP BY 1) SELECT reason, count(*) AS n_genes, count(*) FILTER (u) AS n_uniprot, count(*) FILTER (g) AS n_genept, CAST(CASE reason WHEN 'mapped' THEN 1 ELSE 2 END AS INTEGER) AS place FROM p GROUP BY 1",
    "external_mapping": f"WITH {_LADDER} SELECT b.key AS gene, b.value AS accession, state, coalesce(hv, false) AS has_vector FROM b LEFT JOIN h ON h.key = b.key AND h.value = b.value",
    "catalog_summary": "SELECT embedding_source AS source, training_condition AS condition, seed, coalesce(node_type, 'DESCONOCIDO') AS node_type, count(DISTINCT node_id) AS n_nodes, count(embedding) AS n_vectors, count(*) FILTER (retired_at IS NULL) AS n_held, max(dimension) AS dimension FROM embedding_catalog GROUP BY 1, 2, 3, 4",
    "hin_input": f"WITH {CLEAN}, d AS (SELECT DISTINCT relation, node1, node2 FROM e), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT node1 AS node FROM d UNION SELECT node2 FROM d)) SELECT relation, x.i AS a, y.i AS b FROM d JOIN i x ON x.node = node1 JOIN i y ON y.node = node2",
    "rows_distinct": "WITH g AS (SELECT node1, node2, node1_type, node2_type, relation, database, loaded_at, count(*) AS n FROM graph_edges GROUP BY ALL) SELECT relation, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct FROM g GROUP BY 1",
}
