"""Queries on the edge table: sets, aggregates, degrees, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.text import alnum_key
from edgeloom.operators import edges as E
from edgeloom.session import table

#: The node types of the domain.
TYPES = ["CLL", "CPD", "DIS", "GEN", "PWY", "TIS"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edge_table(table(spark, sf_dir, "graph_edges"))


def _stats(s, d):
    degrees = E.degree_rows(edges(s, d))
    return degrees.agg(
        F.count("*").alias("n_nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"),
        F.round(F.stddev_samp("degree"), 6).alias("std_degree"), F.median("degree").alias("median_degree"),
    )


def _percentiles(s, d):
    """(p, degree): exact percentiles of the degree, interpolated and truncated."""
    marks = [50, 75, 90, 95, 99]
    q = E.degree_rows(edges(s, d)).agg(F.percentile("degree", [m / 100 for m in marks]).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*map(F.lit, marks)).alias("p"), "q")).alias("z")).select(F.col("z.p").alias("p"), F.floor("z.q").alias("degree"))


def _coverage_by_type(s, d):
    nodes = E.ends(edges(s, d)).select("node", "node_type")
    held = table(s, d, "embedding_catalog").filter("retired_at IS NULL").select(alnum_key("node_id").alias("node"))
    return E.coverage(nodes, held, "node", "node_type")


def _coverage_by_relation(s, d):
    nodes = E.ends(edges(s, d), "relation").select("node", "relation")
    held = table(s, d, "embedding_catalog").filter("retired_at IS NULL").select(alnum_key("node_id").alias("node"))
    return E.coverage(nodes, held, "node", "relation")


def _first_edge(s, d):
    e = edges(s, d).select("edge_id", "relation", "node1", "node2", "database")
    return E.distinct_on(e, ["relation", "node1", "node2"], [F.col("edge_id")])


def _incongruent(s, d):
    e = edges(s, d)
    up, down, both = E.incongruent(e.filter("relation = 'GEN-upr-TIS'"), e.filter("relation = 'GEN-dwr-TIS'"), ["node1", "node2"])
    return E.union_all([x.withColumn("side", F.lit(n)) for x, n in ((up, "up"), (down, "down"), (both, "both"))]).groupBy("side").agg(F.count("*").alias("n_pairs"))


def _stranded(s, d):
    e = edges(s, d)
    return E.ends(e).select("node").distinct().join(E.ends(E.drop_relations(e, ["GEN-ass-DIS", "DIS-syn-DIS"])).select("node").distinct(), "node", "left_anti")


def _tagged(s, d):
    orders = E.tag_relation(table(s, d, "orders"), "o_custkey", "o_orderkey", "CUS", "ORD", "CUS-plc-ORD", "orders")
    lines = E.tag_relation(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "ORD", "PRT", "ORD-has-PRT", "lineitem")
    supplied = E.tag_relation(table(s, d, "lineitem"), "l_suppkey", "l_partkey", "SUP", "PRT", "SUP-sup-PRT", "lineitem")
    return E.summary(E.union_all([orders, lines, supplied]).distinct())


def _common_keys(s, d):
    e = edges(s, d)
    a = E.ends(e.filter("relation = 'GEN-ppi-GEN'")).select("node").distinct()
    return a.intersect(E.ends(e.filter("relation = 'GEN-ass-DIS'")).select("node").distinct())


def _dominant(s, d):
    """By node type: the node named by most edges, with its distinct relations and databases."""
    per = E.ends(edges(s, d), "relation", "database").groupBy("node_type", "node").agg(F.count("*").alias("n"), F.countDistinct("relation").alias("n_relations"), F.countDistinct("database").alias("n_databases"))
    return E.distinct_on(per, ["node_type"], [-F.col("n"), F.col("node")])


QUERIES = {
    "edges_build": _tagged,
    "edges_summary": lambda s, d: E.summary(edges(s, d)),
    "edges_db_totals": lambda s, d: E.totals(edges(s, d)),
    "graph_stats": lambda s, d: E.graph_metrics(edges(s, d)),
    "node_universe": lambda s, d: E.node_universe(edges(s, d)),
    "nodes_by_relation": lambda s, d: E.nodes_by_group(edges(s, d), "database", "relation"),
    "type_matrix": lambda s, d: E.type_matrix(edges(s, d), [*TYPES, E.UNKNOWN]),
    "degree_rows": lambda s, d: E.degree_rows(edges(s, d)),
    "degree_distinct": lambda s, d: E.degree_distinct(edges(s, d)),
    "degree_stats": _stats,
    "degree_percentiles": _percentiles,
    "dup_audit": lambda s, d: E.duplicate_audit(edges(s, d)),
    "symmetry_pct": lambda s, d: E.symmetry(edges(s, d)),
    "source_overlap": lambda s, d: E.source_overlap(edges(s, d)),
    "coverage_by_type": _coverage_by_type,
    "coverage_by_relation": _coverage_by_relation,
    "canonical_pairs": lambda s, d: E.canonical(edges(s, d).filter("node1 <> node2"), "relation").distinct(),
    "distinct_on_first": _first_edge,
    "set_incongruent": _incongruent,
    "set_except_stranded": _stranded,
    "set_intersect_nodes": _common_keys,
    "dominant_node": _dominant,
}

def alnum(c: str) -> str:
    """``alnum_key`` in DuckDB."""
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"


CLEAN = f"""e AS (SELECT * FROM (SELECT edge_id, {alnum('node1')} AS node1, {alnum('node2')} AS node2, coalesce(node1_type, 'DESCONOCIDO') AS node1_type, coalesce(node2_type, 'DESCONOCIDO') AS node2_type,
  relation, {alnum('database')} AS database FROM graph_edges) WHERE node1 <> '' AND node2 <> '')"""
ENDS = CLEAN + ", n AS (SELECT node1 AS node, node1_type AS node_type, relation, database FROM e UNION ALL SELECT node2, node2_type, relation, database FROM e)"
_ADJ = CLEAN + ", adj AS (SELECT node1 AS node, node2 AS nbr FROM e UNION SELECT node2, node1 FROM e)"
_HELD = f"held AS (SELECT DISTINCT {alnum('node_id')} AS node FROM embedding_catalog WHERE retired_at IS NULL)"
_COVER = """, u AS (SELECT DISTINCT node, {g} FROM n) SELECT {g}, count(*) AS n_total, count(h.node) AS n_covered, round(100.0 * count(h.node) / nullif(count(*), 0), 2) AS pct FROM u LEFT JOIN held h USING (node) GROUP BY 1"""

ORACLE = {
    "edges_build": """WITH t AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS node1, CAST(o_orderkey AS VARCHAR) AS node2, 'CUS' AS node1_type, 'ORD' AS node2_type, 'CUS-plc-ORD' AS relation, 'orders' AS database FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL
  UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), 'ORD', 'PRT', 'ORD-has-PRT', 'lineitem' FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL
  UNION ALL SELECT DISTINCT CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR), 'SUP', 'PRT', 'SUP-sup-PRT', 'lineitem' FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL)
SELECT database, relation, count(*) AS total_edges, count(DISTINCT node1) AS unique_node1, count(DISTINCT node2) AS unique_node2, min(node1_type) AS node1_type, min(node2_type) AS node2_type FROM t GROUP BY 1, 2""",
    "edges_summary": f"WITH {CLEAN} SELECT database, relation, count(*) AS total_edges, count(DISTINCT node1) AS unique_node1, count(DISTINCT node2) AS unique_node2, min(node1_type) AS node1_type, min(node2_type) AS node2_type FROM e GROUP BY 1, 2",
    "edges_db_totals": f"WITH {CLEAN} SELECT database, relation, count(*) AS total_edges FROM e GROUP BY GROUPING SETS ((database, relation), (database))",
    "graph_stats": f"""WITH {ENDS} SELECT 'total_edges' AS metric, count(*) AS value FROM e UNION ALL SELECT 'databases', count(DISTINCT database) FROM e UNION ALL SELECT 'relations', count(DISTINCT relation) FROM e
UNION ALL SELECT 'nodes', count(DISTINCT node) FROM n UNION ALL SELECT 'node_types', count(DISTINCT node_type) FROM n""",
    "node_universe": f"WITH {ENDS} SELECT node_type, count(DISTINCT node) AS n_nodes FROM n GROUP BY 1",
    "nodes_by_relation": f"WITH {ENDS} SELECT database, relation, count(DISTINCT node) AS n_nodes FROM n GROUP BY 1, 2",
    "type_matrix": f"""WITH {CLEAN}, p AS (SELECT node1_type AS a, node2_type AS b FROM e UNION ALL SELECT node2_type, node1_type FROM e WHERE node1_type <> node2_type)
SELECT a AS node_type, {", ".join(f"count(*) FILTER (b = '{t}') AS {t}" for t in [*TYPES, E.UNKNOWN])} FROM p GROUP BY 1""",
    "degree_rows": f"WITH {ENDS} SELECT node, count(*) AS degree FROM n GROUP BY 1",
    "degree_distinct": f"WITH {_ADJ} SELECT node, count(*) AS degree FROM adj GROUP BY 1",
    "degree_stats": f"""WITH {ENDS}, g AS (SELECT node, count(*) AS degree FROM n GROUP BY 1)
SELECT count(*) AS n_nodes, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, round(stddev_samp(degree), 6) AS std_degree, median(degree) AS median_degree FROM g""",
    "degree_percentiles": f"""WITH {ENDS}, g AS (SELECT node, count(*) AS degree FROM n GROUP BY 1), q AS (SELECT unnest([50, 75, 90, 95, 99]) AS p, unnest(quantile_cont(degree, [0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM g)
SELECT p, CAST(floor(v) AS BIGINT) AS degree FROM q""",
    "dup_audit": f"WITH {CLEAN} SELECT relation, count(*) AS n_rows, count(*) - count(DISTINCT (node1, node2, node1_type, node2_type, relation, database)) AS n_duplicates FROM e GROUP BY 1",
    "symmetry_pct": f"""WITH {CLEAN}, p AS (SELECT DISTINCT relation, node1, node2 FROM e)
SELECT a.relation, count(*) AS n_pairs, round(100.0 * count(b.node1) / count(*), 4) AS symmetry_pct FROM p a LEFT JOIN p b ON a.relation = b.relation AND a.node1 = b.node2 AND a.node2 = b.node1 GROUP BY 1""",
    "source_overlap": f"""WITH {CLEAN}, p AS (SELECT DISTINCT relation, database, least(node1, node2) AS a, greatest(node1, node2) AS b FROM e), s AS (SELECT relation, database, count(*) AS n FROM p GROUP BY 1, 2),
t AS (SELECT x.relation, x.database AS database_a, y.database AS database_b, x.n AS n_a, y.n AS n_b FROM s x JOIN s y ON x.relation = y.relation AND x.database < y.database),
o AS (SELECT x.relation, x.database AS database_a, y.database AS database_b, count(*) AS n FROM p x JOIN p y ON x.relation = y.relation AND x.a = y.a AND x.b = y.b AND x.database < y.database GROUP BY 1, 2, 3)
SELECT t.*, coalesce(o.n, 0) AS n_shared, round(100.0 * coalesce(o.n, 0) / least(n_a, n_b), 4) AS pct_of_smaller FROM t LEFT JOIN o USING (relation, database_a, database_b)""",
    "coverage_by_type": f"WITH {ENDS}, {_HELD}" + _COVER.format(g="node_type"),
    "coverage_by_relation": f"WITH {ENDS}, {_HELD}" + _COVER.format(g="relation"),
    "canonical_pairs": f"WITH {CLEAN} SELECT DISTINCT relation, least(node1, node2) AS n1, greatest(node1, node2) AS n2 FROM e WHERE node1 <> node2",
    "distinct_on_first": f"WITH {CLEAN} SELECT DISTINCT ON (relation, node1, node2) relation, node1, node2, edge_id, database FROM e ORDER BY relation, node1, node2, edge_id",
    "set_incongruent": f"""WITH {CLEAN}, u AS (SELECT DISTINCT node1, node2 FROM e WHERE relation = 'GEN-upr-TIS'), w AS (SELECT DISTINCT node1, node2 FROM e WHERE relation = 'GEN-dwr-TIS')
SELECT side, count(*) AS n_pairs FROM (SELECT 'up' AS side, * FROM (SELECT * FROM u EXCEPT SELECT * FROM w) UNION ALL SELECT 'down', * FROM (SELECT * FROM w EXCEPT SELECT * FROM u) UNION ALL SELECT 'both', * FROM (SELECT * FROM u INTERSECT SELECT * FROM w)) GROUP BY 1""",
    "set_except_stranded": f"WITH {ENDS} SELECT node FROM n EXCEPT SELECT node FROM n WHERE relation NOT IN ('GEN-ass-DIS', 'DIS-syn-DIS')",
    "set_intersect_nodes": f"WITH {ENDS} SELECT node FROM n WHERE relation = 'GEN-ppi-GEN' INTERSECT SELECT node FROM n WHERE relation = 'GEN-ass-DIS'",
    "dominant_node": f"""WITH {ENDS}, p AS (SELECT node_type, node, count(*) AS n, count(DISTINCT relation) AS n_relations, count(DISTINCT database) AS n_databases FROM n GROUP BY 1, 2)
SELECT DISTINCT ON (node_type) node_type, node, n, n_relations, n_databases FROM p ORDER BY node_type, n DESC, node""",
}
