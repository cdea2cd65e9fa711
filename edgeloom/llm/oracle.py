"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_NUMBER = r"nullif(regexp_extract(regexp_replace(lower({}), '[^a-z0-9.]', '', 'g'), 'ensg\.?([0-9]+)', 1), '')"
_TRIM = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{00ad}}\x{{2000}}-\x{{200f}}\x{{2060}}\x{{feff}}]+|[\s\x{{00a0}}\x{{00ad}}\x{{2000}}-\x{{200f}}\x{{2060}}\x{{feff}}]+$', '', 'g')"


def _ensg(c: str) -> str:
    return f"'ENSG' || lpad(CAST(CAST({_NUMBER.format(c)} AS BIGINT) AS VARCHAR), 11, '0')"


_GENES = f"""
WITH rows AS (
  SELECT 'go' AS benchmark, go_term AS scope_key, lower(trim(split)) AS split, {_ensg('ensg')} AS ensg FROM go_split WHERE split IS NOT NULL
  UNION ALL SELECT 'biogrid', task || '/' || CAST(outer_fold AS VARCHAR), lower(trim(fold_partition)), {_ensg('ensg_a')} FROM biogrid_split
  UNION ALL SELECT 'biogrid', task || '/' || CAST(outer_fold AS VARCHAR), lower(trim(fold_partition)), {_ensg('ensg_b')} FROM biogrid_split),
known AS (SELECT * FROM rows WHERE ensg IS NOT NULL AND scope_key IS NOT NULL AND split IS NOT NULL AND (benchmark = 'biogrid' OR split = 'holdout' OR split LIKE 'cv_fold%')),
found AS (SELECT benchmark, scope_key, ensg FROM known GROUP BY ALL HAVING bool_or(split IN ('holdout', 'outer_test')) AND bool_or(split NOT IN ('holdout', 'outer_test')))
"""

_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_EDGES = f"""
WITH cat AS (SELECT relation, bool_or(node1_type <> node2_type OR is_symmetric) AS swap FROM relation_catalog GROUP BY 1),
e AS (
  SELECT edge_id, g.relation, {_KEY.format('node1')} AS a, {_KEY.format('node2')} AS b, coalesce({_KEY.format('database')}, '') AS d,
    coalesce(swap, split_part(g.relation, '-', 1) <> split_part(g.relation, '-', -1)) AS swap
  FROM graph_edges g LEFT JOIN cat USING (relation) WHERE {_TRIM.format('node1')} <> '' AND {_TRIM.format('node2')} <> '' AND g.relation IS NOT NULL),
k AS (SELECT edge_id, relation, d, CASE WHEN swap THEN least(a, b) ELSE a END AS a, CASE WHEN swap THEN greatest(a, b) ELSE b END AS b FROM e),
g AS (SELECT edge_id, min(edge_id) OVER w AS keep_id, count(*) OVER w AS n_copies FROM k WINDOW w AS (PARTITION BY relation, a, b, d))
"""

def _real(c: str) -> str:
    return f"CASE WHEN lower({_TRIM.format(c)}) NOT IN ('', 'none', 'nan', '-', 'n/a') THEN {_TRIM.format(c)} END"


_BEST = f"""
WITH r AS (
  SELECT {_ensg('graph_node_id')} AS gene, map_id, lower({_TRIM.format('estado_mapeo')}) AS state, {_real('uniprot_accession')} AS acc, {_real('simbolo_genico')} AS sym, updated_at
  FROM gen_id_mapping_table),
t AS (SELECT *, CASE state WHEN 'mapeado_revisado' THEN 4 WHEN 'mapeado_revisado_desempate' THEN 3 WHEN 'mapeado_no_revisado' THEN 2 WHEN 'mapeado_no_revisado_desempate' THEN 1 ELSE 0 END AS trust FROM r WHERE gene IS NOT NULL),
b AS (SELECT DISTINCT ON (gene) gene, acc, state FROM t WHERE trust > 0 AND acc IS NOT NULL ORDER BY gene, trust DESC, updated_at DESC, map_id DESC),
n AS (SELECT DISTINCT ON (gene) gene, state FROM t ORDER BY gene, updated_at DESC, map_id DESC),
s AS (SELECT DISTINCT ON (gene) gene, sym FROM t WHERE sym IS NOT NULL ORDER BY gene, updated_at DESC, map_id DESC),
m AS (SELECT gene FROM t GROUP BY 1 HAVING count(*) > 1)
SELECT m.gene AS graph_node_id, coalesce(b.acc, '') AS uniprot_accession, CASE WHEN b.gene IS NOT NULL THEN b.state ELSE n.state END AS estado_mapeo, coalesce(s.sym, '') AS simbolo_genico
FROM m LEFT JOIN b USING (gene) LEFT JOIN n USING (gene) LEFT JOIN s USING (gene)"""

_GROUPS = f"""
WITH RECURSIVE p AS (SELECT DISTINCT node1 AS u, node2 AS v FROM graph_edges WHERE relation LIKE '%-syn-%' AND {_TRIM.format('node1')} <> '' AND {_TRIM.format('node2')} <> ''),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
walk(start, node) AS (SELECT u, u FROM e UNION SELECT w.start, e.v FROM walk w JOIN e ON e.u = w.node),
g AS (SELECT min(start) AS group_id, node AS node_id FROM walk GROUP BY node)
"""

_PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dp AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM d)),
ip AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (p)"""

ORACLE = {
    "p3_found": _GENES + "SELECT * FROM found",
    "p3_counts": _GENES + "SELECT benchmark, split, count(DISTINCT (scope_key, ensg)) AS n_collisions, count(*) AS n_rows FROM known SEMI JOIN found USING (benchmark, scope_key, ensg) GROUP BY ALL",
    "p4_found": _EDGES + "SELECT keep_id, edge_id AS copy_id FROM g WHERE edge_id <> keep_id",
    "p4_edges": _EDGES + "SELECT keep_id, n_copies FROM g WHERE edge_id = keep_id",
    "p5_found": _BEST,
    "p9_found": _PASSAGES,
    "p7_found": _GROUPS + "SELECT group_id, node_id FROM g",
    "p7_group_sizes": _GROUPS + ", s AS (SELECT count(*) AS n_nodes FROM g GROUP BY group_id) SELECT n_nodes, count(*) AS n_groups FROM s GROUP BY 1",
}
