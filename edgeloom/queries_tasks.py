"""Queries on the seven prediction tasks together: splits, rescue, train graph, negatives, leak checks, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import edges as E
from edgeloom.operators import graph as G
from edgeloom.operators import splits as S
from edgeloom.plans.durable import materialise
from edgeloom.queries_edges import ENDS, edges
from edgeloom.queries_graph import draw_sql

#: Relation, types of its two ends, and whether it is symmetric, in the order of the rescue.
TASKS = [
    ("GEN-ass-DIS", "GEN", "DIS", False), ("GEN-ass-TIS", "GEN", "TIS", False), ("GEN-ass-PWY", "GEN", "PWY", False), ("CPD-trt-DIS", "CPD", "DIS", False),
    ("CPD-int-GEN", "CPD", "GEN", False), ("GEN-ppi-GEN", "GEN", "GEN", True), ("CLL-mut-GEN", "CLL", "GEN", False),
]
#: Negatives a positive of each split.
NEGATIVES = {"train": 1, "val": 1, "test": 10}
SPLITS = ("train", "val", "test")


def tasks(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(TASKS)]
    return spark.createDataFrame(rows, "ord int, task string, t1 string, t2 string, symmetric boolean")


def task_edges(e: DataFrame) -> DataFrame:
    """(task, n1, n2): the distinct pairs of each task, the end of its first type first, or in byte order if it is symmetric.

    Where both types are missing, a gene is told by its id; else the pair stands as it is.
    """
    gene = lambda c: F.col(c).startswith("ensg")
    by_id = ((F.col("t1") == "GEN") & gene("node2") & ~gene("node1")) | ((F.col("t2") == "GEN") & gene("node1") & ~gene("node2"))
    swap = F.when(F.col("symmetric"), F.col("node1") > F.col("node2")).otherwise((F.col("node1_type") == F.col("t2")) | (F.col("node2_type") == F.col("t1")) | by_id)
    rows = e.join(F.broadcast(tasks(e.sparkSession)), F.col("relation") == F.col("task"))
    return rows.select("task", F.when(swap, F.col("node2")).otherwise(F.col("node1")).alias("n1"), F.when(swap, F.col("node1")).otherwise(F.col("node2")).alias("n2")).distinct()


class Built:
    """The tables of all tasks' splits; each is written once when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.edges = materialise(edges(spark, sf_dir).select("node1", "node2", "node1_type", "node2_type", "relation"), "edges")
        self.first = materialise(S.split_tasks(task_edges(self.edges), self.edges), "splits")

    def rescued(self) -> DataFrame:
        """(task, n1, n2, protected, split) after held-out pairs returned to train so that no node loses its last edge."""
        held = self.first.filter("split <> 'train'")
        train = E.exclude_pairs(self.edges, held.withColumnRenamed("task", "relation")).select(F.col("node1").alias("n1"), F.col("node2").alias("n2"))
        ords = tasks(self.edges.sparkSession).select("task", "ord")
        order = F.col("ord") * 2 + F.when(F.col("split") == "test", 1).otherwise(0)
        back = S.rescue(held.join(ords, "task").select(order.alias("ord"), "n1", "n2"), train, E.ends(self.edges))
        back = back.withColumn("o", F.floor(F.col("ord") / 2).cast("int")).join(ords.withColumnRenamed("ord", "o"), "o").select("task", "n1", "n2", F.lit(True).alias("_back"))
        split = F.when(F.col("_back"), "train").otherwise(F.col("split"))
        return materialise(self.first.join(back, ["task", "n1", "n2"], "left").select("task", "n1", "n2", "protected", split.alias("split")), "rescued")

    def train_graph(self, rescued: DataFrame) -> DataFrame:
        """The edges without any task's held-out pairs."""
        return E.exclude_pairs(self.edges, rescued.filter("split <> 'train'").withColumnRenamed("task", "relation"))

    def negatives(self) -> DataFrame:
        """(task, n1, n2, split): negatives of each task by the counts of its first splits."""
        counts = {(r.task, r.split): r["count"] for r in self.first.groupBy("task", "split").count().collect()}
        nodes = materialise(E.ends(self.edges).distinct(), "nodes")
        held = {t: S.universe(nodes.filter(F.col("node_type") == t).select("node")) for t in sorted({t for task in TASKS for t in task[1:3]})}
        out = []
        for task, t1, t2, symmetric in TASKS:
            bounds = [NEGATIVES[s] * counts.get((task, s), 0) for s in SPLITS]
            own = S.negatives_among(held[t1], held[t2], self.first.filter(F.col("task") == task), sum(bounds), symmetric)
            split = F.when(F.col("place") <= bounds[0], "train").when(F.col("place") <= bounds[0] + bounds[1], "val").otherwise("test")
            out.append(own.select(F.lit(task).alias("task"), "n1", "n2", split.alias("split")))
        return materialise(reduce(lambda a, b: a.unionByName(b), out), "negatives")


def _train_graph(s, d):
    """(relation, n_edges) of the train graph of all tasks, after the rescue."""
    b = Built(s, d)
    return b.train_graph(b.rescued()).groupBy("relation").agg(F.count("*").alias("n_edges"))


def _checks(s, d):
    """(check, n, ok): of each task, pairs in two splits, positives among its negatives, negatives in two splits and protected pairs held out; and nodes or lone components that the train graph lost."""
    b = Built(s, d)
    rescued = b.rescued()
    per = S.task_leak_checks(tasks(s).select("task"), rescued, b.negatives())
    left = materialise(E.closure(b.train_graph(rescued)), "left")
    nodes = E.ends(b.edges).select("node").distinct()
    lost = nodes.join(left.select("node").distinct(), "node", "left_anti").agg(F.count("*").alias("n"))
    lone = left.groupBy("node").agg(F.max(F.col("node") != F.col("nbr")).alias("linked")).agg(F.count_if(~F.col("linked")).alias("m"))
    # A node that has nothing but a loop in the whole graph was alone before.
    before = E.closure(b.edges).groupBy("node").agg(F.max(F.col("node") != F.col("nbr")).alias("linked")).agg(F.count_if(~F.col("linked")).alias("k"))
    graph = lost.crossJoin(lone).crossJoin(before).select(F.lit("graph: nodes lost").alias("check"), (F.col("n") + F.greatest(F.lit(0), F.col("m") - F.col("k"))).alias("n"))
    return per.unionByName(graph).withColumn("ok", F.col("n") == 0)


def _summary(s, d):
    """One row a task: its positives, those protected, and positives and negatives by split."""
    b = Built(s, d)
    pos = b.rescued().groupBy("task").agg(F.count("*").alias("n_total_pos"), F.count_if("protected").alias("n_protected"), *[F.count_if(F.col("split") == x).alias(f"n_{x}") for x in SPLITS])
    neg = b.negatives().groupBy("task").agg(*[F.count_if(F.col("split") == x).alias(f"n_neg_{x}") for x in SPLITS])
    return tasks(s).select("task").join(pos, "task", "left").join(neg, "task", "left").na.fill(0)


def _connectivity(s, d):
    """(n_nodes, n_components, n_largest) of the train graph of all tasks."""
    b = Built(s, d)
    sizes = G.connected_components(materialise(E.closure(b.train_graph(b.rescued())), "closure")).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("n_largest"))


QUERIES = {
    "task_splits": lambda s, d: Built(s, d).rescued(),
    "task_negatives": lambda s, d: Built(s, d).negatives(),
    "task_train_graph": _train_graph,
    "task_leak_checks": _checks,
    "task_summary": _summary,
    "task_connectivity": _connectivity,
}


def _md5(*c: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in c) + "))"


_VALUES = ", ".join(f"({i}, '{t}', '{a}', '{b}', {str(s).lower()})" for i, (t, a, b, s) in enumerate(TASKS))
_PAIRS = f"""{ENDS}, tk AS (SELECT * FROM (VALUES {_VALUES}) v(ord, task, t1, t2, sym)),
te AS (SELECT task, node1, node2, CASE WHEN sym THEN node1 > node2 ELSE node1_type = t2 OR node2_type = t1 OR (t1 = 'GEN' AND starts_with(node2, 'ensg') AND NOT starts_with(node1, 'ensg')) OR (t2 = 'GEN' AND starts_with(node1, 'ensg') AND NOT starts_with(node2, 'ensg')) END AS swap FROM e JOIN tk ON task = relation),
tp AS (SELECT DISTINCT task, CASE WHEN swap THEN node2 ELSE node1 END AS n1, CASE WHEN swap THEN node1 ELSE node2 END AS n2 FROM te),
rowdeg AS (SELECT node, count(*) AS d FROM n GROUP BY 1),
pr AS (SELECT task, n1, n2, a.d = 1 OR b.d = 1 AS protected FROM tp JOIN rowdeg a ON a.node = n1 JOIN rowdeg b ON b.node = n2),
od AS (SELECT *, row_number() OVER (PARTITION BY task, protected ORDER BY {_md5('n1', 'n2')}, n1, n2) AS r, count(*) OVER (PARTITION BY task) AS total FROM pr),
sp AS MATERIALIZED (SELECT task, n1, n2, protected, CASE WHEN protected THEN 'train' WHEN r <= round_even(total * 0.1, 0) THEN 'val' WHEN r <= round_even(total * 0.1, 0) + round_even(total * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM od),
h0 AS (SELECT task, n1, n2, least(n1, n2) AS a, greatest(n1, n2) AS b, 2 * ord + CASE WHEN split = 'test' THEN 1 ELSE 0 END AS o FROM sp JOIN tk USING (task) WHERE split <> 'train'),
there AS (SELECT DISTINCT unnest([node1, node2]) AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE task = relation AND a = least(node1, node2) AND b = greatest(node1, node2))),
st AS (SELECT DISTINCT node FROM n WHERE node NOT IN (SELECT node FROM there)),
bk AS (SELECT DISTINCT task, n1, n2 FROM (SELECT node, task, n1, n2, o FROM h0, unnest([n1, n2]) u(node) WHERE node IN (SELECT node FROM st)) QUALIFY row_number() OVER (PARTITION BY node ORDER BY o, n1, n2) = 1),
fs AS MATERIALIZED (SELECT task, n1, n2, protected, CASE WHEN bk.task IS NOT NULL THEN 'train' ELSE split END AS split FROM sp LEFT JOIN bk USING (task, n1, n2)),
hd AS (SELECT task, least(n1, n2) AS a, greatest(n1, n2) AS b FROM fs WHERE split <> 'train'),
tg AS MATERIALIZED (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM hd WHERE task = relation AND a = least(node1, node2) AND b = greatest(node1, node2)))"""


def _negatives_sql() -> str:
    out = [f"un AS MATERIALIZED (SELECT node_type AS t, node, row_number() OVER (PARTITION BY node_type ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node_type, node FROM n)), sz AS MATERIALIZED (SELECT t, count(*) AS n FROM un GROUP BY 1), ct AS MATERIALIZED (SELECT task, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, count(*) FILTER (split = 'test') * 10 AS c FROM sp GROUP BY 1)"]
    for i, (task, t1, t2, sym) in enumerate(TASKS):
        pair = ("least(x.node, y.node)", "greatest(x.node, y.node)") if sym else ("x.node", "y.node")
        out.append(f"""d{i} AS (SELECT id, {draw_sql(42, 'na', "'a'", 'id')} AS ia, {draw_sql(42, 'nb', "'b'", 'id')} AS ib FROM (SELECT unnest(generate_series(0, greatest(2000, 12 * (a + b + c)) - 1)) AS id, (SELECT n FROM sz WHERE t = '{t1}') AS na, (SELECT n FROM sz WHERE t = '{t2}') AS nb FROM ct WHERE task = '{task}')),
f{i} AS (SELECT {pair[0]} AS n1, {pair[1]} AS n2, min(id) AS id FROM d{i} JOIN un x ON x.t = '{t1}' AND x.i = ia JOIN un y ON y.t = '{t2}' AND y.i = ib WHERE x.node <> y.node GROUP BY 1, 2),
g{i} AS (SELECT '{task}' AS task, n1, n2, row_number() OVER (ORDER BY id) AS place FROM f{i} WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.task = '{task}' AND sp.n1 = f{i}.n1 AND sp.n2 = f{i}.n2))""")
    union = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(TASKS)))
    return ",\n".join(out) + f",\nng AS MATERIALIZED (SELECT task, n1, n2, CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'val' ELSE 'test' END AS split FROM ({union}) JOIN ct USING (task) WHERE place <= a + b + c)"


_NEG = _negatives_sql()
_COUNTS = ", ".join(f"count(*) FILTER (split = '{x}') AS {{}}{x}" for x in SPLITS)
_MET = """fm AS (SELECT task, n1, n2, count(DISTINCT split) FILTER (k = 0) AS s, bool_or(k = 0) AS p, count(DISTINCT split) FILTER (k = 1) AS m, bool_or(k = 1) AS q FROM (SELECT task, n1, n2, split, 0 AS k FROM fs UNION ALL SELECT task, n1, n2, split, 1 FROM ng) GROUP BY 1, 2, 3),
pc AS (SELECT task, count(*) FILTER (s > 1) AS a, count(*) FILTER (p AND q) AS b, count(*) FILTER (m > 1) AS c FROM fm GROUP BY 1),
qc AS (SELECT task, count(*) FILTER (protected AND split <> 'train') AS d FROM fs GROUP BY 1),
tn AS (SELECT node1 AS u, node2 AS v FROM tg UNION SELECT node2, node1 FROM tg), al AS (SELECT node1 AS u, node2 AS v FROM e UNION SELECT node2, node1 FROM e),
gr AS (SELECT (SELECT count(*) FROM (SELECT node FROM n EXCEPT SELECT u FROM tn)) + greatest(0, (SELECT count(*) FROM (SELECT u FROM tn GROUP BY 1 HAVING bool_and(u = v))) - (SELECT count(*) FROM (SELECT u FROM al GROUP BY 1 HAVING bool_and(u = v)))) AS n),
ck AS (SELECT tk.task || ': ' || unnest(['positives in two splits', 'positives among negatives', 'negatives in two splits', 'protected held out']) AS "check", unnest([coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0)]) AS n FROM tk LEFT JOIN pc USING (task) LEFT JOIN qc USING (task) UNION ALL SELECT 'graph: nodes lost', n FROM gr)"""

ORACLE = {
    "task_splits": f"WITH {_PAIRS} SELECT * FROM fs",
    "task_negatives": f"WITH {_PAIRS}, {_NEG} SELECT * FROM ng",
    "task_train_graph": f"WITH {_PAIRS} SELECT relation, count(*) AS n_edges FROM tg GROUP BY 1",
    "task_leak_checks": f'WITH {_PAIRS}, {_NEG}, {_MET} SELECT "check", n, n = 0 AS ok FROM ck',
    "task_summary": f"WITH {_PAIRS}, {_NEG}, p AS (SELECT task, count(*) AS n_total_pos, count(*) FILTER (protected) AS n_protected, {_COUNTS.format(*['n_'] * 3)} FROM fs GROUP BY 1), q AS (SELECT task, {_COUNTS.format(*['n_neg_'] * 3)} FROM ng GROUP BY 1) SELECT tk.task, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["n_total_pos", "n_protected", *[f"n_{x}" for x in SPLITS], *[f"n_neg_{x}" for x in SPLITS]])
    + " FROM tk LEFT JOIN p USING (task) LEFT JOIN q USING (task)",
}
