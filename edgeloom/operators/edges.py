"""The typed edge table: tagging, cleaning, set operations and aggregates.

Edges are rows of ``node1, node2, node1_type, node2_type, relation, database``.
Every function here is one declarative plan; the optimiser prunes and pushes.
Nulls: an edge without one of its ends is no edge and is dropped by
``edge_table``; a null type is DESCONOCIDO. Empty tables give empty results
(or one row of zeros for global totals). Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import alnum_key

UNKNOWN = "DESCONOCIDO"
EDGE_COLUMNS = ["node1", "node2", "node1_type", "node2_type", "relation", "database"]


def tag_relation(pairs: DataFrame, n1: str, n2: str, node1_type: str, node2_type: str, relation: str, database: str) -> DataFrame:
    """Pairs of one source as edges: renamed, as strings, tagged, null ends dropped."""
    return pairs.select(
        F.col(n1).cast("string").alias("node1"), F.col(n2).cast("string").alias("node2"), F.lit(node1_type).alias("node1_type"),
        F.lit(node2_type).alias("node2_type"), F.lit(relation).alias("relation"), F.lit(database).alias("database"),
    ).na.drop(subset=["node1", "node2"])


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All parts, one after the other, by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def edge_table(raw: DataFrame) -> DataFrame:
    """Cleaned edges, with ``edge_id`` if there is one.

    Ends and database are written as their letters and digits in lower case,
    so that spellings of one identifier are one node; an edge with an end that
    is null or has none is dropped. A null type is DESCONOCIDO.
    """
    ids = ["edge_id"] if "edge_id" in raw.columns else []
    rows = raw.select(
        *ids, alnum_key("node1").alias("node1"), alnum_key("node2").alias("node2"), F.coalesce("node1_type", F.lit(UNKNOWN)).alias("node1_type"),
        F.coalesce("node2_type", F.lit(UNKNOWN)).alias("node2_type"), "relation", alnum_key("database").alias("database"),
    )
    return rows.filter("node1 <> '' AND node2 <> ''")


def ends(edges: DataFrame, *keep: str | Column) -> DataFrame:
    """(keep..., node, node_type): both ends of each edge, without a second scan."""
    both = F.explode(F.array(F.struct(F.col("node1").alias("node"), F.col("node1_type").alias("node_type")), F.struct(F.col("node2").alias("node"), F.col("node2_type").alias("node_type"))))
    return edges.select(*keep, both.alias("_e")).select(*keep, "_e.node", "_e.node_type")


def canonical(edges: DataFrame, *keep: str) -> DataFrame:
    """(keep..., n1, n2): the pair in byte order."""
    return edges.select(*keep, F.least("node1", "node2").alias("n1"), F.greatest("node1", "node2").alias("n2"))


def summary(edges: DataFrame) -> DataFrame:
    """By database and relation: edges, distinct ends and the ends' types."""
    return edges.groupBy("database", "relation").agg(
        F.count("*").alias("total_edges"), F.countDistinct("node1").alias("unique_node1"), F.countDistinct("node2").alias("unique_node2"),
        F.min("node1_type").alias("node1_type"), F.min("node2_type").alias("node2_type"),
    )


def totals(edges: DataFrame) -> DataFrame:
    """Edges by database and relation and by database, in one pass; ``relation`` is null in a database's total."""
    sets = edges.rollup("database", "relation").agg(F.count("*").alias("total_edges"), F.grouping_id().alias("_g"))
    return sets.filter("_g < 3").drop("_g")


def graph_metrics(edges: DataFrame) -> DataFrame:
    """(metric, value) of the whole graph."""
    m = edges.agg(F.count("*").alias("total_edges"), F.countDistinct("database").alias("databases"), F.countDistinct("relation").alias("relations"))
    n = ends(edges).agg(F.countDistinct("node").alias("nodes"), F.countDistinct("node_type").alias("node_types"))
    return m.crossJoin(n).unpivot([], ["total_edges", "databases", "relations", "nodes", "node_types"], "metric", "value")


def node_universe(edges: DataFrame) -> DataFrame:
    """(node_type, n_nodes): distinct nodes of each type over both ends."""
    return ends(edges).groupBy("node_type").agg(F.countDistinct("node").alias("n_nodes"))


def nodes_by_group(edges: DataFrame, *group: str) -> DataFrame:
    """Distinct nodes over both ends by group."""
    return ends(edges, *group).groupBy(*group).agg(F.countDistinct("node").alias("n_nodes"))


def type_matrix(edges: DataFrame, types: list[str]) -> DataFrame:
    """Symmetric matrix of edge counts by the two ends' types, as one row a type; missing cells are 0."""
    half = edges.groupBy(F.least("node1_type", "node2_type").alias("a"), F.greatest("node1_type", "node2_type").alias("b")).agg(F.count("*").alias("n"))
    mirrored = half.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "n"))).otherwise(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))).alias("m")).select("m.*")
    return mirrored.groupBy(F.col("a").alias("node_type")).pivot("b", types).agg(F.sum("n")).na.fill(0)


def degree_rows(edges: DataFrame) -> DataFrame:
    """(node, degree): rows that name the node at either end; repeated edges count."""
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def closure(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """(node, nbr): both directions, distinct."""
    both = edges.select(F.explode(F.array(F.struct(F.col("node1").alias("node"), F.col("node2").alias("nbr")), F.struct(F.col("node2").alias("node"), F.col("node1").alias("nbr")))).alias("e")).select("e.*").distinct()
    return both if self_loops else both.filter("node <> nbr")


def degree_distinct(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours."""
    return closure(edges).groupBy("node").agg(F.count("*").alias("degree"))


def duplicate_audit(edges: DataFrame, keys: list[str] = EDGE_COLUMNS) -> DataFrame:
    """By relation: rows beyond the first of each key, in one grouping without an Expand."""
    groups = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.groupBy("relation").agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


def symmetry(edges: DataFrame) -> DataFrame:
    """By relation: distinct directed pairs and the share whose reverse is there too, in percent."""
    pairs = edges.select("relation", "node1", "node2").distinct()
    # Both directions of one pair meet in one group, so the self-join is one aggregation.
    met = pairs.groupBy("relation", F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).agg(F.count("*").alias("n"), F.bool_or(F.col("node1") == F.col("node2")).alias("loop"))
    both = F.when(F.col("loop") | (F.col("n") == 2), F.col("n")).otherwise(0)
    return met.groupBy("relation").agg(F.sum("n").alias("n_pairs"), F.round(100.0 * F.sum(both) / F.sum("n"), 4).alias("symmetry_pct"))


def source_overlap(edges: DataFrame) -> DataFrame:
    """For relations of several databases: undirected pairs of each two databases and those they share.

    Each pair's databases are collected (a handful a pair), so no join of edges with edges is made.
    """
    pairs = canonical(edges, "relation", "database").distinct()
    size = pairs.groupBy("relation", "database").agg(F.count("*").alias("n"))
    held = pairs.groupBy("relation", "n1", "n2").agg(F.array_sort(F.collect_set("database")).alias("dbs")).filter(F.size("dbs") > 1)
    two = held.select("relation", F.explode("dbs").alias("database_a"), "dbs").select("relation", "database_a", F.explode("dbs").alias("database_b")).filter("database_a < database_b")
    shared = two.groupBy("relation", "database_a", "database_b").agg(F.count("*").alias("n_shared"))
    a = size.select("relation", F.col("database").alias("database_a"), F.col("n").alias("n_a"))
    b = size.select("relation", F.col("database").alias("database_b"), F.col("n").alias("n_b"))
    return a.join(b, "relation").filter("database_a < database_b").join(shared, ["relation", "database_a", "database_b"], "left").na.fill(0, ["n_shared"]).withColumn(
        "pct_of_smaller", F.round(100.0 * F.col("n_shared") / F.least("n_a", "n_b"), 4)
    )


def coverage(universe: DataFrame, covered: DataFrame, key: str, group: str) -> DataFrame:
    """By group: keys, those covered, and the share in percent rounded to 2; null without keys."""
    marked = universe.select(key, group).distinct().join(covered.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return marked.groupBy(group).agg(F.count("*").alias("n_total"), F.count("_in").alias("n_covered"), F.round(100.0 * F.count("_in") / F.nullif(F.count("*"), F.lit(0)), 2).alias("pct"))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order; aggregates combine before the shuffle, so hot keys are no matter."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def exclude_pairs(edges: DataFrame, held_out: DataFrame) -> DataFrame:
    """Edges whose pair, in either direction, isn't held out in their relation."""
    key = lambda d, a, b: d.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    out = key(held_out, "n1", "n2").select("relation", "_a", "_b").distinct()
    return key(edges, "node1", "node2").join(out, ["relation", "_a", "_b"], "left_anti").select(*edges.columns)


def drop_relations(edges: DataFrame, relations: list[str]) -> DataFrame:
    """Edges without those relations; an error names a relation that isn't there."""
    there = {r[0] for r in edges.select("relation").filter(F.col("relation").isin(relations)).distinct().limit(len(relations)).collect()}
    if missing := sorted(set(relations) - there):
        raise ValueError(f"no such relation: {', '.join(missing)}")
    return edges.filter(~F.col("relation").isin(relations) | F.col("relation").isNull())


def incongruent(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct keys of the left alone, of the right alone, and of both (which contradict each other)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti"), a.join(b, keys, "left_semi")
