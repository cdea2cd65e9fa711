"""Consolidating pairwise matches into groups, by low-diameter decomposition.

At each level every vertex draws an exponential head start; clusters grow from
the vertices in the order of their shifted starts for a few hops, each vertex
joins the cluster that reaches it first, clusters contract to super-vertices,
and the next level works on the edges between clusters. When no edge is left
the assignments are composed from the smallest level back to the vertices.
Growth is cut off after HOPS hops, sooner than the mean head start of 1 / BETA
would have it: clusters then have a radius of at most HOPS and more edges run
between them, but a level is HOPS joins and still shrinks long chains by a
constant factor, so the number of levels is logarithmic in the longest chain,
not linear as with label propagation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import uniform
from edgeloom.plans.durable import discard, materialise
from edgeloom.plans.skew import join_hot

#: Rate of the head starts: of two linked vertices, exp(-BETA) of the draws differ by more than one hop.
BETA = 0.02
#: Hops that a cluster grows before it is contracted.
HOPS = 2
MOST_LEVELS = 60


def _start(level: int, vertex: Column) -> Column:
    """The shifted start of a vertex: the negative of its exponential head start."""
    return F.log(uniform(level, vertex)) / F.lit(BETA)


def grow(edges: DataFrame, level: int, hops: int = HOPS) -> DataFrame:
    """(v, center): the cluster of each vertex of ``edges`` (u, v), which holds both directions.

    The first hop needs no join, as a start is a function of the vertex alone.
    Minima combine before the shuffle, so a vertex with many links costs one
    row a task.
    """
    state = edges.groupBy("v").agg(F.min(F.struct((_start(level, F.col("u")) + 1).alias("key"), F.col("u").alias("center"))).alias("near"))
    own = F.struct(_start(level, F.col("v")).alias("key"), F.col("v").alias("center"))
    state = state.select("v", F.least("near", own).alias("s"))
    for _ in range(hops - 1):
        sent = edges.join(state.withColumnRenamed("v", "u"), "u").select("v", F.struct((F.col("s.key") + 1).alias("key"), F.col("s.center").alias("center")).alias("s"))
        state = sent.unionByName(state).groupBy("v").agg(F.min("s").alias("s"))
    return state.select("v", F.col("s.center").alias("center"))


def match_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(group_id, node_id): every vertex of ``pairs`` and the smallest vertex, in byte order, of all linked to it.

    Rows with a null end have no part. A vertex linked only to itself is its
    own group. Repeated pairs and either direction don't matter, nor do other
    columns. An empty table gives no rows.
    """
    ends = pairs.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = ends.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    edges = materialise(both.distinct(), "links")
    levels: list[DataFrame] = []
    for level in range(MOST_LEVELS):
        assigned = materialise(grow(edges, level), "clusters")
        levels.append(assigned)
        cu, cv = assigned.select(F.col("v").alias("u"), F.col("center").alias("cu")), assigned.withColumnRenamed("center", "cv")
        between = edges.filter("u < v").join(cu, "u").join(cv, "v").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        swapped = between.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialise(swapped.distinct(), "links")
        discard(edges)
        edges = after
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"links remain after {MOST_LEVELS} levels")
    composed = levels[-1]
    for below in reversed(levels[:-1]):
        above = composed.select(F.col("v").alias("center"), F.col("center").alias("root"))
        composed = below.join(above, "center", "left").select("v", F.coalesce("root", "center").alias("center"))
    composed = materialise(composed, "composed")
    names = materialise(composed.groupBy("center").agg(F.min("v").alias("group_id"), F.count("*").alias("n")), "names")
    return join_hot(composed, names, ["center"], "n").select("group_id", F.col("v").alias("node_id"))
