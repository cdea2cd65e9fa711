"""Graph operators on adjacency tables (node, nbr)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import draw
from edgeloom.operators.edges import closure
from edgeloom.plans.durable import discard, materialise
from edgeloom.plans.ranking import ranked
from edgeloom.plans.skew import join_hot

MOST_ROUNDS = 200


def neighbour_scores(adjacency: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (n1, n2, ...) with preferential attachment, common neighbours and Jaccard of the neighbourhoods.

    Pairs with an end outside the graph are dropped. Neighbours of the end
    with fewer are listed and looked up at the other, so a hub is never
    expanded: the work is the sum of the smaller degrees. Pairs should be
    distinct. A pair without common neighbours scores 0.
    """
    degree = adjacency.groupBy("node").agg(F.count("*").alias("d"))
    extra = [c for c in pairs.columns if c not in ("n1", "n2")]
    # Pairs of few nodes repeat so much that their file is a small part of what a broadcast of them takes.
    sized = pairs.hint("merge").join(degree.select(F.col("node").alias("n1"), F.col("d").alias("d1")), "n1").join(degree.select(F.col("node").alias("n2"), F.col("d").alias("d2")), "n2")
    small = F.col("d1") <= F.col("d2")
    asked = sized.select("n1", "n2", F.when(small, F.col("n1")).otherwise(F.col("n2")).alias("node"), F.when(small, F.col("n2")).otherwise(F.col("n1")).alias("other"))
    listed = asked.join(adjacency, "node").select("n1", "n2", F.col("other").alias("node"), "nbr")
    common = listed.join(adjacency, ["node", "nbr"], "left_semi").groupBy("n1", "n2").agg(F.count("*").alias("cn"))
    scored = sized.join(common, ["n1", "n2"], "left").withColumn("cn", F.coalesce("cn", F.lit(0)))
    union = F.col("d1") + F.col("d2") - F.col("cn")
    return scored.select("n1", "n2", *extra, (F.col("d1") * F.col("d2")).cast("double").alias("preferential_attachment"), F.col("cn").cast("double").alias("common_neighbors"), F.when(union > 0, F.col("cn") / union).otherwise(F.lit(0.0)).alias("jaccard"))


#: Neighbours of a row of adjacency_lists.
LIST_BLOCK = 1000


def adjacency_lists(edges: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """(node, block, nbrs): sorted distinct neighbours, self-loops left out, in blocks of that many from 0, so a hub's list is many rows."""
    placed = ranked(closure(edges, self_loops=False), ["node"], ["nbr"], "_r")
    return placed.groupBy("node", F.floor((F.col("_r") - 1) / block).cast("int").alias("block")).agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))


#: Links that one task joins; larger tables contract first.
LAST_LINKS = 200_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, to) of all links in the task, by union and find."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for links in batches:
        for a, b in zip(links["node"], links["nbr"]):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(above), "to": [top(x) for x in above]}, dtype=object)


def connected_components(adjacency: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component.

    At each level every node takes the node of the smallest hash among itself
    and its neighbours, then that one's; nodes of one choice contract, and the
    next level has the links between choices only, so links shrink with the
    levels, whose number is logarithmic in the longest path. When at most
    LAST_LINKS are left, one task joins them. The choices are composed at the
    end. Isolated nodes must come as (node, node).
    """
    loose = adjacency.groupBy("node").agg(F.max(F.col("node") != F.col("nbr")).alias("linked")).filter("NOT linked").select("node", F.col("node").alias("component"))
    links = materialise(adjacency.filter("node < nbr").select("node", "nbr"), "links")
    levels: list[DataFrame] = []
    while left := links.count():
        if left <= LAST_LINKS:
            levels.append(materialise(links.coalesce(1).mapInPandas(_joined, "node string, to string"), "joined"))
            break
        if len(levels) == MOST_ROUNDS:
            raise RuntimeError(f"links remain after {MOST_ROUNDS} levels")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))).alias("h"), F.col(c).alias("to"))
        both = links.select(F.inline(F.array(F.struct("node", "nbr"), F.struct(F.col("nbr").alias("node"), F.col("node").alias("nbr")))))
        near = materialise(both.groupBy("node").agg(F.least(F.min(rank("nbr")), F.first(rank("node"))).alias("m")).select("node", F.col("m.to").alias("to")), "near")
        chosen = materialise(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("to")), "chosen")
        discard(near)
        levels.append(chosen)
        ends = links.join(chosen, "node").select(F.col("to").alias("a"), "nbr").join(chosen.withColumnRenamed("node", "nbr"), "nbr").filter(F.col("a") != F.col("to"))
        after = materialise(ends.select(F.least("a", "to").alias("node"), F.greatest("a", "to").alias("nbr")).distinct(), "links")
        discard(links)
        links = after
    if not levels:
        return loose
    composed = levels[-1]
    for below in reversed(levels[:-1]):
        composed = below.join(composed.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    composed = materialise(composed, "composed")
    for level in levels:
        discard(level)
    discard(links)
    names = materialise(composed.groupBy("to").agg(F.min("node").alias("component"), F.count("*").alias("n")), "names")
    return join_hot(composed, names, ["to"], "n").select("node", "component").unionByName(loose)


def normalised_adjacency(adjacency: DataFrame, self_loops: bool = True) -> DataFrame:
    """(node, nbr, w): entries of D^-1/2 (A [+ I]) D^-1/2."""
    a = adjacency
    if self_loops:
        nodes = adjacency.select("node").distinct()
        a = adjacency.filter("node <> nbr").unionByName(nodes.select("node", F.col("node").alias("nbr")))
    degree = a.groupBy("node").agg(F.count("*").alias("d"))
    both = a.join(degree, "node").join(degree.select(F.col("node").alias("nbr"), F.col("d").alias("dn")), "nbr")
    return both.select("node", "nbr", (1.0 / F.sqrt(F.col("d") * F.col("dn"))).alias("w"))


def normalised_laplacian(adjacency: DataFrame) -> DataFrame:
    """(node, nbr, w): entries of I - D^-1/2 A D^-1/2, self-loops left out."""
    a = normalised_adjacency(adjacency.filter("node <> nbr"), self_loops=False).withColumn("w", -F.col("w"))
    return a.unionByName(a.select("node").distinct().select("node", F.col("node").alias("nbr"), F.lit(1.0).alias("w")))


def propagate(weights: DataFrame, features: DataFrame) -> DataFrame:
    """(node, x): one message-passing step, the weighted sum of the neighbours' feature arrays.

    Sums are by place, so partial sums combine before the shuffle; an array of
    any node's messages is never collected.
    """
    sent = weights.join(features.select(F.col("node").alias("nbr"), F.posexplode("x").alias("i", "v")), "nbr")
    sums = sent.groupBy("node", "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return sums.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))


def edge_softmax(scores: DataFrame) -> DataFrame:
    """(node, nbr, a): softmax of e over the neighbours of each node, by two aggregates and no window."""
    top = scores.groupBy("node").agg(F.max("e").alias("top"))
    up = scores.join(top, "node").withColumn("x", F.exp(F.col("e") - F.col("top")))
    total = up.groupBy("node").agg(F.sum("x").alias("total"))
    return up.join(total, "node").select("node", "nbr", (F.col("x") / F.col("total")).alias("a"))


def metapath_support(edges: DataFrame, hub: str) -> DataFrame:
    """By relation, for paths X-hub-X: edges, hubs, their degrees, instances and the largest hub's share."""
    degree = edges.groupBy("relation", hub).agg(F.countDistinct(F.col("node1") if hub == "node2" else F.col("node2")).alias("d"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return degree.groupBy("relation").agg(
        F.sum("d").alias("n_edges"), F.count("*").alias("n_hubs"), F.min("d").alias("min_degree"), F.median("d").alias("median_degree"), F.max("d").alias("max_degree"),
        F.sum(pairs).cast("bigint").alias("n_instances"), F.round(F.max(pairs) / F.nullif(F.sum(pairs), F.lit(0.0)), 6).alias("top_hub_share"),
    )


def hub_what_if(edges: DataFrame, hub: str, marks: list[int]) -> DataFrame:
    """By relation and percentile of hub degree: hubs above it, and instances kept without them."""
    degree = edges.groupBy("relation", hub).agg(F.countDistinct(F.col("node1") if hub == "node2" else F.col("node2")).alias("d"))
    cuts = degree.groupBy("relation").agg(F.percentile("d", [m / 100 for m in marks]).alias("q")).select("relation", F.explode(F.arrays_zip(F.array(*map(F.lit, marks)).alias("p"), "q")).alias("z"))
    cuts = cuts.select("relation", F.col("z.p").alias("p"), F.floor("z.q").alias("cap"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    kept = degree.join(cuts, "relation").groupBy("relation", "p", "cap").agg(
        F.count_if(F.col("d") > F.col("cap")).alias("n_excluded"), F.sum(F.when(F.col("d") <= F.col("cap"), pairs).otherwise(0)).cast("bigint").alias("n_kept"), F.sum(pairs).alias("_all")
    )
    return kept.select("relation", "p", "cap", "n_excluded", "n_kept", F.round(F.col("n_kept") / F.nullif("_all", F.lit(0.0)), 6).alias("share_kept"))


def cap_hubs(edges: DataFrame, hub: str, cap: int) -> DataFrame:
    """Edges whose hub has at most ``cap`` distinct partners in the relation."""
    other = "node1" if hub == "node2" else "node2"
    kept = edges.groupBy("relation", hub).agg(F.countDistinct(other).alias("_d")).filter(F.col("_d") <= cap).drop("_d")
    return edges.join(kept, ["relation", hub], "left_semi")


def random_walks(adjacency: DataFrame, starts: DataFrame, length: int, walks: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(walk_id, path): second-order walks, the first step uniform, then 1/p back, 1 to a common neighbour, 1/q else.

    Each draw is a hash of seed, walk and step. With p = q = 1 the neighbour
    at the drawn place is fetched; otherwise uniform places are proposed and
    kept with probability of their weight over the largest. Each link knows
    its place from the other end, so a proposal is named only if it is kept
    whatever else it is, or hangs on a common neighbour; a hub is never
    expanded. The steps are put together at the end. Walks of isolated nodes end.
    """
    even = p == 1 and q == 1
    links = materialise(ranked(adjacency.filter("node <> nbr"), ["node"], ["nbr"], "_r").select("node", "nbr", (F.col("_r") - 1).alias("i")), "placed")
    degree = materialise(links.groupBy("node").agg(F.count("*").alias("d")), "degree")
    sized = links.join(degree.select(F.col("node").alias("nbr"), F.col("d").alias("next_d")), "nbr", "left")
    back = F.lit(None).cast("bigint").alias("next_back")
    if not even:
        sized, back = sized.join(links.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), F.col("i").alias("next_back")), ["node", "nbr"], "left"), "next_back"
    placed = materialise(sized.select("node", "i", "nbr", "next_d", back), "placed")
    first = starts.select("node").distinct().join(degree, "node", "left").crossJoin(starts.sparkSession.range(walks).withColumnRenamed("id", "k"))
    state = materialise(first.select(F.concat_ws("#", "node", "k").alias("walk_id"), "node", F.lit(None).cast("string").alias("prev"), "d", F.lit(None).cast("bigint").alias("back")), "walks")
    steps = [state]
    for step in range(1, length):
        going = state.filter("d IS NOT NULL")
        if step == 1 or even:
            moved = going.withColumn("i", draw(seed, F.col("d"), F.col("walk_id"), F.lit(step))).join(placed, ["node", "i"])
        else:
            moved = _weighted_step(going, placed, step, p, q, seed)
        state = materialise(moved.select("walk_id", F.col("nbr").alias("node"), F.col("node").alias("prev"), F.col("next_d").alias("d"), F.col("next_back").alias("back")), "walks")
        steps.append(state)
    every = reduce(DataFrame.unionByName, [s.select("walk_id", F.struct(F.lit(k).alias("k"), "node").alias("s")) for k, s in enumerate(steps)])
    return every.groupBy("walk_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["node"]).alias("path"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def proposals(h: np.ndarray, d: np.ndarray, back: np.ndarray, p: float, q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(walk, t, i, sure): places proposed to each walk up to the first that is kept for sure, without those that are never kept.

    h is a walk's hash, d its node's degree, back the place it came from or
    -1. A proposal that isn't sure is kept by its kind of neighbour only.
    """
    top, low, high = max(1 / p, 1.0, 1 / q), min(1.0, 1 / q), max(1.0, 1 / q)
    left, out, t = np.arange(len(h)), [], 0
    while len(left):
        own = h[left]
        c = (_mixed(own + np.uint64((2 * t + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * (top / 2**53)
        i = (_mixed(own + np.uint64((2 * t + 2) * 0x9E3779B97F4A7C15 % 2**64)) % d[left].astype(np.uint64)).astype(np.int64)
        home = i == back[left]
        sure = np.where(home, (c < 1 / p) | (d[left] == 1), c < low)
        named = sure | (~home & (c < high))
        out.append((left[named], np.full(named.sum(), t), i[named], sure[named]))
        left, t = left[~sure], t + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0, bool))


def _weighted_step(going: DataFrame, placed: DataFrame, step: int, p: float, q: float, seed: int) -> DataFrame:
    """``going`` with nbr, one weighted neighbour each: the first proposal that is kept."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c, none: b[c].fill_null(none).to_numpy(zero_copy_only=False)
            walk, t, i, sure = proposals(column("h", 0).view(np.uint64), column("d", 0), column("back", -1), p, q)
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(walk)) for c in ("walk_id", "node", "prev")), pa.array(t, pa.int32()), pa.array(i), pa.array(sure)], ["walk_id", "node", "prev", "t", "i", "sure"])

    asked = going.select("walk_id", "node", "prev", "d", "back", F.xxhash64(F.lit(seed), "walk_id", F.lit(step)).alias("h"))
    offers = asked.mapInArrow(propose, "walk_id string, node string, prev string, t int, i bigint, sure boolean")
    common = placed.select(F.col("node").alias("prev"), "nbr", F.lit(True).alias("near"))
    # The kind that isn't sure is the likelier of common neighbours and others.
    kept = F.col("near").isNotNull() if 1 / q < 1 else F.col("near").isNull()
    # The planner can't tell how many rows come from Python.
    named = offers.hint("merge").join(placed, ["node", "i"]).join(common, ["prev", "nbr"], "left").filter(F.col("sure") | kept)
    return named.groupBy("walk_id").agg(F.min_by(F.struct("node", "nbr", "next_d", "next_back"), "t").alias("m")).select("walk_id", "m.*")


def walk_pairs(walks: DataFrame) -> DataFrame:
    """(a, b, n): consecutive nodes of walks and how often they follow each other."""
    pair = F.explode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("b")))
    return walks.filter(F.size("path") > 1).select(pair.alias("s")).groupBy("s.a", "s.b").agg(F.count("*").alias("n"))


def graph_shape(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density) of the simple undirected graph."""
    adj = closure(edges, self_loops=False)
    counts = adj.agg(F.countDistinct("node").alias("n_nodes"), (F.count("*") / 2).cast("bigint").alias("n_edges"))
    n = F.col("n_nodes")
    return counts.withColumn("density", F.round(2.0 * F.col("n_edges") / F.nullif(n * (n - 1), F.lit(0)), 8))
