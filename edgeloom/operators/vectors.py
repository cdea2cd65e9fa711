"""Embedding tables (node, vec): look-ups, pair features, comparison of two spaces.

Null vectors, and vectors whose length differs from the table's dimension, are
to be dropped by ``latest_vectors``. Comparisons that look at all pairs take a
stated number of nodes, chosen by hash, as the measures they stand for do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import keyed_md5
from edgeloom.operators.edges import distinct_on
from edgeloom.plans.ranking import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def latest_vectors(catalog: DataFrame, node: Column, dimension: int = 64) -> DataFrame:
    """(source, seed, node, vec): of each node the last export's finite vector of that dimension, ties to the smaller vec_id."""
    e = F.col("embedding")
    good = catalog.filter((F.size(e) == dimension) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    rows = good.select(F.col("embedding_source").alias("source"), "seed", node.alias("node"), F.col("embedding").alias("vec"), "exported_at", "vec_id")
    last = distinct_on(rows, ["source", "seed", "node"], [-F.unix_micros(F.col("exported_at").cast("timestamp")), F.col("vec_id")])
    return last.select("source", "seed", "node", "vec")


def pair_vectors(pairs: DataFrame, vectors: DataFrame, keys: list[str], missing: str = "skip", dimension: int = 64) -> DataFrame:
    """``pairs`` (n1, n2, keys...) with a and b, the ends' vectors; pairs without one are dropped or get zeros."""
    how = {"skip": "inner", "zero": "left"}[missing]
    side = lambda end, name: vectors.select(*keys, F.col("node").alias(end), F.col("vec").alias(name))
    joined = pairs.join(side("n1", "a"), [*keys, "n1"], how).join(side("n2", "b"), [*keys, "n2"], how)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    return joined.withColumn("a", F.coalesce("a", zeros)).withColumn("b", F.coalesce("b", zeros)) if missing == "zero" else joined


#: Dimension up to which raw features hold both vectors.
RAW_UP_TO = 256


def features(a: Column, b: Column, raw: bool = False) -> Column:
    """Products, then absolute differences, then, if raw and of RAW_UP_TO values at most, both vectors."""
    parts = [F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y))]
    return F.when(F.size(a) <= RAW_UP_TO, F.concat(*parts, a, b)).otherwise(F.concat(*parts)) if raw else F.concat(*parts)


def feature_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sanity(catalog: DataFrame, group: list[str]) -> DataFrame:
    """By group: vectors, repeated nodes, null, wrongly sized, non-finite and zero ones, and the norms of the sound ones."""
    e = F.col("embedding")
    sized = F.coalesce(F.size(e) == F.col("dimension"), F.lit(False)) & e.isNotNull()
    finite = sized & F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    n = F.when(finite, norm(e))
    return catalog.groupBy(*group).agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("node_id")).alias("n_repeated"), F.count_if(e.isNull()).alias("n_null"), F.count_if(e.isNotNull() & ~sized).alias("n_missized"),
        F.count_if(sized & ~finite).alias("n_nonfinite"), F.count_if(n == 0).alias("n_zero"), F.round(F.min(n), 5).alias("min_norm"), F.round(F.max(n), 5).alias("max_norm"), F.round(F.avg(n), 5).alias("avg_norm"),
    )


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, va, vb): the nodes in both spaces."""
    return a.select("node", F.col("vec").alias("va")).join(b.select("node", F.col("vec").alias("vb")), "node")


def common_sample(a: DataFrame, b: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(node, va, vb): n of the nodes in both spaces, the first in hash order."""
    return ranked(common(a, b).withColumn("_h", keyed_md5(seed, "node")), [], ["_h", "node"], "_r").filter(F.col("_r") <= n).select("node", "va", "vb")


def sample_similarities(sample: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(x, y, sa, sb): cosines in both spaces of each x of the sample and y <> x of ``among``, else of the sample."""
    units = lambda d: d.select("node", unit(F.col("va")).alias("va"), unit(F.col("vb")).alias("vb"))
    x, y = units(sample).toDF("x", "xa", "xb"), units(sample if among is None else among).toDF("y", "ya", "yb")
    return x.join(y, F.col("x") != F.col("y")).select("x", "y", F.round(dot(F.col("xa"), F.col("ya")), 8).alias("sa"), F.round(dot(F.col("xb"), F.col("yb")), 8).alias("sb"))


def neighbour_jaccard(sims: DataFrame, ks: list[int], group: list[str] = []) -> DataFrame:
    """(group..., k, jaccard): mean overlap of the k nearest neighbours in both spaces, ties by node."""
    ra = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sa"), "y"))
    rb = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sb"), "y"))
    placed = sims.select(*group, "x", ra.alias("ra"), rb.alias("rb"))
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    each = placed.select("*", k).groupBy(*group, "k", "x").agg(F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k"))).alias("i"), F.count_if((F.col("ra") <= F.col("k")) | (F.col("rb") <= F.col("k"))).alias("u"))
    return each.groupBy(*group, "k").agg(F.round(F.avg(F.col("i") / F.col("u")), 6).alias("jaccard"))


def _units(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, va, vb) of a table's rows in the order of the names, the vectors of length one or zero."""
    names, sides = t[name].to_numpy().astype(str), []
    at = np.argsort(names)
    for c in ("va", "vb"):
        v = np.concatenate([np.asarray(p.flatten()) for p in t[c].chunks]).reshape(len(t), -1).astype(float)[at]
        n = np.sqrt((v**2).sum(1, keepdims=True))
        sides.append(v / np.where(n > 0, n, 1.0))
    return names[at], *sides


def _grid(s: np.ndarray) -> np.ndarray:
    """Similarities in steps of 1e-8, half a step up in size."""
    return (np.sign(s) * np.floor(np.abs(s) * 1e8 + 0.5)).astype(np.int64)


#: Nodes that one task compares with the sample, and similarities that it holds at once.
NODES_A_TASK = 1 << 14
HELD = 1 << 21


def nearest_parts(sample: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(pair, x, y, side, s) of two tables (pair, part, node, va, vb): in each part, the k nodes of ``nodes`` next to each sampled x in each space, ties by node; s in steps of 1e-8."""

    def near(queries: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(others):
            (x, *xs), (y, *ys) = _units(queries, "node"), _units(others, "node")
            place = np.searchsorted(y, x)
            own = np.where(y[np.minimum(place, len(y) - 1)] == x, place, -1)
            block = max(1, HELD // len(y))
            for side in range(2):
                for at in range(0, len(x), block):
                    s = _grid(xs[side][at : at + block] @ ys[side].T)
                    key = ((2 * 10**8 - s) << 24) + np.arange(len(y))
                    same = np.flatnonzero(own[at : at + block] >= 0)
                    key[same, own[at : at + block][same]] = np.iinfo(np.int64).max
                    best = np.argpartition(key, k - 1, axis=1)[:, :k] if k < len(y) else np.broadcast_to(np.arange(len(y)), key.shape)
                    row = np.repeat(np.arange(len(s)), best.shape[1])
                    best = best.ravel()
                    kept = key[row, best] != np.iinfo(np.int64).max
                    row, best = row[kept], best[kept]
                    out.append((row + at, best, np.full(len(row), side), s[row, best]))
        if not out:
            return pa.Table.from_batches([], NEAR)
        i, j, side, s = map(np.concatenate, zip(*out))
        return pa.table([pa.array([queries["pair"][0].as_py()] * len(i)), pa.array(x).take(pa.array(i)), pa.array(y).take(pa.array(j)), pa.array(side, pa.int32()), pa.array(s)], schema=NEAR)

    return sample.groupBy("pair", "part").cogroup(nodes.groupBy("pair", "part")).applyInArrow(near, "pair string, x string, y string, side int, s bigint")


NEAR = pa.schema([("pair", pa.string()), ("x", pa.string()), ("y", pa.string()), ("side", pa.int32()), ("s", pa.int64())])


def jaccard_of(near: DataFrame, ks: list[int]) -> DataFrame:
    """(pair, k, jaccard): ``neighbour_jaccard`` from rows of ``nearest_parts``."""
    own = F.row_number().over(Window.partitionBy("pair", "x", "side").orderBy(F.desc("s"), "y"))
    placed = near.withColumn("r", own).filter(F.col("r") <= max(ks))
    met = placed.groupBy("pair", "x", "y").agg(*[F.coalesce(F.min(F.when(F.col("side") == i, F.col("r"))), F.lit(max(ks) + 1)).alias(f"r{c}") for i, c in enumerate("ab")])
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    each = met.select("*", k).groupBy("pair", "k", "x").agg(F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k"))).alias("i"), F.count_if((F.col("ra") <= F.col("k")) | (F.col("rb") <= F.col("k"))).alias("u"))
    return each.groupBy("pair", "k").agg(F.round(F.avg(F.col("i") / F.col("u")), 6).alias("jaccard"))


def sample_spearman(sample: DataFrame) -> DataFrame:
    """(pair, spearman, n_pairs): ``spearman`` of all similarities within each pair's sample (pair, node, va, vb), which one task holds."""

    def of(t: pa.Table) -> pa.Table:
        _, a, b = _units(t, "node")
        upper = np.triu_indices(len(t), 1)
        ranks = []
        for v in (a, b):
            _, place, n = np.unique(_grid(v @ v.T)[upper], return_inverse=True, return_counts=True)
            ranks.append((np.cumsum(n) - (n - 1) / 2.0)[place])
        x, y = (r - r.mean() if len(r) else r for r in ranks)
        down = np.sqrt((x @ x) * (y @ y))
        return pa.table([pa.array([t["pair"][0].as_py()]), pa.array([float(x @ y / down) if down > 0 else None], pa.float64()), pa.array([len(x)], pa.int64())], names=["pair", "spearman", "n_pairs"])

    return sample.select("pair", "node", "va", "vb").groupBy("pair").applyInArrow(of, "pair string, spearman double, n_pairs bigint").withColumn("spearman", F.round("spearman", 6))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman, n): correlation of average ranks, ties sharing the mean of their places. Null values are to be dropped before."""

    def average_rank(c: str) -> DataFrame:
        return ranked(pairs.select(c), [], [c], "_r").groupBy(c).agg(((F.min("_r") + F.max("_r")) / 2.0).alias(f"_r{c}"))

    placed = pairs.join(average_rank(a), a).join(average_rank(b), b)
    return placed.agg(F.round(F.corr(f"_r{a}", f"_r{b}"), 6).alias("spearman"), F.count("*").alias("n"))


def grams(rows: DataFrame, group: str | None = None) -> dict:
    """By group: (sum of outer products, sum, count) of the vectors va and vb put one after the other.

    One pass. Tasks emit one small matrix a group, and the parts are added up
    by place with partial sums, so the driver gets one matrix a group whatever
    the number of tasks.
    """

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for k, own in pdf.groupby("k"):
                x = np.concatenate([np.stack(own["va"].to_numpy()), np.stack(own["vb"].to_numpy())], axis=1).astype(float)
                part = np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
                held[k] = held[k] + part if k in held else part
        if held:
            yield pd.DataFrame({"k": list(held), "v": [v.tolist() for v in held.values()]})

    keyed = rows.select((F.col(group) if group else F.lit(0)).cast("long").alias("k"), "va", "vb")
    parts = keyed.mapInPandas(partial, "k long, v array<double>").select("k", F.posexplode("v").alias("i", "v"))
    sums = parts.groupBy("k", "i").agg(F.sum("v").alias("v")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v")).collect()
    out = {}
    for k, v in sums:
        d = round((1 + 4 * (len(v) - 1)) ** 0.5 - 1) // 2
        out[k] = (np.array(v[: d * d]).reshape(d, d), np.array(v[d * d : -1]), int(v[-1]))
    return out


def linear_cka(both: DataFrame) -> float | None:
    """Linear CKA of two spaces over (va, vb) rows, from centred Gram matrices of the dimensions; None without rows or variance."""
    return next((cka_of(*g) for g in grams(both).values()), None)


def cka_of(g: np.ndarray, x: np.ndarray, n: int, d: int | None = None) -> float | None:
    """Linear CKA from a matrix of ``grams`` whose first d places (half of all if None) are the first space's."""
    d = len(x) // 2 if d is None else d
    c = (g - np.outer(x, x) / n) ** 2
    down = (c[:d, :d].sum() * c[d:, d:].sum()) ** 0.5
    return float(c[:d, d:].sum() / down) if down > 1e-12 else None


def ridge_r2(both: DataFrame, folds: int = 5, alpha: float = 1.0, seed: int = 42) -> tuple[float, float] | None:
    """Mean and deviation over folds of R2 of predicting vb from va by ridge; folds by hash of the node, fitted from Gram matrices only."""
    fold = F.pmod(F.conv(F.substring(keyed_md5(seed, "node"), 1, 8), 16, 10).cast("bigint"), F.lit(folds))
    return ridge_of(grams(both.withColumn("fold", fold), "fold"), alpha)


def ridge_of(parts: dict, alpha: float = 1.0, d: int | None = None) -> tuple[float, float] | None:
    """``ridge_r2`` from the folds' ``grams``; None with fewer than two folds."""
    scores = []
    for k, (t, u, m) in parts.items():
        rest = [p for j, p in parts.items() if j != k]
        if not rest:
            continue
        g, s, n = sum(p[0] for p in rest), sum(p[1] for p in rest), sum(p[2] for p in rest)
        e = len(s) // 2 if d is None else d
        w = np.linalg.solve(g[:e, :e] - np.outer(s[:e], s[:e]) / n + alpha * np.eye(e), g[:e, e:] - np.outer(s[:e], s[e:]) / n)
        c = s[e:] / n - (s[:e] / n) @ w
        # Residual and total sums of squares of each output, from the fold's own sums.
        own = np.diag(t[e:, e:])
        rss = own - 2 * (np.einsum("ij,ij->j", w, t[:e, e:]) + c * u[e:]) + np.einsum("ij,ik,kj->j", w, t[:e, :e], w) + 2 * c * (u[:e] @ w) + m * c**2
        tss = own - u[e:] ** 2 / m
        if (tss > 0).any():
            scores.append(float(np.nanmean(1 - rss / np.where(tss > 0, tss, np.nan))))
    return (float(np.mean(scores)), float(np.std(scores))) if scores else None
