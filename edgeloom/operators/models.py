"""Link classifiers and embedding producers.

Classifiers take (label, features, split) with split train, val or test; they
choose by the area under the precision-recall curve on val. Embeddings of
graphs larger than a machine come from walks and skip-gram on blocks of nodes
or from block power iteration by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import draw, uniform
from edgeloom.operators.graph import normalised_adjacency
from edgeloom.operators.metrics import average_precision
from edgeloom.operators.skip_gram import walk_vectors
from edgeloom.plans.durable import materialise

LOGISTIC_C = (1e-3, 1e-2, 1e-1, 1.0, 10.0)
SVM_C = (0.01, 0.1, 1.0, 10.0)
RBF_GAMMA = (0.001, 0.01, 0.1)
LANDMARKS = 300
IMBALANCE = 0.1


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with ``weight``: n / (2 n_class) if the positives' share of train is more than IMBALANCE off a half, else 1."""
    c = rows.filter("split = 'train'").agg(F.count("*").alias("_n"), F.sum("label").alias("_p"))
    skewed = F.abs(F.col("_p") / F.nullif("_n", F.lit(0)) - 0.5) > IMBALANCE
    own = F.when(F.col("label") == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return rows.crossJoin(c).withColumn("weight", F.coalesce(F.when(skewed, F.col("_n") / (2 * F.nullif(own, F.lit(0)))), F.lit(1.0)).cast("double")).drop("_n", "_p")


def standardised(rows: DataFrame) -> DataFrame:
    """Feature arrays as vectors scaled by the train rows' means and deviations."""
    v = rows.withColumn("raw", array_to_vector(F.col("features").cast("array<double>"))).drop("features")
    model = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v.filter("split = 'train'"))
    return model.transform(v).drop("raw")


def _score(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("rawPrediction")[1])


def _choose(rows: DataFrame, estimators: dict) -> tuple[object, object, float]:
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    best = None
    for key, est in estimators.items():
        model = est.fit(train)
        r = average_precision(_score(model, val), []).first()
        ap = r.auprc if r is not None and r.auprc is not None else 0.0
        if best is None or ap > best[2]:
            best = (key, model, ap)
    return best


#: Feature values that one task holds; the models of a larger table are fitted by all tasks together.
VALUES_A_TASK = 1 << 24


def _minimum(f: Callable, x: np.ndarray, rounds: int = 50, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """The argument of the smallest value that L-BFGS finds for ``f``, which gives value and gradient."""
    steps, (value, slope) = [], f(x)
    for _ in range(rounds):
        turn, back = slope.copy(), []
        for d, g, r in reversed(steps):
            back.append(r * (d @ turn))
            turn -= back[-1] * g
        if steps:
            d, g, _ = steps[-1]
            turn *= (d @ g) / (g @ g)
        for (d, g, r), a in zip(steps, reversed(back)):
            turn += (a - r * (g @ turn)) * d
        if turn @ slope <= 0:
            turn, steps = slope.copy(), []
        size = 1.0 if steps else min(1.0, 1.0 / max(np.linalg.norm(turn), 1e-12))
        for _ in range(30):
            after, bent = f(x - size * turn)
            if after <= value - 1e-4 * size * (turn @ slope):
                break
            size /= 2
        else:
            break
        d, g = -size * turn, bent - slope
        if d @ g > 1e-12 * (g @ g):
            steps = [*steps[1 - memory :], (d, g, 1 / (d @ g))]
        done = value - after <= tolerance * max(abs(value), abs(after), 1e-12)
        x, value, slope = x + d, after, bent
        if done:
            break
    return x


def _fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, hinge: bool) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the machine that LogisticRegression or LinearSVC fits: the penalty is on the standardised features' coefficients."""
    share = w / w.sum()
    mean = share @ x
    scale = np.sqrt(np.maximum(share @ x**2 - mean**2, 0.0) * len(x) / max(1, len(x) - 1))
    by = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 1e-9)
    z = (x - mean) * by
    sign = 2.0 * y - 1

    def loss(c: np.ndarray) -> tuple[float, np.ndarray]:
        m = sign * (z @ c[:-1] + c[-1])
        each, pull = (np.maximum(0.0, 1 - m), -(m < 1).astype(float)) if hinge else (np.logaddexp(0.0, -m), -np.exp(-np.logaddexp(0.0, m)))
        pull = share * pull * sign
        return float(share @ each + penalty / 2 * (c[:-1] @ c[:-1])), np.append(pull @ z + penalty * c[:-1], pull.sum())

    c = _minimum(loss, np.zeros(x.shape[1] + 1))
    return c[:-1] * by, float(c[-1] - (mean * by) @ c[:-1])


def _area(y: np.ndarray, score: np.ndarray) -> float:
    """``average_precision`` of arrays; 0 without positives."""
    if not (y == 1).any():
        return 0.0
    at, place = np.unique(-score, return_inverse=True)
    p, n = np.bincount(place, y == 1, len(at)), np.bincount(place, y != 1, len(at))
    tp, fp = p.cumsum(), n.cumsum()
    return round(float((p / tp[-1] * tp / (tp + fp)).sum()), 6)


def _chosen(x: np.ndarray, y: np.ndarray, w: np.ndarray, split: np.ndarray, grid, hinge: bool) -> tuple[float, float, np.ndarray]:
    """(C, val AUPRC, scores of all rows) of the best machine of the grid on val."""
    train, val, best = split == "train", split == "val", None
    for c in grid:
        a, b = _fitted(x[train], y[train], w[train], 1.0 / (c * max(1, train.sum())), hinge)
        ap = _area(y[val], x[val] @ a + b)
        if best is None or ap > best[1]:
            best = (c, ap, x @ a + b)
    return best


def _small(rows: DataFrame) -> bool:
    """Whether one task holds the features of ``rows``."""
    n, d = rows.agg(F.count("*"), F.max(F.size(vector_to_array("features")))).first()
    return 0 < n * (d or 0) <= VALUES_A_TASK


def _in_one_task(rows: DataFrame, unit: Callable, order=None) -> tuple[DataFrame, str, float]:
    """(scored rows, choice, val AUPRC) by ``unit`` (x, y, w, split, order), which fits a whole grid on the arrays of all rows."""
    keep = [c for c in rows.columns if c != "features"]
    out = rows.select(*keep, F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("_choice"), F.lit(None).cast("double").alias("_ap")).schema
    asked = rows.withColumn("_x", vector_to_array("features")).drop("features")
    asked = asked.withColumn("_o", F.lit(None).cast("string") if order is None else order(F.col("_x")))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        column = lambda c: t[c].to_numpy()
        x = np.concatenate([np.asarray(p.flatten()) for p in t["_x"].chunks]).reshape(len(t), -1)
        choice, ap, score = unit(x, column("label").astype(float), column("weight"), column("split"), column("_o"))
        done = t.drop_columns(["_x", "_o"]).append_column("score", pa.array(score)).append_column("_choice", pa.array([str(choice)] * len(t))).append_column("_ap", pa.array([float(ap)] * len(t)))
        yield from done.to_batches()

    scored = materialise(asked.repartition(1).mapInArrow(fit, out), "scored")
    first = scored.select("_choice", "_ap").first()
    return scored.drop("_choice", "_ap"), first[0], first[1]


def units_in_tasks(rows: DataFrame, units: int, unit: Callable) -> DataFrame:
    """(i, label, split, score, choice, val_auprc) of rows (i, label, split, features): each of the numbered units is balanced, standardised and fitted by ``unit`` (x, y, w, split) in a task of its own, all in one job."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        x = np.concatenate([np.asarray(p.flatten()) for p in t["features"].chunks]).reshape(len(t), -1).astype(float)
        y, split = t["label"].to_numpy().astype(float), t["split"].to_numpy()
        train = split == "train"
        n, p = train.sum(), y[train].sum()
        w = n / (2 * np.where(y == 1, p, n - p)) if abs(p / n - 0.5) > IMBALANCE else np.ones(len(y))
        scale = x[train].std(axis=0, ddof=1)
        x = (x - x[train].mean(axis=0)) * np.divide(1.0, scale, out=np.zeros_like(scale), where=scale != 0)
        choice, ap, score = unit(x, y, w, split)
        done = t.drop_columns(["features"]).append_column("score", pa.array(score)).append_column("choice", pa.array([str(choice)] * len(t))).append_column("val_auprc", pa.array([float(ap)] * len(t)))
        yield from done.to_batches()

    asked = rows.select(F.col("i").cast("int").alias("i"), F.col("label").cast("int").alias("label"), "split", "features")
    return materialise(asked.repartitionById(units, F.col("i")).mapInArrow(fit, "i int, label int, split string, score double, choice string, val_auprc double"), "scored")


def logistic_unit(x: np.ndarray, y: np.ndarray, w: np.ndarray, split: np.ndarray, grid=LOGISTIC_C) -> tuple[float, float, np.ndarray]:
    """(C, val AUPRC, scores of all rows) of the best of the grid, fitted again on train and val."""
    c, ap, _ = _chosen(x, y, w, split, grid, hinge=False)
    both = (split == "train") | (split == "val")
    a, b = _fitted(x[both], y[both], w[both], 1.0 / (c * both.sum()), hinge=False)
    return c, ap, x @ a + b


def logistic(rows: DataFrame, grid=LOGISTIC_C) -> tuple[DataFrame, float, float]:
    """(scored rows, C, val AUPRC): the best of the grid, fitted again on train and val."""
    if _small(rows):
        scored, c, ap = _in_one_task(rows, lambda x, y, w, split, _: logistic_unit(x, y, w, split, grid))
        return scored, float(c), ap
    n = max(1, rows.filter("split = 'train'").count())
    make = lambda c, m: LogisticRegression(regParam=1.0 / (c * m), weightCol="weight", maxIter=50)
    c, _, ap = _choose(rows, {c: make(c, n) for c in grid})
    both = rows.filter("split IN ('train', 'val')")
    return _score(make(c, both.count()).fit(both), rows), c, ap


def linear_svm(rows: DataFrame, grid=SVM_C) -> tuple[DataFrame, float, float]:
    """(scored rows, C, val AUPRC): the best linear SVM of the grid, fitted on train."""
    n = max(1, rows.filter("split = 'train'").count())
    c, model, ap = _choose(rows, {c: LinearSVC(regParam=1.0 / (c * n), weightCol="weight", maxIter=50) for c in grid})
    return _score(model, rows), c, ap


def _landmark_order(x: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), x.cast("string")))


def _root(z: np.ndarray, gamma: float) -> np.ndarray:
    """The inverse square root of the landmarks' kernel matrix."""
    u, s, _ = np.linalg.svd(np.exp(-gamma * np.maximum((z**2).sum(1)[:, None] + (z**2).sum(1)[None] - 2 * z @ z.T, 0)))
    return (u / np.sqrt(np.maximum(s, 1e-12))) @ u.T


def _lifted(x: np.ndarray, z: np.ndarray, root: np.ndarray, gamma: float) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (z**2).sum(1)[None] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d, 0)) @ root


def nystroem(rows: DataFrame, gamma: float, landmarks: int = LANDMARKS, seed: int = 42) -> DataFrame:
    """Features mapped to an approximate RBF kernel's space by at most ``landmarks`` train rows, the first in hash order."""
    arrays = rows.withColumn("_x", vector_to_array("features"))
    picked = arrays.filter("split = 'train'").select("_x").orderBy(_landmark_order(F.col("_x"), seed)).limit(landmarks).collect()
    z = np.array([r[0] for r in picked])
    root = _root(z, gamma)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(_lifted(np.stack(x.to_numpy()), z, root, gamma)))

    return arrays.withColumn("features", array_to_vector(lift("_x"))).drop("_x")


def svm(rows: DataFrame, gammas=RBF_GAMMA, landmarks: int = LANDMARKS) -> tuple[DataFrame, str, float]:
    """(scored rows, kind, val AUPRC): the better of the linear and the approximated RBF machine on val; ties to the linear."""
    if _small(rows):

        def unit(x, y, w, split, order):
            _, ap, score = _chosen(x, y, w, split, SVM_C, hinge=True)
            best, train = ("linear", ap, score), np.flatnonzero(split == "train")
            z = x[train[np.argsort(order[train].astype(str), kind="stable")][:landmarks]]
            for g in gammas:
                _, ap, score = _chosen(_lifted(x, z, _root(z, g), g), y, w, split, SVM_C, hinge=True)
                if ap > best[1]:
                    best = ("rbf_nystroem_approx", ap, score)
            return best

        return _in_one_task(rows, unit, _landmark_order)
    best = (*linear_svm(rows)[::2], "linear")
    for g in gammas:
        scored, _, ap = linear_svm(materialise(nystroem(rows, g, landmarks), "rbf"))
        if ap > best[1]:
            best = (scored, ap, "rbf_nystroem_approx")
    return best[0], best[2], best[1]


#: Walks that a block of skip-gram has at most, on average.
WALKS_A_TASK = 500_000


def node2vec(adjacency: DataFrame, dimension: int = 64, length: int = 10, walks: int = 4, p: float = 1.0, q: float = 1.0, window: int = 5, seed: int = 42) -> DataFrame:
    """(node, vec) by skip-gram with negative sampling over second-order walks, one pass; ``adjacency`` has each link in both directions."""
    return walk_vectors(adjacency, dimension, length, walks, p, q, window, seed, WALKS_A_TASK)


def spectral(adjacency: DataFrame, dimension: int = 16, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(node, vec): the leading eigenvectors of D^-1/2 (A + I) D^-1/2, which are the last of the Laplacian's, by block power iteration.

    A round is one join and two aggregates over (node, place, value); only a
    dimension-squared Gram matrix reaches the driver, for the orthonormal
    change of base. The trivial eigenvector comes first.
    """
    w = materialise(normalised_adjacency(adjacency), "weights")
    nodes = w.select("node").distinct()
    x = nodes.select("node", F.array(*[uniform(seed, "node", F.lit(i)) - 0.5 for i in range(dimension)]).alias("x"))
    for _ in range(rounds):
        sums = w.join(x.select(F.col("node").alias("nbr"), "x"), "nbr").groupBy("node").agg(*[F.sum(F.col("w") * F.col("x")[i]).alias(f"v{i}") for i in range(dimension)])
        y = materialise(sums.select("node", F.array(*[f"v{i}" for i in range(dimension)]).alias("x")), "power")
        flat = y.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(dimension) for j in range(i, dimension)]).first()
        g = np.zeros((dimension, dimension))
        for i in range(dimension):
            for j in range(i, dimension):
                g[i, j] = g[j, i] = flat[f"g{i}_{j}"] or 0.0
        base = np.linalg.inv(np.linalg.cholesky(g + 1e-12 * np.eye(dimension) * max(1e-300, np.trace(g)))).T
        turned = [sum((F.col("x")[i] * float(base[i, j]) for i in range(dimension) if base[i, j]), F.lit(0.0)) for j in range(dimension)]
        x = y.select("node", F.array(*turned).alias("x"))
    return materialise(x.withColumnRenamed("x", "vec"), "spectral")


def hin_vectors(pairs: DataFrame, nodes: DataFrame | None = None, dimension: int = 32, epochs: int = 5, rate: float = 0.05, negatives: int = 3, seed: int = 42, block: int = 200_000) -> DataFrame:
    """(node, vec) by the gated product of two nodes and a relation, trained on all (a, b, relation, n) pairs.

    The pairs come from distributed walks and stay in a table; the driver
    holds one hashed part of about ``block`` of them at a time, besides the
    vectors of all nodes: those of the pairs and of ``nodes`` (node).
    """
    pairs = materialise(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    every = ends if nodes is None else ends.unionByName(nodes.select("node"))
    names = sorted(r.node for r in every.distinct().collect())
    kinds = sorted(r.relation for r in pairs.select("relation").distinct().collect())
    blocks = max(1, -(-pairs.count() // block))
    parts = materialise(pairs.withColumn("_k", draw(seed, blocks, "a", "b", "relation")), "parts")
    rng = np.random.default_rng(seed)
    ids, places = {n: i for i, n in enumerate(names)}, {k: i for i, k in enumerate(kinds)}
    vec, gate = rng.normal(0, 0.1, (len(names), dimension)), np.zeros((len(kinds), dimension))
    for k in (int(k) for _ in range(epochs if kinds else 0) for k in rng.permutation(blocks)):
        rows = parts.filter(F.col("_k") == k).orderBy(F.desc("n"), "a", "b", "relation").toPandas()
        a, b, r = rows["a"].map(ids).to_numpy(), rows["b"].map(ids).to_numpy(), rows["relation"].map(places).to_numpy()
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            if not len(at):
                continue
            x = np.repeat(a[at], 1 + negatives)
            rel = np.repeat(r[at], 1 + negatives)
            y = rng.integers(0, len(names), len(x))
            y[:: 1 + negatives] = b[at]
            label = np.zeros(len(x))
            label[:: 1 + negatives] = 1
            s = 1 / (1 + np.exp(-gate[rel]))
            e = (label - 1 / (1 + np.exp(-(vec[x] * vec[y] * s).sum(1))))[:, None]
            dx, dy, dg = e * vec[y] * s, e * vec[x] * s, e * vec[x] * vec[y] * s * (1 - s)
            np.add.at(vec, x, rate * dx)
            np.add.at(vec, y, rate * dy)
            np.add.at(gate, rel, rate * dg)
    spark = pairs.sparkSession
    return spark.createDataFrame(pd.DataFrame({"node": names, "vec": [v.tolist() for v in vec]}), "node string, vec array<double>")


def pca2(vectors: DataFrame) -> DataFrame:
    """(node, pc1, pc2): the first two principal components; their signs are arbitrary."""
    v = vectors.select("node", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("node", vector_to_array("p").alias("p"))
    return out.select("node", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2"))
