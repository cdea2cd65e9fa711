"""Functional benchmarks of embeddings by exact kernel machines: genes of GO terms, and gene pairs in nested folds.

A unit is a term, or a task and outer fold, of one embedding space. Its rows
are distinct genes or pairs of one organism's genes, so a unit is bounded by
the domain; units are independent and spread over the cluster. The machine
keeps vectors and a bounded number of kernel rows, never the kernel matrix. A
unit that can't be trained or judged gives a row with its error instead.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The grid of C, the folds of a term, and the inner folds of a task.
GRID = (0.1, 1.0, 10.0, 100.0, 1000.0)
FOLDS = ("cv_fold1", "cv_fold2", "cv_fold3")
INNER = (0, 1, 2)
#: Kernel rows that a machine keeps, and steps a row of training at most.
KEPT_ROWS = 2048
STEPS = 200


class KernelMachine:
    """A support vector machine with the RBF kernel and balanced class weights, solved by pairs of most violating multipliers."""

    def __init__(self, c: float, gamma: float | None = None, tolerance: float = 1e-3):
        self.c, self.gamma, self.tolerance = c, gamma, tolerance

    def _row(self, i: int) -> np.ndarray:
        if i not in self.rows:
            if len(self.rows) >= KEPT_ROWS:
                self.rows.popitem(last=False)
            self.rows[i] = np.exp(-self.g * np.maximum(self.square + self.square[i] - 2 * (self.x @ self.x[i]), 0))
        return self.rows[i]

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelMachine:
        """Train on vectors and labels 0 and 1; both must occur. Without gamma it is one over dimensions and variance."""
        if len(set(y.tolist())) < 2:
            raise ValueError("one class only")
        spread = x.shape[1] * x.var()
        self.x, self.square = x, (x**2).sum(1)
        self.g = self.gamma if self.gamma is not None else (1 / spread if spread > 0 else 1.0)
        s = np.where(y == 1, 1.0, -1.0)
        n = len(y)
        top = self.c * n / (2 * np.where(y == 1, (y == 1).sum(), (y != 1).sum()))
        a, slope = np.zeros(n), -np.ones(n)
        self.rows: OrderedDict[int, np.ndarray] = OrderedDict()
        for _ in range(STEPS * n):
            pull = -s * slope
            up, down = np.where(s > 0, a < top, a > 0), np.where(s > 0, a > 0, a < top)
            i, j = int(np.where(up, pull, -np.inf).argmax()), int(np.where(down, pull, np.inf).argmin())
            gap = pull[i] - pull[j]
            if gap < self.tolerance:
                break
            ki, kj = self._row(i), self._row(j)
            step = gap / max(2 - 2 * ki[j], 1e-12)
            room = [top[k] - a[k] if d > 0 else a[k] for k, d in ((i, s[i]), (j, -s[j]))]
            step = min(step, *room)
            a[i] += s[i] * step
            a[j] -= s[j] * step
            slope += s * (ki - kj) * step
        pull = -s * slope
        inner = (a > 0) & (a < top)
        up, down = np.where(s > 0, a < top, a > 0), np.where(s > 0, a > 0, a < top)
        self.bias = pull[inner].mean() if inner.any() else (pull[up].max() + pull[down].min()) / 2
        held = a > 0
        self.vectors, self.weights = x[held], (a * s)[held]
        self.rows.clear()
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        d = (x**2).sum(1)[:, None] + (self.vectors**2).sum(1)[None] - 2 * x @ self.vectors.T
        return np.exp(-self.g * np.maximum(d, 0)) @ self.weights + self.bias


def _steps(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores from the highest, and hits and misses from there up."""
    values, at = np.unique(-score, return_inverse=True)
    return -values, np.cumsum(np.bincount(at, y == 1)), np.cumsum(np.bincount(at, y != 1))


def auroc(y: np.ndarray, score: np.ndarray) -> float:
    _, hit, miss = _steps(y, score)
    if not hit[-1] or not miss[-1]:
        raise ValueError("one class only")
    hits, before = np.diff(hit, prepend=0), np.concatenate(([0], miss[:-1]))
    return float((hits * (miss[-1] - (before + miss) / 2)).sum() / (hit[-1] * miss[-1]))


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    _, hit, miss = _steps(y, score)
    return float((np.diff(hit, prepend=0) * hit / (hit + miss)).sum() / hit[-1]) if hit[-1] else 0.0


def best_threshold(y: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    """The lowest threshold of the highest F1, and that F1."""
    at, hit, miss = _steps(y, score)
    f1 = 2 * hit / (hit + miss + max(hit[-1], 1))
    i = len(f1) - 1 - int(np.round(f1[::-1], 12).argmax())
    return float(at[i]), float(f1[i])


def precision_at(y: np.ndarray, score: np.ndarray, k: int = 10) -> float:
    """Positives among the k best scores, ties in the order of the rows."""
    return float((y[np.argsort(-score, kind="stable")[:k]] == 1).mean())


def _scaled(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    mean, spread = train.mean(0), train.std(0)
    spread[spread == 0] = 1
    return [(x - mean) / spread for x in (train, *others)]


def _trained(c: float, x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Scores of ``of`` by a machine on standardised vectors."""
    if not len(of) or not len(x):
        raise ValueError("no rows")
    a, b = _scaled(x, of)
    return KernelMachine(c).fit(a, y).decision(b)


def term_unit(rows: pd.DataFrame) -> dict:
    """One term: C by the mean AUROC over the folds, the threshold from the pooled scores of all folds, and the holdout judged by both."""
    x, y, split = np.stack(rows["vec"].to_numpy()).astype(float), rows["label"].to_numpy(), rows["split"].to_numpy()
    training, test = np.isin(split, FOLDS), split == "holdout"
    pooled = {}
    for c in GRID:
        scores = np.full(len(y), np.nan)
        for f in FOLDS:
            scores[split == f] = _trained(c, x[training & (split != f)], y[training & (split != f)], x[split == f])
        pooled[c] = float(np.mean([auroc(y[split == f], scores[split == f]) for f in FOLDS])), scores[training]
    c = max(GRID, key=lambda k: pooled[k][0])
    threshold, f1 = best_threshold(y[training], pooled[c][1])
    score = _trained(c, x[training], y[training], x[test])
    hit, said, true = int(((score >= threshold) & (y[test] == 1)).sum()), int((score >= threshold).sum()), int((y[test] == 1).sum())
    return {
        "best_c": c, "cv_mean_auroc": pooled[c][0], "validation_f1_threshold": threshold, "validation_f1": f1, "n_train": int(training.sum()), "n_test": int(test.sum()), "n_test_positive": true,
        "test_auprc": average_precision(y[test], score), "test_auroc": auroc(y[test], score), "test_f1": 2 * hit / max(said + true, 1), "test_precision": hit / max(said, 1), "test_recall": hit / max(true, 1),
    }


def nested_unit(rows: pd.DataFrame) -> dict:
    """One task and outer fold: C by the mean AUROC over the inner folds, refitted on all of outer_train and judged on outer_test."""
    part = rows["split"].to_numpy()
    train, test = rows[part == "outer_train"], rows[part == "outer_test"]
    if train.empty or test.empty:
        raise ValueError("no rows")
    x, y = np.stack(train["vec"].to_numpy()).astype(float), train["label"].to_numpy()
    place = {p: i for i, p in enumerate(train["pair"])}
    folds = []
    for f in INNER:
        inner = rows["inner_fold"].to_numpy() == f
        folds.append([np.array([place[p] for p in rows["pair"][inner & (part == s)] if p in place], int) for s in ("inner_train", "inner_validation")])
    measured = {}
    for c in GRID:
        told = [(y[v], KernelMachine(c).fit(x[t], y[t]).decision(x[v])) for t, v in folds]
        measured[c] = tuple(float(np.mean([m(*s) for s in told])) for m in (auroc, average_precision, precision_at))
    c = max(GRID, key=lambda k: measured[k][0])
    z, xt = test["label"].to_numpy(), np.stack(test["vec"].to_numpy()).astype(float)
    score = KernelMachine(c).fit(x, y).decision(xt)
    return {
        "best_c": c, "inner_auroc": measured[c][0], "inner_auprc": measured[c][1], "inner_pr_at_10": measured[c][2], "n_train": len(y), "n_test": len(z), "n_test_positive": int((z == 1).sum()),
        "test_auroc": auroc(z, score), "test_auprc": average_precision(z, score), "test_pr_at_10": precision_at(z, score),
    }


_WHOLE = ("n_train", "n_test", "n_test_positive")


def per_unit(rows: DataFrame, keys: list[str], order: list[str], judge: Callable[[pd.DataFrame], dict], columns: list[str]) -> DataFrame:
    """(keys..., columns..., status, error): ``judge`` of each unit, or its error in a row with the status error, so that one bad unit stops no other."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = {k: pdf[k].iloc[0] for k in keys} | dict.fromkeys(columns) | {"status": "ok", "error": None}
        try:
            out |= judge(pdf)
        except Exception as e:  # noqa: BLE001 - reported in the unit's row
            out |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([out])

    kinds = dict(rows.dtypes)
    form = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{c} {'bigint' if c in _WHOLE else 'double'}" for c in columns], "status string", "error string"])
    return rows.groupBy(*keys).applyInPandas(one, form)


TERM_COLUMNS = ["best_c", "cv_mean_auroc", "validation_f1_threshold", "validation_f1", "n_train", "n_test", "n_test_positive", "test_auprc", "test_auroc", "test_f1", "test_precision", "test_recall"]
NESTED_COLUMNS = ["best_c", "inner_auroc", "inner_auprc", "inner_pr_at_10", "n_train", "n_test", "n_test_positive", "test_auroc", "test_auprc", "test_pr_at_10"]


def require_vectors(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``vec`` by the keys; an error tells how many keys have no vector."""
    lost = rows.select(*keys).distinct().join(vectors.select(*keys), keys, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} keys have no vector")
    return rows.join(vectors.select(*keys, "vec"), keys)


def summary(results: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """(group..., n_units, n_ok, mean and median of the measures over the units without error)."""
    ok = F.col("status") == "ok"
    aggs = [f(F.when(ok, F.col(m))).alias(f"{n}_{m}") for m in measures for n, f in (("mean", F.avg), ("median", F.median))]
    return results.groupBy(*group).agg(F.count("*").alias("n_units"), F.count_if(ok).alias("n_ok"), *aggs)
