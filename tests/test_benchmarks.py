import numpy as np
import pandas as pd
import pytest

from edgeloom import queries_benchmarks as Q
from edgeloom.operators import benchmarks as B
from edgeloom.operators import vectors as V


def rings(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1 + 2 * y + 0.2 * rng.normal(size=n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1), y


@pytest.mark.parametrize("c", [0.5, 100.0])
def test_machine_is_optimal(c):
    x, y = rings(150, 1)
    flip = np.random.default_rng(2).random(150) < 0.1
    y[flip] = 1 - y[flip]
    m = B.KernelMachine(c, tolerance=1e-4).fit(x, y)
    s, f = np.where(y == 1, 1, -1), m.decision(x)
    top = c * 150 / (2 * np.where(y == 1, (y == 1).sum(), (y != 1).sum()))
    a = np.zeros(150)
    at = {tuple(v): i for i, v in enumerate(x)}
    for v, w in zip(m.vectors, m.weights):
        a[at[tuple(v)]] = abs(w)
    # Karush-Kuhn-Tucker: outside the margin no weight, on it some, within it the full weight.
    assert abs((a * s).sum()) < 1e-8 and (a <= top + 1e-9).all()
    assert (s * f)[a == 0].min() > 1 - 1e-3 and (s * f)[a >= top - 1e-9].max() < 1 + 1e-3
    assert np.abs((s * f)[(a > 0) & (a < top - 1e-9)] - 1).max() < 1e-3 if ((a > 0) & (a < top - 1e-9)).any() else True


def test_machine_tells_rings_with_few_kernel_rows(monkeypatch):
    monkeypatch.setattr(B, "KEPT_ROWS", 5)
    x, y = rings(300, 3)
    z, w = rings(200, 4)
    assert B.auroc(w, B.KernelMachine(10.0).fit(x, y).decision(z)) > 0.99


def test_measures_against_counting():
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 9, 80) / 8
    pos, neg = s[y == 1], s[y == 0]
    assert abs(B.auroc(y, s) - np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))) < 1e-12
    tries = [(2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + y.sum()), -t) for t in np.unique(s)]
    f1, t = max(tries)
    assert B.best_threshold(y, s) == (-t, pytest.approx(f1))
    assert B.precision_at(np.array([0, 1, 1]), np.array([0.1, 0.9, 0.9]), 2) == 1.0 and B.average_precision(np.zeros(3), np.arange(3.0)) == 0.0
    with pytest.raises(ValueError):
        B.auroc(np.ones(3), np.arange(3.0))


def term(n, seed, term="GO:1"):
    x, y = rings(n, seed)
    split = [("cv_fold1", "cv_fold2", "cv_fold3", "holdout")[i % 4] for i in range(n)]
    return pd.DataFrame({"go_term": term, "gene": [f"g{i:03}" for i in range(n)], "label": y, "split": split, "vec": list(x.tolist())})


def test_terms_and_bad_units(spark):
    bad = term(20, 7, "GO:2").assign(label=1)
    df = spark.createDataFrame(pd.concat([term(160, 6), bad]))
    rows = {r.go_term: r for r in B.per_unit(df, ["go_term"], ["gene"], B.term_unit, B.TERM_COLUMNS).collect()}
    good, worse = rows["GO:1"], rows["GO:2"]
    assert good.status == "ok" and good.test_auroc > 0.95 and good.test_f1 > 0.9 and (good.n_train, good.n_test) == (120, 40) and good.best_c in B.GRID
    assert worse.status == "error" and "one class" in worse.error and worse.test_auroc is None
    total = B.summary(spark.createDataFrame([("a", "ok", 1.0), ("a", "ok", 0.5), ("a", "error", None)], "s string, status string, m double"), ["s"], ["m"]).first()
    assert (total.n_units, total.n_ok, total.mean_m, total.median_m) == (3, 2, 0.75, 0.75)
    assert B.per_unit(df.limit(0), ["go_term"], ["gene"], B.term_unit, B.TERM_COLUMNS).count() == 0


def test_nested_folds():
    x, y = rings(120, 8)
    base = pd.DataFrame({"pair": range(120), "label": y, "vec": list(x.tolist())})
    parts = [base[:90].assign(split="outer_train", inner_fold=-1), base[90:].assign(split="outer_test", inner_fold=-1)]
    for f in B.INNER:
        inside = base[:90]["pair"] % 3 == f
        parts += [base[:90][~inside].assign(split="inner_train", inner_fold=f), base[:90][inside].assign(split="inner_validation", inner_fold=f)]
    out = B.nested_unit(pd.concat(parts, ignore_index=True))
    assert out["test_auroc"] > 0.95 and out["inner_auroc"] > 0.95 and out["test_pr_at_10"] == 1.0 and out["n_train"] == 90


def test_missing_vectors_are_an_error(spark):
    rows, vectors = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", [1.0])], "k string, vec array<double>")
    with pytest.raises(ValueError, match="1 keys"):
        B.require_vectors(rows, vectors, ["k"])
    assert B.require_vectors(rows.limit(1), vectors, ["k"]).count() == 1


def test_fits_from_one_pass_of_grams(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(60, 2))
    b[:, 0] = a[:, 0] + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([(f"n{i}", a[i].tolist(), b[i].tolist(), i % 2) for i in range(60)], "node string, va array<double>, vb array<double>, k int")
    parts = V.grams(df, "k")
    assert set(parts) == {0, 1} and np.allclose(parts[0][0], np.hstack([a, b])[::2].T @ np.hstack([a, b])[::2]) and parts[1][2] == 30
    ca, cb = a - a.mean(0), b - b.mean(0)
    want = ((ca.T @ cb) ** 2).sum() / np.sqrt(((ca.T @ ca) ** 2).sum() * ((cb.T @ cb) ** 2).sum())
    assert abs(V.cka_of(*(sum(p[j] for p in parts.values()) for j in range(3)), 3) - want) < 1e-9

    def score(tr, te):
        w = np.linalg.solve((a[tr] - a[tr].mean(0)).T @ (a[tr] - a[tr].mean(0)) + np.eye(3), (a[tr] - a[tr].mean(0)).T @ (b[tr] - b[tr].mean(0)))
        e = b[te] - (b[tr].mean(0) + (a[te] - a[tr].mean(0)) @ w)
        return np.mean(1 - (e**2).sum(0) / ((b[te] - b[te].mean(0)) ** 2).sum(0))

    even, odd = np.arange(0, 60, 2), np.arange(1, 60, 2)
    got = V.ridge_of(parts, d=3)
    assert np.allclose(got, (np.mean([score(odd, even), score(even, odd)]), np.std([score(odd, even), score(even, odd)])))
    assert V.ridge_of({}) is None and V.grams(df.limit(0)) == {}


def test_space_pairs_writes_no_similarities(spark, small, monkeypatch):
    rows, write = {}, Q.materialise

    def seen(df, label="cut"):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(Q, "materialise", seen)
    monkeypatch.setattr(Q.V, "NODES_A_TASK", 16)  # nodes of a pair in several tasks
    got = {r.pair: r for r in Q.QUERIES["space_pairs"](spark, small).collect()}
    assert got and all(n <= rows["common"] for n in rows.values())
    monkeypatch.undo()
    assert {r.pair: r for r in Q.QUERIES["space_pairs"](spark, small).collect()} == got
