"""The slow models on small made data, by value."""

import numpy as np
import pytest

from edgeloom.operators import edges as E
from edgeloom.operators import metrics as M
from edgeloom.operators import models as L
from edgeloom.operators import skip_gram as K


@pytest.fixture(scope="module")
def cliques(spark):
    """Two cliques of ten, joined by one edge."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(10) for j in range(i)] + [("a0", "b0")]
    return E.closure(spark.createDataFrame(pairs, "node1 string, node2 string")).cache()


def parted(rows) -> bool:
    """Whether vectors of one clique are nearer to each other than to the other's, on average."""
    x = {r.node: np.array(r.vec) / max(np.linalg.norm(r.vec), 1e-12) for r in rows}
    own = [x[p] @ x[q] for p in x for q in x if p != q and p[0] == q[0]]
    far = [x[p] @ x[q] for p in x for q in x if p[0] != q[0]]
    return len(x) == 20 and np.mean(own) > np.mean(far) + 0.1


def test_spectral_vectors(cliques):
    rows = L.spectral(cliques, dimension=3, rounds=12).collect()
    x = np.array([r.vec for r in rows])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6)
    second = {r.node: r.vec[1] for r in rows}
    assert len({np.sign(v) for n, v in second.items() if n[0] == "a"}) == 1 and np.sign(second["a5"]) != np.sign(second["b5"]) and len(rows) == 20


@pytest.mark.parametrize("each", [500_000, 200])
def test_node2vec_vectors(cliques, monkeypatch, each):
    monkeypatch.setattr(L, "WALKS_A_TASK", each)
    assert parted(L.node2vec(cliques, dimension=8, length=8, walks=20).collect())


def test_node2vec_trains_each_pair_once_in_any_number_of_blocks(spark, cliques):
    whole = cliques.unionByName(spark.createDataFrame([("alone", "alone")], "node string, nbr string"))
    found = []
    for blocks in (1, 6):
        ids = K.numbered(whole, blocks).cache()
        sizes = {r.b: r.n for r in ids.groupBy(K.F.shiftright("id", K._PLACE).alias("b")).agg(K.F.count("*").alias("n")).collect()}
        to = ids.select(K.F.col("node").alias("nbr"), K.F.col("id").alias("_to"))
        links = K._packed_links(whole.filter("node <> nbr").join(to, "nbr").join(ids, "node").select("id", K.F.col("_to").alias("nbr")), blocks)
        rows = K.walk_pairs_by_meeting(links, sizes, blocks, 8, 50, 0.5, 2.0, 1, 42).collect()
        name = {r.id: r.node for r in ids.collect()}
        pairs = [tuple(sorted((name[r.lo << K._PLACE | int(a)], name[r.hi << K._PLACE | int(b)]))) for r in rows for a, b in K.unpacked_pairs(r.data)]
        # A window of one holds the steps: 50 walks of 7 steps from each of 20 nodes, all along links.
        assert len(pairs) == 50 * 7 * 20 and set(pairs) <= {tuple(sorted(r)) for r in cliques.collect()}
        assert len({(r.lo, r.hi) for r in rows}) == len({(r.lo, r.hi, r["round"], r.task) for r in rows})
        found.append(pairs.count(("a0", "b0")))
        got = {r.node: r.vec for r in K.walk_vectors(whole, 8, 8, 20, 0.5, 2.0, 5, 42, 420 if blocks == 1 else 70).collect()}
        assert len(got) == 21 and all(len(v) == 8 and np.isfinite(v).all() for v in got.values())
    assert 0 < min(found) and max(found) < 2 * min(found)


@pytest.mark.parametrize("blocks", [2, 6, 24])
def test_every_two_blocks_meet_once(blocks):
    when, where = K.meetings(blocks)
    for r in range(blocks - 1):
        met = [(a, b) for a in range(blocks) for b in range(a + 1, blocks) if when[a, b] == r]
        assert len(met) == blocks // 2 == len({where[m] for m in met}) and {x for m in met for x in m} == set(range(blocks))
    assert all(when[a, a] == 0 and any(when[a, b] == 0 and where[a, b] == where[a, a] for b in range(blocks) if b != a) for a in range(blocks))


@pytest.mark.parametrize("p, q", [(0.25, 4.0), (2.0, 0.5), (1.0, 1.0)])
def test_block_steps_have_their_weights(p, q):
    # a-b, a-c, b-c, b-d: from a over b back to a, to the common neighbour c, or on to d.
    keys = np.array([a << 32 | b for a, near in enumerate([(1, 2), (0, 2, 3), (0, 1), (1,)]) for b in near], np.int64)
    path = np.tile(np.array([[0, 1]], np.int32), (20_000, 1))
    took = K.taken(path, *K.proposed(np.arange(20_000), path, keys, p, q, 42), keys, q)
    want = np.array([1 / p, 1, 1 / q]) / (1 / p + 1 + 1 / q)
    assert np.allclose([(took == x).mean() for x in (0, 2, 3)], want, atol=0.015)


def test_node2vec_of_no_links(spark):
    assert L.node2vec(spark.createDataFrame([], "node string, nbr string")).count() == 0


def test_first_vectors_are_sums_of_neighbours_signs():
    keys = np.array([0 << 32 | 1, 0 << 32 | 2, 1 << 32 | 1 << K._PLACE | 1], np.int64)
    x, signs, *_ = K.first_vectors(7, 0, 3, keys, 70, part=1)
    assert np.allclose(x[0] * np.linalg.norm(signs[1] + signs[2]), signs[1] + signs[2], atol=1e-5) and np.allclose(np.linalg.norm(x, axis=1), 1)
    assert np.allclose(x[1], K.first_vectors(7, 1, 2, keys[:0], 70)[1][1]) and np.allclose(x[2], signs[2])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_packed_pairs_come_back(n):
    pairs = np.random.default_rng(n).integers(0, 1 << 17, (n, 2))
    assert (K.unpacked_pairs(K.packed_pairs(pairs)) == pairs).all()


def test_row_updates_add_up_equal_rows():
    x, squares, g = np.zeros((3, 2), np.float32), np.zeros(3, np.float32), np.array([[1, 0], [0, 2], [3, 0]], np.float32)
    K._add(x, squares, np.array([2, 0, 2]), g)
    assert np.allclose(squares, [2, 0, 8]) and np.allclose(x, [[0, 2 * K.RATE / 2**0.5], [0, 0], [4 * K.RATE / 8**0.5, 0]])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        y = int(i % 3 == 0)
        x = rng.normal(size=3) + np.array([2.5 * y, 0, 0])
        rows.append((i, ("train", "val", "test")[i // 100], y, x.tolist()))
    return spark.createDataFrame(rows, "pair_id int, split string, label int, features array<double>")


def test_classifiers_tell_classes(labelled):
    ready = L.standardised(L.balanced_weights(labelled)).cache()
    weights = {r.label: r.weight for r in ready.select("label", "weight").distinct().collect()}
    assert weights[1] == pytest.approx(100 / (2 * 34)) and weights[0] == pytest.approx(100 / (2 * 66))
    scored, c, ap = L.logistic(ready, grid=(0.1, 1.0))
    assert c in (0.1, 1.0) and ap > 0.8 and M.auroc(scored.filter("split = 'test'"), []).first().auroc > 0.9
    scored, kind, ap = L.svm(ready, gammas=(0.1,), landmarks=40)
    assert kind in ("linear", "rbf_nystroem_approx") and ap > 0.8 and M.auroc(scored.filter("split = 'test'"), []).first().auroc > 0.9


def test_one_task_fits_what_all_tasks_fit(labelled, monkeypatch):
    ready = L.standardised(L.balanced_weights(labelled)).cache()
    rows = lambda scored: np.array([r.score for r in scored.orderBy("pair_id").collect()])
    monkeypatch.setattr(L, "_choose", lambda *a: pytest.fail("a small table went to all tasks"))
    one, machine = L.logistic(ready, grid=(1.0,)), L.svm(ready, gammas=(0.1,), landmarks=40)
    monkeypatch.undo()
    monkeypatch.setattr(L, "VALUES_A_TASK", 0)
    many, spread = L.logistic(ready, grid=(1.0,)), L.svm(ready, gammas=(0.1,), landmarks=40)
    assert one[1:] == many[1:] and np.allclose(rows(one[0]), rows(many[0]), rtol=0.01, atol=0.02)
    assert abs(machine[2] - spread[2]) < 0.02 and np.corrcoef(rows(machine[0]), rows(spread[0]))[0, 1] > 0.97


def test_logistic_arrays_reach_the_minimum():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(200, 3)) * [1, 5, 0], rng.integers(0, 2, 200).astype(float), rng.uniform(0.5, 2, 200)
    a, b = L._fitted(x, y, w, 0.1, hinge=False)
    pull = w / w.sum() * (1 / (1 + np.exp(-(x @ a + b))) - y)
    var = (w / w.sum()) @ x**2 - ((w / w.sum()) @ x) ** 2
    assert np.allclose(pull @ x + 0.1 * a * var * 200 / 199, 0, atol=5e-3) and abs(pull.sum()) < 1e-3 and a[2] == 0


def test_kernel_map_of_all_landmarks_is_exact(labelled):
    ready = L.standardised(L.balanced_weights(labelled.filter("pair_id < 40 OR pair_id >= 290")))
    x = {r.pair_id: r.x for r in ready.select("pair_id", L.vector_to_array("features").alias("x")).collect()}
    z = {r.pair_id: r.x for r in L.nystroem(ready, 0.1, 40).select("pair_id", L.vector_to_array("features").alias("x")).collect()}
    for p, q in ((0, 5), (3, 39), (7, 7)):
        assert np.dot(z[p], z[q]) == pytest.approx(np.exp(-0.1 * np.sum((np.array(x[p]) - np.array(x[q])) ** 2)), abs=1e-6)
