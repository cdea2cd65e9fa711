"""Most similar vectors for every vector, by score-aware anisotropic quantisation.

A collection is parted into cells of some ten thousand vectors, each vector
being an item of its nearest cell and a query there and at the next cells. In
a cell, what the nearest of its sub-centres leaves of a unit vector is
product-quantised in four bits a subspace, with codebooks fitted under the
anisotropic loss, which weighs the error along the vector (it changes the
inner product) more than the error across it. Queries near to each other scan
the codes of their sub-cells by table look-ups, and a fixed number of the best
is reranked by the exact cosine. Quantisers are fitted on bounded samples;
every vector is indexed and every vector is a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.durable import materialise
from edgeloom.plans.skew import join_hot

DIM = 64
NEIGHBOURS = 10
#: Vectors of a cell that its quantisers are fitted on, and vectors a cell that a collection's centres are fitted on, at most.
SAMPLE = 2048
CENTRE_SAMPLE = 64
SUBSPACES = 32
SUB = DIM // SUBSPACES
CODES = 16
#: Cosine from which the error along the vector is weighed up (T of the anisotropic loss, of unit vectors).
SCORE_FROM = 0.2
ETA = (DIM - 1) * SCORE_FROM**2 / (1 - SCORE_FROM**2)
#: Vectors of a cell, about; larger collections have larger cells, see cells_of.
CELL = 16_384
#: Cells that a query visits, sub-cells that it probes in each, and candidates that it reranks there.
VISITS = 3
PROBES = 6
RERANK = 96
#: Queries that are scanned together.
TOGETHER = 64
#: Vectors a block of assignment; items and queries that one task takes of a cell, beyond which it is split.
BLOCK = 65_536
PART = 4 * CELL
TURN = 4 * PART


def cells_of(n: int) -> int:
    """Cells of a collection of n vectors: a cell has CELL vectors and twice the root of n, so the centres stay few."""
    return max(1, round(n / (CELL + 2 * n**0.5)))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most k spherical k-means centres; an empty cell restarts at the worst served vector.

    More than 256 centres are fitted in two steps, about the root of k and
    then the rest within each.
    """
    if k > 256:
        first = kmeans(x, round(k**0.5), rng, rounds)
        at = (x @ first.T).argmax(1)
        size = np.bincount(at, minlength=len(first))
        return np.concatenate([kmeans(x[at == j], max(1, round(k * size[j] / len(x))), rng, rounds) for j in np.flatnonzero(size)])
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds if len(c) > 1 else 1):
        s = x @ c.T
        at = s.argmax(1)
        order = np.argsort(at, kind="stable")
        size = np.bincount(at, minlength=len(c))
        full = np.flatnonzero(size)
        sums = np.zeros_like(c)
        sums[full] = np.add.reduceat(x[order], (np.cumsum(size) - size)[full], axis=0)
        if len(full) < len(c):
            worst = np.argsort(s[np.arange(len(x)), at])
            for j, i in zip(np.flatnonzero(size == 0), worst, strict=False):
                sums[j] = x[i]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def encode(x: np.ndarray, r: np.ndarray, books: np.ndarray, sweeps: int = 1) -> np.ndarray:
    """Codes (n, SUBSPACES) of residuals r of unit vectors x, by coordinate descent on the anisotropic loss."""
    n = len(x)
    rows = np.arange(n)
    xs, rs = x.reshape(n, SUBSPACES, SUB), r.reshape(n, SUBSPACES, SUB)
    codes = np.empty((n, SUBSPACES), dtype=np.uint8)
    along = np.empty((n, SUBSPACES), dtype=np.float32)
    inner = (rs * xs).sum(2)
    square = (books**2).sum(2)
    for m in range(SUBSPACES):
        codes[:, m] = (square[m] - 2 * (rs[:, m] @ books[m].T)).argmin(1)
        along[:, m] = inner[:, m] - (books[m][codes[:, m]] * xs[:, m]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(SUBSPACES):
            p = inner[:, m, None] - xs[:, m] @ books[m].T
            off = (total - along[:, m])[:, None] + p
            codes[:, m] = (square[m] - 2 * (rs[:, m] @ books[m].T) + (ETA - 1) * off * off).argmin(1)
            now = p[rows, codes[:, m]]
            total += now - along[:, m]
            along[:, m] = now
    return codes


def codebooks(x: np.ndarray, r: np.ndarray, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    """Codebooks (SUBSPACES, CODES, SUB) for residuals r of unit vectors x, by turns of codes and least squares of the anisotropic loss."""
    n = len(x)
    xs, rs = x.reshape(n, SUBSPACES, SUB), r.reshape(n, SUBSPACES, SUB)
    books = rs[rng.choice(n, CODES, replace=n < CODES)].transpose(1, 0, 2).copy()
    inner = (rs * xs).sum(2)
    for _ in range(rounds):
        codes = encode(x, r, books)
        along = inner - (books[np.arange(SUBSPACES), codes] * xs).sum(2)
        rest = along.sum(1)[:, None] - along + inner
        for m in range(SUBSPACES):
            w = (ETA - 1) * xs[:, m]
            own = np.zeros((n, CODES), np.float32)
            own[np.arange(n), codes[:, m]] = 1
            a = (own.T @ (w[:, :, None] * xs[:, m, None, :]).reshape(n, SUB * SUB)).reshape(CODES, SUB, SUB) + own.sum(0)[:, None, None] * np.eye(SUB)
            b = own.T @ (rs[:, m] + w * rest[:, m, None])
            used = own.any(0)
            books[m, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
    return books.astype(np.float32)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """The quantised items of a cell, in the order of their sub-cells."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        sample = x[rng.choice(len(x), SAMPLE, replace=False)] if len(x) > SAMPLE else x
        self.centres = kmeans(sample, max(1, min(round(0.5 * len(x) ** 0.5), SAMPLE // 8)), rng)
        nearest = lambda v: (v @ self.centres.T).argmax(1)
        self.books = codebooks(sample, sample - self.centres[nearest(sample)], rng)
        home = nearest(x)
        codes = encode(x, x - self.centres[home], self.books)
        self.order = np.argsort(home, kind="stable")
        self.packed = np.ascontiguousarray((codes[:, 0::2] * CODES + codes[:, 1::2])[self.order].T)
        self.sizes = np.bincount(home, minlength=len(self.centres))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scan(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores): the items of the sub-cells and their approximate scores (items, queries): the centre's score and a table look-up for each pair of four-bit codes."""
        places = np.concatenate([np.arange(self.starts[c], self.starts[c] + self.sizes[c]) for c in cells])
        tables = np.einsum("qms,mcs->mcq", q.reshape(len(q), SUBSPACES, SUB), self.books, optimize=True)
        pairs = (tables[0::2, :, None] + tables[1::2, None]).reshape(SUBSPACES // 2, CODES * CODES, len(q))
        out = np.repeat(self.centres[cells] @ q.T, self.sizes[cells], axis=0)
        held = np.empty_like(out)
        for m in range(SUBSPACES // 2):
            out += np.take(pairs[m], self.packed[m, places], axis=0, out=held, mode="clip")
        return places, out


def search(items: np.ndarray, ids: np.ndarray, queries: np.ndarray, names: np.ndarray, least: float) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(query names, near ids, cosines), ten a query at most: the items of the highest cosine of ``least`` or more, but for the query's own."""
    index = Index(items.astype(np.float32))
    q32, x32 = queries.astype(np.float32), items.astype(np.float32)
    toward = q32 @ index.centres.T
    probes = np.argpartition(-toward, min(PROBES, toward.shape[1]) - 1, axis=1)[:, :PROBES]
    by = np.argsort(toward.argmax(1), kind="stable")
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(by), TOGETHER):
        own = by[at : at + TOGETHER]
        cells = np.unique(probes[own])
        places, scores = index.scan(q32[own], cells[index.sizes[cells] > 0])
        k = min(RERANK + 1, len(places))
        best = np.argpartition(-scores.T, k - 1, axis=1)[:, :k] if k < len(places) else np.broadcast_to(np.arange(k), (len(own), k))
        top = index.order[places][best]
        near = np.matmul(x32[top], q32[own][:, :, None])[:, :, 0]
        near[ids[top] == names[own][:, None]] = -9
        # The single precision picks some more than ten, whose cosines are then made in double precision.
        some = min(NEIGHBOURS + 4, k)
        pick = np.argpartition(-near, some - 1, axis=1)[:, :some] if some < k else np.broadcast_to(np.arange(k), near.shape)
        top = np.take_along_axis(top, pick, 1)
        exact = np.matmul(items[top], queries[own][:, :, None])[:, :, 0]
        exact[ids[top] == names[own][:, None]] = -9
        first = np.lexsort((ids[top], -exact), axis=1)[:, :NEIGHBOURS]
        cosine, found = np.take_along_axis(exact, first, 1), ids[np.take_along_axis(top, first, 1)]
        keep = cosine >= max(least, -1.5)
        out[0].append(np.repeat(names[own], keep.sum(1)))
        out[1].append(found[keep])
        out[2].append(cosine[keep])
    return out


def _search_cell(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    rows = rows.sort_values("rep", kind="stable")
    x, names = _unit(rows["embedding"]), rows["rep"].to_numpy(np.int64)
    item, query = rows["item"].to_numpy(bool), rows["query"].to_numpy(bool)
    if not item.any() or not query.any():
        return pd.DataFrame({"rep": np.empty(0, np.int64), "near": np.empty(0, np.int64), "cosine": np.empty(0)})
    reps, near, cosine = search(x[item], names[item], x[query], names[query], least)
    return pd.DataFrame({"rep": np.concatenate(reps), "near": np.concatenate(near), "cosine": np.concatenate(cosine)})


def _fit_centres(rows: pd.DataFrame) -> pd.DataFrame:
    x = _unit(rows.sort_values("rep")["embedding"]).astype(np.float32)
    centres = kmeans(x, int(rows["cells"].iloc[0]), np.random.default_rng(0))
    return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "centres": [centres.tobytes()]})


def _assign_block(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame(columns=["grp", "rep", "embedding", "visits"])
    centres = np.frombuffer(model["centres"].iloc[0], np.float32).reshape(-1, DIM)
    x = _unit(rows["embedding"]).astype(np.float32)
    visits = [np.argsort(-(x[at : at + 4096] @ centres.T), axis=1, kind="stable")[:, :VISITS] for at in range(0, len(x), 4096)]
    return rows[["grp", "rep", "embedding"]].assign(visits=list(np.concatenate(visits).astype(np.int32)))


def comparable(catalog: DataFrame) -> DataFrame:
    """(vec_id, grp, embedding) of the vectors that take part, by collection.

    Out are vectors that are null, of another length than DIM, not finite or
    all zero, and rows whose node_type is null or DESCONOCIDO. A null source,
    condition or seed counts as a value of its own. grp is a 128-bit hash.
    """
    e = F.col("embedding")
    rows = catalog.filter(F.col("node_type").isNotNull() & (F.trim("node_type") != "DESCONOCIDO") & (F.size(e) == DIM))
    rows = rows.filter(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0))
    grp = F.to_json(F.struct("embedding_source", "training_condition", "seed", "node_type"), {"ignoreNullFields": "false"})
    return rows.select("vec_id", F.unhex(F.md5(grp)).alias("grp"), "embedding")


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that two sides of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, leaders) of the classes of equal vectors: (grp, vec_id, rep, n) of every vector that has an equal one, and (grp, rep, n, ids) with the first eleven ids of each class.

    Vectors are equal if two 64-bit hashes are. rep is the smallest id. Only
    ids and hashes are shuffled, and a class of a third of all rows is split.
    """
    key = ["grp", "_h", "_g"]
    ids = vectors.select("vec_id", "grp", F.xxhash64("embedding").alias("_h"), F.xxhash64(F.lit(1), "embedding").alias("_g"))
    sizes = materialise(ids.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "classes")
    members = materialise(join_hot(ids, sizes, key, "n").select("grp", "vec_id", "rep", "n").distinct(), "members")
    place = F.row_number().over(Window.partitionBy("grp", "rep").orderBy("vec_id"))  # its limit is applied before the shuffle too
    first = members.withColumn("_r", place).filter(F.col("_r") <= NEIGHBOURS + 1)
    leaders = first.groupBy("grp", "rep").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return members, materialise(leaders, "leaders")


def neighbours(vectors: DataFrame, least: float = -2.0) -> DataFrame:
    """(vec_id, near_id, cosine): up to ten most similar other vectors of the collection, of cosine ``least`` or more.

    Equal vectors form a class; classes are searched by one representative, so
    a third of all rows being copies costs one search. Members of a class are
    each other's nearest. Ties go to the smaller id. Rows that repeat an id
    are one. Recall against brute force is measured in the tests; an empty
    table gives no rows.
    """
    members, leaders = classes(vectors)
    single = vectors.join(members.select("vec_id").distinct(), "vec_id", "left_anti")
    standing = vectors.join(leaders.select(F.col("rep").alias("vec_id")), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    reps = single.unionByName(standing).select("grp", F.col("vec_id").alias("rep"), "embedding")
    n = F.col("n")
    sizes = materialise(reps.groupBy("grp").agg(F.count("*").alias("n")).withColumn("cells", F.greatest(F.lit(1), F.round(n / (F.lit(CELL) + 2 * F.sqrt(n)))).cast("int")), "sizes")
    # A collection of one cell is a group as it stands.
    whole = sizes.filter("cells = 1").select("grp")
    alone = reps.join(whole, "grp").select("grp", F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(0).alias("turn"), "rep", "embedding", F.lit(True).alias("item"), F.lit(True).alias("query"))
    grid = alone if sizes.filter("cells > 1").isEmpty() else alone.unionByName(_celled(reps, sizes.filter("cells > 1")))
    kind = dict(vectors.dtypes)["vec_id"]
    found = grid.groupBy("grp", "cell", "part", "turn").applyInPandas(lambda rows: _search_cell(rows, least), "rep long, near long, cosine double")
    found = found.select(F.col("rep").cast(kind), F.col("near").cast(kind), "cosine")
    return _with_members(found, members, leaders, least)


def _celled(reps: DataFrame, sizes: DataFrame) -> DataFrame:
    """The items and queries (grp, cell, part, turn, rep, embedding, item, query) of collections of several cells.

    A vector is one row at its own cell, for both purposes, and one at each
    further cell that it visits. Only cells over PART items or TURN queries
    are split: then each part of the items meets each turn of the queries.
    """
    sized = reps.join(sizes, "grp")
    sample = sized.filter(F.pmod(F.xxhash64("rep"), F.col("n")) < CENTRE_SAMPLE * F.col("cells"))
    models = materialise(sample.groupBy("grp").applyInPandas(_fit_centres, "grp binary, centres binary"), "centres")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    blocked = sized.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int"))
    of_block = _renewed(sizes.select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).join(models, "grp"))
    form = "grp binary, rep long, embedding array<float>, visits array<int>"
    at = materialise(blocked.groupBy("grp", "block").cogroup(of_block.groupBy("grp", "block")).applyInPandas(_assign_block, form), "visits")
    visits = at.select("grp", "rep", "embedding", F.posexplode("visits").alias("nth", "cell"))
    load = at.select("grp", F.posexplode("visits").alias("nth", "cell")).groupBy("grp", "cell").agg(F.count_if(F.col("nth") == 0).alias("items"), F.count("*").alias("asked"))
    layout = load.select("grp", "cell", F.greatest(F.lit(1), F.ceil(F.col("items") / PART)).cast("int").alias("parts"), F.ceil(F.col("asked") / TURN).cast("int").alias("turns"))
    placed = visits.join(layout, ["grp", "cell"])
    part, turn = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("turns")).cast("int")
    place = lambda p, t, item, query: F.struct(p.alias("part"), t.alias("turn"), item.alias("item"), query.alias("query"))
    yes, no = F.lit(True), F.lit(False)
    # The own place serves both; the other parts get the vector as a query, the other turns as an item.
    across = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != part), lambda p: place(p, turn, no, yes))
    down = F.transform(F.filter(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: t != turn), lambda t: place(part, t, yes, no))
    home = F.concat(F.array(place(part, turn, yes, yes)), across, down)
    visit = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(p, turn, no, yes))
    return placed.select("grp", "cell", "rep", "embedding", F.inline(F.when(F.col("nth") == 0, home).otherwise(visit)))


def _with_members(found: DataFrame, members: DataFrame, leaders: DataFrame, least: float) -> DataFrame:
    """From classes to vectors: each member's ten nearest among its own class and the members of near classes."""
    ids = lambda side: leaders.select(F.col("rep").alias(side), F.col("ids").alias(f"_{side}"), F.col("n").alias(f"_n_{side}"))
    own = found.join(ids("near"), "near", "left").join(ids("rep"), "rep", "left").filter(F.coalesce(F.col("_n_rep"), F.lit(1)) <= NEIGHBOURS)
    others = own.select(F.explode(F.coalesce("_rep", F.array("rep"))).alias("vec_id"), "near", "_near", "cosine").select("vec_id", F.explode(F.coalesce(F.slice("_near", 1, NEIGHBOURS), F.array("near"))).alias("near_id"), "cosine")
    # Eleven ids are enough for any member's ten mates, as ties go to the smaller id.
    each = join_hot(members.select("rep", "vec_id"), leaders.select("rep", "n", "ids"), ["rep"], "n")
    mates = each.select("vec_id", F.explode(F.slice(F.filter("ids", lambda x: x != F.col("vec_id")), 1, NEIGHBOURS)).alias("near_id"), F.lit(1.0).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "near_id"))
    return others.unionByName(mates).withColumn("_r", place).filter(F.col("_r") <= NEIGHBOURS).drop("_r").filter(F.col("cosine") >= least)


def similar_pairs(catalog: DataFrame, least: float = 0.8) -> DataFrame:
    """(vec_lo, vec_hi): pairs of which one is among the other's ten nearest, with a cosine of ``least`` or more."""
    near = neighbours(comparable(catalog), least)
    return near.select(F.least("vec_id", "near_id").alias("vec_lo"), F.greatest("vec_id", "near_id").alias("vec_hi")).distinct()
