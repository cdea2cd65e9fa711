"""Second-order walks and skip-gram on blocks of nodes.

Nodes are dealt to blocks by hash. What a block knows (its links, its vectors)
and what is sent to it are packed arrays, one row each, so a task works on
arrays and Spark moves a few rows a block. No task holds more than two blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.graph import _mixed, proposals
from edgeloom.plans.durable import discard, materialise, release

#: Nodes and links of a block, on average; a node's place in its block has 17 bits.
NODES_A_BLOCK, LINKS_A_BLOCK = 100_000, 2_000_000
#: Blocks come by the dozen once there are as many nodes as keep a dozen busy.
DOZEN, WORTH_A_DOZEN = 12, 48_000
#: Pairs a step, noise nodes that they share, and the weight of all noise of a pair.
BATCH, NOISE, NOISE_WEIGHT = 1024, 64, 5.0
RATE = 0.1
_PLACE = 17


def block_count(nodes: int, links: int, walks: int, walks_a_task: int) -> int:
    """1, or an even number of blocks that bounds the nodes, links and walks of a block."""
    need = max(-(-nodes // NODES_A_BLOCK), -(-links // LINKS_A_BLOCK), -(-walks // walks_a_task), 1)
    step = DOZEN if nodes >= WORTH_A_DOZEN else 2
    return 1 if need == 1 else step * -(-need // step)


def meetings(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(round, task) by two blocks: every two meet once, in each round every block is in one task; a block meets itself in round 0."""
    when, where = np.zeros((blocks, blocks), int), np.zeros((blocks, blocks), int)
    for r in range(blocks - 1):
        for k in range(blocks // 2):
            a, b = (blocks - 1, r) if k == 0 else ((r + k) % (blocks - 1), (r - k) % (blocks - 1))
            when[a, b] = when[b, a] = r
            where[a, b] = where[b, a] = k
            if r == 0:
                where[a, a] = where[b, b] = k
    return when, where


def numbered(adjacency: DataFrame, blocks: int) -> DataFrame:
    """(node, id): block and place of each node as one number."""
    nodes = adjacency.select("node").distinct().withColumn("b", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("node")) - 1
    return materialise(nodes.select("node", F.shiftleft("b", _PLACE).bitwiseOR(place).alias("id")), "ids")


def _by_block(batches: Iterator[pa.RecordBatch], *columns: str) -> dict[int, list]:
    """The rows of a task by the first column."""
    found = defaultdict(list)
    for b in batches:
        for first, *rest in zip(*(b[c] if c == "data" else b[c].to_pylist() for c in columns)):
            found[first].append([x.as_buffer() if isinstance(x, pa.Scalar) else x for x in rest])
    return found


_SENT = "block int, kind int, data binary"
_LINKS, _WALKS = 0, 1


def _rows(schema: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.values())], list(schema))


_SENT_ARROW = {"block": pa.int32(), "kind": pa.int32(), "data": pa.binary()}
_PAIR_ARROW = {"round": pa.int32(), "task": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "data": pa.binary()}


def _packed_links(links: DataFrame, blocks: int) -> DataFrame:
    """A row a block of (id, nbr): the sorted links as place and neighbour in one number."""
    key = F.shiftleft((F.col("id") % (1 << _PLACE)).cast("bigint"), 32).bitwiseOR(F.col("nbr").cast("bigint"))
    rows = links.select(F.shiftright("id", _PLACE).alias("block"), key.alias("key"))
    rows = rows.unionByName(links.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(-1).cast("bigint").alias("key")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["block"].to_numpy(), b["key"].to_numpy()) for b in batches]
        if held:
            block, key = (np.concatenate(x) for x in zip(*held))
            for b in np.unique(block[key < 0]):
                yield from _rows(_SENT_ARROW, [(b, _LINKS, np.sort(key[(block == b) & (key >= 0)]).tobytes())])

    return materialise(rows.repartitionById(blocks, F.col("block")).mapInArrow(pack, _SENT), "links")


def _hashed(seed: int, x: np.ndarray) -> np.ndarray:
    return _mixed(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.array([seed], np.uint64) + np.uint64(0xD1B54A32D192ED03)))


def _span(keys: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of the node in the block's links, degree)."""
    place = (id & ((1 << _PLACE) - 1)).astype(np.int64)
    lo = np.searchsorted(keys, place << 32)
    return lo, np.searchsorted(keys, (place + 1) << 32) - lo


def _linked(keys: np.ndarray, id: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the block's links, whether it is there) of the links from id to other."""
    asked = ((id & ((1 << _PLACE) - 1)).astype(np.int64) << 32) | other
    at = np.searchsorted(keys, asked)
    return at, (keys[np.minimum(at, len(keys) - 1)] == asked) if len(keys) else np.zeros(len(asked), bool)


def started(block: int, nodes: int, keys: np.ndarray, walks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(walk, path) of all walks of a block's nodes after the first step; nodes without links have none."""
    first = np.repeat((block << _PLACE) | np.arange(nodes, dtype=np.int64), walks)
    walk = first * walks + np.tile(np.arange(walks), nodes)
    lo, d = _span(keys, first)
    walk, first, lo, d = (x[d > 0] for x in (walk, first, lo, d))
    i = (_hashed(seed + 1, walk) % d.astype(np.uint64)).astype(np.int64)
    return walk, np.stack([first, keys[lo + i] & 0xFFFFFFFF], axis=1).astype(np.int32)


def proposed(walk: np.ndarray, path: np.ndarray, keys: np.ndarray, p: float, q: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, offers) of next nodes of walks that stand in the block; the last offer to a walk is taken if none before is."""
    now, prev = path[:, -1], path[:, -2]
    lo, d = _span(keys, now)
    at, there = _linked(keys, now, prev)
    owner, t, i, _ = proposals(_hashed(seed + path.shape[1], walk), d, np.where(there, at - lo, -1), p, q)
    order = np.lexsort((t, owner))
    owner, i = owner[order], i[order]
    return np.bincount(owner, minlength=len(walk)).astype(np.int32), (keys[lo[owner] + i] & 0xFFFFFFFF).astype(np.int32)


def taken(path: np.ndarray, number: np.ndarray, offers: np.ndarray, keys: np.ndarray, q: float) -> np.ndarray:
    """The offer that each walk takes, by the links of the nodes before the last."""
    owner = np.repeat(np.arange(len(path)), number)
    _, near = _linked(keys, path[owner, -2], offers)
    last = np.cumsum(number) - 1
    kept = near if 1 / q < 1 else ~near
    kept[last] = True
    at = np.flatnonzero(kept)
    return offers[at[np.unique(owner[at], return_index=True)[1]]]


def pairs_of(walk: np.ndarray, path: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of nodes at most ``window`` apart, a pair d apart with probability 1 - (d - 1) / window, as skip-gram's shrunken windows have it; each stands for both directions."""
    a, b = [], []
    length = path.shape[1]
    for d in range(1, min(window, length - 1) + 1):
        for i in range(length - d):
            drawn = (_hashed(seed - 1, walk * (length * window) + (i * window + d - 1)) >> np.uint64(11)) < np.uint64((window + 1 - d) / window * 2**53)
            a.append(path[drawn, i])
            b.append(path[drawn, i + d])
    return np.concatenate(a), np.concatenate(b)


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Pairs of places: the low 16 bits of each, then all high bits."""
    return pairs.astype(np.uint16).tobytes() + np.packbits((pairs >> 16).astype(np.uint8).ravel()).tobytes()


def unpacked_pairs(data) -> np.ndarray:
    n = 4 * len(data) // 17
    high = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * n), count=2 * n)
    return (np.frombuffer(data, np.uint16, 2 * n).astype(np.int32) | (high.astype(np.int32) << 16)).reshape(n, 2)


def _sent_pairs(walk: np.ndarray, path: np.ndarray, window: int, seed: int, when: np.ndarray, where: np.ndarray) -> list[tuple]:
    a, b = pairs_of(walk, path, window, seed)
    swap = (a >> _PLACE) > (b >> _PLACE)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    meet = (a >> _PLACE).astype(np.int64) * len(when) + (b >> _PLACE)
    order = np.argsort(meet, kind="stable")
    meet, both = meet[order], np.stack([a[order], b[order]], axis=1) & ((1 << _PLACE) - 1)
    at = np.flatnonzero(np.diff(meet, prepend=-1))
    cuts = [(*divmod(int(meet[s]), len(when)), packed_pairs(both[s:e])) for s, e in zip(at, [*at[1:], len(meet)])]
    return [(when[lo, hi], where[lo, hi], lo, hi, data) for lo, hi, data in cuts]


def _pack(walk: np.ndarray, path: np.ndarray, number: np.ndarray, offers: np.ndarray) -> bytes:
    return b"".join([np.array([len(walk), len(offers)], np.int64).tobytes(), walk.tobytes(), path.tobytes(), number.tobytes(), offers.tobytes()])


def _unpack(sent: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [[np.empty(0, np.int64), np.empty((0, k), np.int32), np.empty(0, np.int32), np.empty(0, np.int32)]]
    for data in sent:
        n, m = np.frombuffer(data, np.int64, 2)
        rest = np.frombuffer(data, np.int32, n * k + n + m if len(data) > 16 + 8 * n + 4 * n * k + 4 * m else n * k, 16 + 8 * n)
        number = rest[n * k : n * k + n]
        parts.append([np.frombuffer(data, np.int64, n, 16), rest[: n * k].reshape(n, k), number, rest[n * k + len(number) :]])
    return tuple(np.concatenate(x) for x in zip(*parts))


def _to_blocks(to: np.ndarray, walk: np.ndarray, path: np.ndarray, number: np.ndarray | None = None, offers: np.ndarray | None = None) -> list[tuple]:
    """Messages of walks that are sorted by ``to``."""
    none = np.empty(0, np.int32)
    at = np.flatnonzero(np.diff(to, prepend=-1))
    ends = np.concatenate([[0], np.cumsum(number)]) if number is not None else None
    cut = lambda s, e: (number[s:e], offers[ends[s] : ends[e]]) if number is not None else (none, none)
    return [(to[s], _WALKS, _pack(walk[s:e], path[s:e], *cut(s, e))) for s, e in zip(at, [*at[1:], len(to)])]


def walk_pairs_by_meeting(links: DataFrame, sizes: dict[int, int], blocks: int, length: int, walks: int, p: float, q: float, window: int, seed: int) -> DataFrame:
    """(round, task, lo, hi, data): the pairs of all walks by the blocks of their nodes.

    A walk goes to its node's block for offers of a next node and to that of
    the node before for the choice among them.
    """
    when, where = meetings(blocks)

    def stage(work: Callable, arrow: dict) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, rows in _by_block(batches, "block", "kind", "data").items():
                keys = next(np.frombuffer(d, np.int64) for kind, d in rows if kind == _LINKS)
                yield from _rows(arrow, work(block, keys, [d for kind, d in rows if kind == _WALKS]))

        return run

    def onward(walk: np.ndarray, path: np.ndarray) -> list[tuple]:
        if path.shape[1] == length:
            return _sent_pairs(walk, path, window, seed, when, where) if len(walk) else []
        order = np.argsort(path[:, -1] >> _PLACE, kind="stable")
        return _to_blocks(path[order, -1] >> _PLACE, walk[order], path[order])

    def start(block: int, keys: np.ndarray, _: list) -> list[tuple]:
        return onward(*started(block, sizes.get(block, 0), keys, walks, seed))

    def propose(k: int) -> Callable:
        def work(_: int, keys: np.ndarray, sent: list) -> list[tuple]:
            walk, path, *_ = _unpack(sent, k)
            order = np.argsort(path[:, -2] >> _PLACE, kind="stable")
            walk, path = walk[order], path[order]
            return _to_blocks(path[:, -2] >> _PLACE, walk, path, *proposed(walk, path, keys, p, q, seed))

        return work

    def take(k: int) -> Callable:
        def work(_: int, keys: np.ndarray, sent: list) -> list[tuple]:
            walk, path, number, offers = _unpack(sent, k)
            if not len(walk):
                return []
            return onward(walk, np.concatenate([path, taken(path, number, offers, keys, q)[:, None]], axis=1))

        return work

    spent: list[DataFrame] = []
    meeting = "round int, task int, lo int, hi int, data binary"
    kind = lambda done: (meeting, _PAIR_ARROW) if done else (_SENT, _SENT_ARROW)
    schema, arrow = kind(length == 2)
    state = links.repartitionById(blocks, F.col("block")).mapInArrow(stage(start, arrow), schema)
    for k in range(2, length):
        here = materialise(state, "walks")
        offered = materialise(here.unionByName(links).repartitionById(blocks, F.col("block")).mapInArrow(stage(propose(k), _SENT_ARROW), _SENT), "offers")
        discard(here)
        release(links.sparkSession)
        schema, arrow = kind(k == length - 1)
        state = offered.unionByName(links).repartitionById(blocks, F.col("block")).mapInArrow(stage(take(k), arrow), schema)
        spent.append(offered)
        if len(spent) > 1:
            discard(spent.pop(0))
    pairs = materialise(state, "pairs", by="round")
    for cut in spent:
        discard(cut)
    release(links.sparkSession)
    return pairs


def _add(x: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """Adagrad by row: equal rows' gradients are summed first."""
    order = np.argsort(at, kind="stable")
    rows = at[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    number = np.diff(first, append=len(rows))
    rows, total, many = rows[first], g[order[first]], number > 1
    if many.any():
        total[many] = np.add.reduceat(g[order[np.repeat(many, number)]], np.cumsum(number[many]) - number[many], axis=0)
    squares[rows] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    x[rows] += total * (RATE / np.sqrt(squares[rows] + 1e-10))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_pairs(one: list[np.ndarray], other: list[np.ndarray], pairs: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of skip-gram with noise over the pairs of two blocks, in both directions; a block is (vectors, contexts, squares of each)."""
    pairs = pairs[rng.permutation(len(pairs))].astype(np.int64)
    sides = []
    for (source, target), (u, v) in (((one, other), (0, 1)), ((other, one), (1, 0))):
        share = np.bincount(pairs[:, v], minlength=len(target[1])) ** 0.75
        sides.append((source, target, u, v, np.cumsum(share) / share.sum()))
    for at in range(0, len(pairs), BATCH):
        for source, target, u, v, noise in sides:
            a, b = pairs[at : at + BATCH, u], pairs[at : at + BATCH, v]
            z = np.minimum(np.searchsorted(noise, rng.random(NOISE)), len(noise) - 1)
            x, y, n = source[0][a], target[1][b], target[1][z]
            pull = (1 - _sigmoid(np.einsum("ij,ij->i", x, y)))[:, None]
            push = _sigmoid(x @ n.T) * np.float32(NOISE_WEIGHT / NOISE)
            _add(source[0], source[2], a, pull * y - push @ n)
            _add(target[1], target[3], np.concatenate([b, z]), np.concatenate([pull * x, -push.T @ x]))


def _signs(seed: int, id: np.ndarray, dimension: int) -> np.ndarray:
    """A row of random signs for each node, the same in every task."""
    wide = -(-dimension // 64)
    drawn = _hashed(seed, np.repeat(id.astype(np.int64) * wide, wide) + np.tile(np.arange(wide), len(id)))
    return np.unpackbits(drawn.view(np.uint8).reshape(len(id), 8 * wide), axis=1, count=dimension).astype(np.float32) * 2 - 1


def first_vectors(seed: int, block: int, nodes: int, keys: np.ndarray, dimension: int, part: int = 1 << 18) -> list[np.ndarray]:
    """A block before training: contexts are random signs, vectors the unit sums of the neighbours' ones, so that all blocks have one frame from the start."""
    own = _signs(seed, (block << _PLACE) + np.arange(nodes), dimension)
    x = np.zeros((nodes, dimension), np.float32)
    for s in range(0, len(keys), part):
        place, nbr = keys[s : s + part] >> 32, keys[s : s + part] & 0xFFFFFFFF
        at = np.flatnonzero(np.diff(place, prepend=-1))
        x[place[at]] += np.add.reduceat(_signs(seed, nbr, dimension), at, axis=0)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.where(size > 0, x / np.maximum(size, 1), own / np.float32(np.sqrt(dimension)))
    return [x, own / np.float32(np.sqrt(dimension)), np.zeros(nodes, np.float32), np.zeros(nodes, np.float32)]


def skip_gram(links: DataFrame, pairs: DataFrame, sizes: dict[int, int], blocks: int, dimension: int, seed: int) -> DataFrame:
    """(block, data): the vectors of each block, trained on all pairs once; ``links`` is deleted.

    In a round each task has two blocks, and the pairs between them; after all
    rounds every two have met.
    """
    spark = pairs.sparkSession
    when, where = meetings(blocks)
    split = lambda data, n: [np.frombuffer(data, np.float32, n * w, 4 * n * o).reshape((n, w) if w > 1 else n).copy() for w, o in ((dimension, 0), (dimension, dimension), (1, 2 * dimension), (1, 2 * dimension + 1))]
    model_arrow = {"block": pa.int32(), "data": pa.binary()}

    def train(r: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _by_block(batches, "task", "vectors", "lo", "hi", "data").values():
                held = {lo: split(d, sizes[lo]) for vectors, lo, _, d in rows if vectors}
                met = defaultdict(list)
                for vectors, lo, hi, d in rows:
                    if not vectors:
                        met[lo, hi].append(unpacked_pairs(d))
                for lo, hi in sorted(met):
                    own = np.concatenate(met.pop((lo, hi)))
                    own = own[np.lexsort((own[:, 1], own[:, 0]))]
                    train_pairs(held[lo], held[hi], own, np.random.default_rng([seed, r, lo, hi]))
                for block in sorted(held):
                    yield from _rows(model_arrow, [(block, b"".join(x.tobytes() for x in held.pop(block)))])

        return run

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, [[data]] in _by_block(batches, "block", "data").items():
            if block in sizes:
                yield from _rows(model_arrow, [(block, b"".join(x.tobytes() for x in first_vectors(seed, block, sizes[block], np.frombuffer(data, np.int64), dimension)))])

    model = materialise(links.repartitionById(blocks, F.col("block")).mapInArrow(start, "block int, data binary"), "model")
    discard(links)
    for r in range(max(1, blocks - 1)):
        with_whom = [next((where[a, b] for b in range(blocks) if b != a and when[a, b] == r), 0) for a in range(blocks)]
        task = F.element_at(F.array(*[F.lit(int(t)) for t in with_whom]), F.col("block") + 1)
        held = model.select(task.alias("task"), F.lit(True).alias("vectors"), F.col("block").alias("lo"), F.col("block").alias("hi"), "data")
        rows = held.unionByName(pairs.filter(F.col("round") == r).select("task", F.lit(False).alias("vectors"), "lo", "hi", "data"))
        after = materialise(rows.repartitionById(max(1, blocks // 2), F.col("task")).mapInArrow(train(r), "block int, data binary"), "model")
        discard(model)
        model = after
        release(spark)
    return model


def walk_vectors(adjacency: DataFrame, dimension: int, length: int, walks: int, p: float, q: float, window: int, seed: int, walks_a_task: int) -> DataFrame:
    """(node, vec) by skip-gram with noise over second-order walks; ``adjacency`` has each link in both directions."""
    nodes, links = adjacency.agg(F.count_distinct("node"), F.count("*")).first()
    blocks = block_count(nodes, links, nodes * walks, walks_a_task)
    ids = numbered(adjacency, blocks)
    sizes = {r.b: r.n for r in ids.groupBy(F.shiftright("id", _PLACE).alias("b")).agg(F.count("*").alias("n")).collect()}
    once = adjacency.filter("node < nbr").join(ids.select(F.col("node").alias("nbr"), F.col("id").alias("_to")), "nbr").join(ids, "node")
    linked = once.select(F.inline(F.array(F.struct(F.col("id"), F.col("_to").alias("nbr")), F.struct(F.col("_to").alias("id"), F.col("id").alias("nbr")))))
    packed = _packed_links(linked, blocks)
    pairs = walk_pairs_by_meeting(packed, sizes, blocks, length, walks, p, q, window, seed)
    model = skip_gram(packed, pairs, sizes, blocks, dimension, seed)
    discard(pairs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, [[data]] in _by_block(batches, "block", "data").items():
            n = sizes[block]
            x = np.frombuffer(data, np.float32, n * dimension)
            for s in range(0, n, 10_000):
                own = x[s * dimension : (s + 10_000) * dimension]
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) + 1, dimension), pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array((block << _PLACE) + np.arange(s, s + len(vec)), pa.int32()), vec], ["id", "vec"])

    named = ids.join(model.mapInArrow(rows, "id int, vec array<float>"), "id")
    return named.select("node", F.col("vec").cast("array<double>").alias("vec"))
