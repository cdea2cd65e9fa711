"""Reproducible, leakage-checked splits, negatives and samples.

All choices are orders of md5 of a seed and the key, so any SQL engine repeats
them and a larger sample contains the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import draw, keyed_md5
from edgeloom.operators.edges import degree_rows
from edgeloom.plans.durable import discard, materialise
from edgeloom.plans.ranking import dense_index, ranked

SEED = 42


def protected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (n1, n2) with ``protected``: an end has a single row in the whole graph."""
    single = degree_rows(edges).filter("degree = 1").select("node")
    a = pairs.join(single.select(F.col("node").alias("n1"), F.lit(True).alias("_a")), "n1", "left")
    b = a.join(single.select(F.col("node").alias("n2"), F.lit(True).alias("_b")), "n2", "left")
    return b.withColumn("protected", F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).select(*pairs.columns, "protected")


def split_edges(pairs: DataFrame, edges: DataFrame, val: float = 0.1, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """(n1, n2, protected, split): exact shares of all pairs, taken from the unprotected in hash order; the rest is train."""
    marked = protected(pairs.select("n1", "n2").distinct(), edges).withColumn("_h", keyed_md5(seed, "n1", "n2"))
    total = marked.agg(F.count("*").alias("_n"))
    places = ranked(marked, ["protected"], ["_h", "n1", "n2"], "_r").crossJoin(total)
    n_val, n_test = F.bround(F.col("_n") * val), F.bround(F.col("_n") * test)
    split = F.when(F.col("protected"), "train").when(F.col("_r") <= n_val, "val").when(F.col("_r") <= n_val + n_test, "test").otherwise("train")
    return places.select("n1", "n2", "protected", split.alias("split"))


def split_tasks(pairs: DataFrame, edges: DataFrame, val: float = 0.1, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """(task, n1, n2, protected, split): ``split_edges`` of each task of ``pairs`` (task, n1, n2) by its own, in one pass."""
    marked = materialise(protected(pairs.select("task", "n1", "n2").distinct(), edges).withColumn("_h", keyed_md5(seed, "n1", "n2")), "marked")
    totals = marked.groupBy("task").agg(F.count("*").alias("_n"))
    places = ranked(marked, ["task", "protected"], ["_h", "n1", "n2"], "_r").join(totals, "task")
    n_val, n_test = F.bround(F.col("_n") * val), F.bround(F.col("_n") * test)
    split = F.when(F.col("protected"), "train").when(F.col("_r") <= n_val, "val").when(F.col("_r") <= n_val + n_test, "test").otherwise("train")
    return places.select("task", "n1", "n2", "protected", split.alias("split"))


def cold_start(pairs: DataFrame, edges: DataFrame, val: float = 0.1, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """(n1, n2, split): all pairs of one n1 together; nodes with one row in the graph are train."""
    nodes = pairs.select(F.col("n1").alias("node")).distinct().join(degree_rows(edges), "node", "left")
    marked = nodes.select("node", (F.col("degree") == 1).alias("single"), keyed_md5(seed, "node").alias("_h"))
    total = marked.agg(F.count("*").alias("_n"))
    places = ranked(marked, ["single"], ["_h", "node"], "_r").crossJoin(total)
    n_val, n_test = F.bround(F.col("_n") * val), F.bround(F.col("_n") * test)
    split = F.when(F.col("single"), "train").when(F.col("_r") <= n_val, "val").when(F.col("_r") <= n_val + n_test, "test").otherwise("train")
    return pairs.select("n1", "n2").distinct().join(places.select(F.col("node").alias("n1"), split.alias("split")), "n1").select("n1", "n2", "split")


def negatives(left: DataFrame, right: DataFrame, positives: DataFrame, need: int, symmetric: bool = False, seed: int = SEED) -> DataFrame:
    """(n1, n2, place): ``need`` typed pairs that are no positives, no self-pairs and distinct, numbered from 1 in draw order, or all there are if that is fewer.

    Draws are hashed places in the sorted universes, three times what is
    needed (2000 at least) and twice as many each round, so the cross product
    is never made. Where more than half of the free pairs are needed, these
    are listed instead and put in hash order: their number is then at most
    twice the need, and the positives and self-pairs besides.
    """
    return negatives_among(universe(left), universe(right), positives, need, symmetric, seed)


def universe(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The distinct nodes (node, idx) in their order, written once, and their number."""
    index = materialise(dense_index(nodes, "node"), "universe")
    return index, index.count()


def negatives_among(left: tuple[DataFrame, int], right: tuple[DataFrame, int], positives: DataFrame, need: int, symmetric: bool = False, seed: int = SEED) -> DataFrame:
    """``negatives`` of two universes that several calls may share."""
    (a, n_a), (b, n_b) = left, right
    spark = a.sparkSession
    if not n_a or not n_b or need <= 0:
        return spark.createDataFrame([], "n1 string, n2 string, place bigint")
    na, nb = a.select(F.col("node").alias("x"), F.col("idx").alias("ia")), b.select(F.col("node").alias("y"), F.col("idx").alias("ib"))
    taken = positives.select(*_ordered(F.col("n1"), F.col("n2"), symmetric)).distinct()
    both = a.join(b.select("node"), "node", "left_semi").count()
    # Pairs of two nodes of both universes count once if there is no order.
    pairs = n_a * n_b - both - (both * (both - 1) // 2 if symmetric else 0)
    reachable = taken.filter("n1 <> n2").join(na.select(F.col("x").alias("n1"), F.lit(1).alias("_a1")), "n1", "left").join(nb.select(F.col("y").alias("n2"), F.lit(1).alias("_b2")), "n2", "left")
    if symmetric:
        reachable = reachable.join(nb.select(F.col("y").alias("n1"), F.lit(1).alias("_b1")), "n1", "left").join(na.select(F.col("x").alias("n2"), F.lit(1).alias("_a2")), "n2", "left")
        inside = (F.col("_a1").isNotNull() & F.col("_b2").isNotNull()) | (F.col("_b1").isNotNull() & F.col("_a2").isNotNull())
    else:
        inside = F.col("_a1").isNotNull() & F.col("_b2").isNotNull()
    free = pairs - reachable.filter(inside).count()
    if 2 * need > free:
        every = spark.range(n_a * n_b).select((F.col("id") % n_a).alias("ia"), F.floor(F.col("id") / n_a).alias("ib"))
        listed = every.join(na, "ia").join(nb, "ib").filter("x <> y").select(*_ordered(F.col("x"), F.col("y"), symmetric)).distinct().join(taken, ["n1", "n2"], "left_anti")
        return ranked(listed.withColumn("_h", keyed_md5(seed, F.lit("free"), "n1", "n2")), [], ["_h", "n1", "n2"], "place").filter(F.col("place") <= need).select("n1", "n2", "place")
    upto = max(2000, 3 * need)
    while True:
        picks = spark.range(upto).select("id", draw(seed, n_a, F.lit("a"), "id").alias("ia"), draw(seed, n_b, F.lit("b"), "id").alias("ib"))
        named = picks.join(na, "ia").join(nb, "ib").filter("x <> y")
        fresh = materialise(named.select("id", *_ordered(F.col("x"), F.col("y"), symmetric)).join(taken, ["n1", "n2"], "left_anti").groupBy("n1", "n2").agg(F.min("id").alias("id")), "fresh")
        if fresh.count() >= need:  # half of the free pairs at most, so a few rounds are enough
            return ranked(fresh, [], ["id"], "place").filter(F.col("place") <= need).select("n1", "n2", "place")
        discard(fresh)
        upto *= 2


def _ordered(x: Column, y: Column, symmetric: bool) -> list[Column]:
    return [F.least(x, y).alias("n1"), F.greatest(x, y).alias("n2")] if symmetric else [x.alias("n1"), y.alias("n2")]


def stratified_sample(rows: DataFrame, stratum: str, key: list[str], fraction: Column | float, seed: int = SEED) -> DataFrame:
    """Exactly max(1, round(n * fraction)) rows of each stratum, the first in hash order, so smaller samples nest in larger ones."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    places = ranked(rows.withColumn("_h", keyed_md5(seed, *key)), [stratum], ["_h", *key], "_r").join(sizes, stratum)
    share = F.lit(fraction) if isinstance(fraction, float) else fraction
    return places.filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).select(*rows.columns)


def scales(edges: DataFrame, percents: tuple[int, ...], seed: int = SEED) -> DataFrame:
    """(scale, edge_id, node1, node2, relation, rescued): for each share in percent, edges (edge_id, node1, node2, relation) of a nested sample by relation.

    An edge with an end that no other edge names is in every scale. A node
    that a scale would still lose gets its edge of the smallest edge_id back,
    as rescued. One ranking serves all scales.
    """
    degree = edges.select(F.explode(F.array("node1", "node2")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    single = degree.filter("d = 1").select("node", F.lit(True).alias("only"))
    placed = ranked(edges.withColumn("_h", keyed_md5(seed, "edge_id")), ["relation"], ["_h", "edge_id"], "_r")
    sized = placed.join(edges.groupBy("relation").agg(F.count("*").alias("_t")), "relation")
    for end in ("node1", "node2"):
        sized = sized.join(single.select(F.col("node").alias(end), F.col("only").alias(f"_{end}")), end, "left")
    kept = (F.col("_node1").isNotNull() | F.col("_node2").isNotNull()) | (F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_t") * (F.col("scale") / 100.0))))
    every = sized.withColumn("scale", F.explode(F.array(*map(F.lit, percents)))).withColumn("kept", kept).select("scale", "edge_id", "node1", "node2", "relation", "kept")
    every = materialise(every, "scales")
    ends = lambda d: d.select("scale", F.explode(F.array("node1", "node2")).alias("node"), "edge_id")
    lost = ends(every.filter("NOT kept")).join(ends(every.filter("kept")).select("scale", "node").distinct(), ["scale", "node"], "left_anti")
    back = lost.groupBy("scale", "node").agg(F.min("edge_id").alias("edge_id")).select("scale", "edge_id", F.lit(True).alias("back")).distinct()
    out = every.join(back, ["scale", "edge_id"], "left").filter(F.col("kept") | F.col("back").isNotNull())
    return out.select("scale", "edge_id", "node1", "node2", "relation", F.col("back").isNotNull().alias("rescued"))


def guarded_units(counts: DataFrame, train: int = 20, of_class: int = 5) -> DataFrame:
    """``counts`` (n_train, n_pos, n_val, n_test, ...) with ``verdict``: ok, or the first thing that a unit lacks."""
    verdict = F.when(F.col("n_train") < train, "too few train pairs").when(F.col("n_pos") < of_class, "too few positives").when(F.col("n_train") - F.col("n_pos") < of_class, "too few negatives")
    return counts.withColumn("verdict", verdict.when(F.col("n_val") < 1, "no validation").when(F.col("n_test") < 1, "no test").otherwise("ok"))


def rescue(held_out: DataFrame, train: DataFrame, universe: DataFrame) -> DataFrame:
    """The held-out edges (ord, n1, n2, ...) moved back: for each node of ``universe`` that ``train`` (n1, n2) lacks, its first by ord, n1, n2."""
    both = lambda d: d.select(F.explode(F.array("n1", "n2")).alias("node"))
    stranded = universe.select("node").distinct().join(both(train).distinct(), "node", "left_anti")
    own = held_out.select(F.explode(F.array("n1", "n2")).alias("node"), F.struct("ord", "n1", "n2").alias("e")).join(stranded, "node", "left_semi")
    return own.groupBy("node").agg(F.min("e").alias("e")).select("e.*").distinct()


def leak_checks(splits: DataFrame, negatives_: DataFrame) -> DataFrame:
    """(check, n, ok): pairs of two splits, and positives among negatives, each of which must be none."""
    tagged = splits.select("n1", "n2", "split", F.lit(1).alias("pos")).unionByName(negatives_.select("n1", "n2", "split", F.lit(0).alias("pos")))
    # One grouping by pair answers every check.
    met = tagged.groupBy("n1", "n2").agg(*[F.bool_or((F.col("split") == s) & (F.col("pos") == p)).alias(f"{s}{p}") for s in ("train", "val", "test") for p in (0, 1)])
    pairs = {"train_val": ("train1", "val1"), "train_test": ("train1", "test1"), "val_test": ("val1", "test1")}
    counts = [F.count_if(F.col(a) & F.col(b)).alias(name) for name, (a, b) in pairs.items()]
    counts.append(F.count_if((F.col("train1") | F.col("val1") | F.col("test1")) & (F.col("train0") | F.col("val0") | F.col("test0"))).alias("positive_negative"))
    counts.append(F.count_if((F.col("train0").cast("int") + F.col("val0").cast("int") + F.col("test0").cast("int")) > 1).alias("negatives_twice"))
    return met.agg(*counts).unpivot([], [*pairs, "positive_negative", "negatives_twice"], "check", "n").withColumn("ok", F.col("n") == 0)


def task_leak_checks(tasks: DataFrame, positives: DataFrame, negatives_: DataFrame) -> DataFrame:
    """(check, n): four checks a task of (task, n1, n2, split[, protected]) tables, each of which must be none, from one grouping by pair."""
    tagged = positives.select("task", "n1", "n2", "split", F.lit(0).alias("k"), "protected").unionByName(negatives_.select("task", "n1", "n2", "split", F.lit(1).alias("k"), F.lit(False).alias("protected")))
    kinds = lambda k: F.count_distinct(F.when(F.col("k") == k, F.col("split")))
    met = tagged.groupBy("task", "n1", "n2").agg(kinds(0).alias("p"), kinds(1).alias("q"), F.max(F.col("protected") & (F.col("split") != "train")).alias("held"))
    names = {"positives in two splits": F.count_if(F.col("p") > 1), "positives among negatives": F.count_if((F.col("p") > 0) & (F.col("q") > 0)), "negatives in two splits": F.count_if(F.col("q") > 1), "protected held out": F.count_if("held")}
    counts = tasks.join(met.groupBy("task").agg(*[c.alias(n) for n, c in names.items()]), "task", "left").na.fill(0)
    return counts.unpivot(["task"], list(names), "what", "n").select(F.concat_ws(": ", "task", "what").alias("check"), "n")


#: Draws that one task makes, about.
DRAWS_A_TASK = 500_000


def ranking_candidates(positives: DataFrame, pool: DataFrame, known: DataFrame, n: int = 99, seed: int = SEED, most_rounds: int | None = None) -> DataFrame:
    """(n1, n2, candidate, is_true): each positive pair's own n2 and n others of the pool (node) drawn for it.

    Twice n places are drawn by hash; what is the true node, drawn before or a
    known pair in either direction is left out, and the first n stay. Pairs
    that have fewer draw on, twice as many in all each round, until they have
    n or all that the pool allows them; ``most_rounds`` ends that earlier.
    """
    places = materialise(dense_index(pool, "node").withColumnRenamed("node", "candidate"), "pool")
    size = places.count()
    asked = materialise(positives.select("n1", "n2").distinct(), "asked")
    own = asked.select("n1", "n2", F.col("n2").alias("candidate"), F.lit(True).alias("is_true"))
    if not size:
        return own
    taken = known.select(F.explode(F.array(F.struct(F.col("n1"), F.col("n2").alias("candidate")), F.struct(F.col("n2").alias("n1"), F.col("n1").alias("candidate")))).alias("k")).select("k.*").distinct()
    barred = materialise(taken.join(places.select("candidate"), "candidate", "left_semi").select("n1", "candidate"), "barred")
    # The pool's nodes that a pair may draw: not known with n1 and not the true node.
    per = barred.groupBy("n1").agg(F.count("*").alias("_b"))
    true = asked.join(places.select(F.col("candidate").alias("n2"), F.lit(1).alias("_in")), "n2", "left").join(barred.select("n1", F.col("candidate").alias("n2"), F.lit(1).alias("_known")), ["n1", "n2"], "left")
    allowed = true.join(per, "n1", "left").select("n1", "n2", (F.lit(size) - F.coalesce("_b", F.lit(0)) - F.when(F.col("_in").isNotNull() & F.col("_known").isNull(), 1).otherwise(0)).alias("_most"))
    open_ = materialise(allowed.withColumn("_most", F.least("_most", F.lit(n))).filter("_most > 0"), "open")
    found, first, upto, rounds = None, 0, 2 * n, 0
    while (left := open_.count()) and (most_rounds is None or rounds < most_rounds):
        # A table of few bytes would be read, and all its draws made, by one task.
        draws = open_.repartition(-(-left * (upto - first) // DRAWS_A_TASK), "n1", "n2").select("n1", "n2", F.explode(F.sequence(F.lit(first), F.lit(upto - 1))).alias("i"))
        # The planner takes an exploded table for as small as its source, and would broadcast all draws.
        picks = draws.withColumn("idx", draw(seed, size, F.lit("rank"), "n1", "n2", "i")).hint("merge").join(places, "idx").filter("candidate <> n2")
        fresh = picks.hint("merge").join(barred, ["n1", "candidate"], "left_anti").select("n1", "n2", "candidate", "i")
        every = fresh if found is None else fresh.unionByName(found)
        found = materialise(every.groupBy("n1", "n2", "candidate").agg(F.min("i").alias("i")), "drawn")
        have = found.groupBy("n1", "n2").agg(F.count("*").alias("_have"))
        open_ = materialise(open_.join(have, ["n1", "n2"], "left").filter(F.coalesce("_have", F.lit(0)) < F.col("_most")).drop("_have"), "open")
        first, upto, rounds = upto, 2 * upto, rounds + 1
    if found is None:
        return own
    by_draw = F.row_number().over(Window.partitionBy("n1", "n2").orderBy("i"))
    kept = found.withColumn("_r", by_draw).filter(F.col("_r") <= n).select("n1", "n2", "candidate", F.lit(False).alias("is_true"))
    return kept.unionByName(own)
