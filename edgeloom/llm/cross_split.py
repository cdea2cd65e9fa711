"""Same or near-same records across splits, by similarity-hash fingerprints.

The hashes of each record's features vote on 64 bits. Codes are cut into
radius + keep blocks; two codes within the radius agree in ``keep`` blocks at
least, so for each choice of so many blocks (a permutation that puts them
first) an equi-join by scope and those blocks finds all such pairs. A key of
several blocks is long enough that chance agreements stay few in scopes of
many millions. Candidates within the radius are verified and aggregated.
Codes are made distinct by scope and side first, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import ensg, ensg_number, folded
from edgeloom.plans.durable import materialise

#: Bits in which codes may differ, and blocks that the join's keys have: 6 keys of 32 bits.
RADIUS = 2
KEEP = 2
#: Blocks of the keys of genes, of which a scope has some ten thousand: 3 keys of 21 bits.
GENE_KEEP = 1
#: The radius for running texts, whose features are word shingles: 36 keys of 14 bits. A text of which one shingle in forty differs is found nine times in ten, one at the similarity of 0.8 rarely.
TEXT_RADIUS = 7


def simhash64(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 64-bit similarity hash of each list of feature hashes, given one after the other; 0 for an empty list."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    ends = np.cumsum(sizes)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    some = np.flatnonzero(sizes)
    # So many lists at a time that their bits take some megabytes; a longer list is taken whole.
    step = max(1, 65_536 * max(1, len(some)) // max(1, len(hashes)))
    for at in range(0, len(some), step):
        part = some[at : at + step]
        begin = ends[part[0]] - sizes[part[0]]
        own = np.ascontiguousarray(hashes[begin : ends[part[-1]]], dtype="<i8")
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        votes = np.add.reduceat(2 * bits - 1, ends[part] - sizes[part] - begin, axis=0)
        out[part] = ((votes > 0).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def _code() -> Callable:
    @F.arrow_udf("long")
    def code(hashes: pa.Array) -> pa.Array:
        sizes = np.nan_to_num(np.asarray(hashes.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        return pa.array(simhash64(hashes.flatten().to_numpy(zero_copy_only=False), sizes))

    return code


def coded(records: DataFrame, features: Column) -> DataFrame:
    """``records`` with ``_c``, the similarity hash of the features; 0 for an empty or null list."""
    return records.withColumn("_c", _code()(F.transform(features, lambda x: F.xxhash64(x))))


def blocks_of(code: Column, blocks: int) -> list[Column]:
    """The code in that many blocks of nearly equal width."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(bounds, bounds[1:])]


def near_codes(a: DataFrame, b: DataFrame, scope: list[str], radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """(scope..., left, right): rows of ``a`` and ``b`` (scope..., _t, _c) of one scope whose codes differ in at most ``radius`` bits.

    Each pair comes from the first choice of equal blocks only, so none is
    emitted twice.
    """
    n = radius + keep
    choices = list(combinations(range(n), keep))

    def cut(rows: DataFrame, text: str, code: str) -> DataFrame:
        own = blocks_of(F.col("_c"), n)
        keys = [F.struct(F.lit(sum(1 << i for i in c)).alias("m"), F.xxhash64(*scope, F.lit(t), *[own[i] for i in c]).alias("k")) for t, c in enumerate(choices)]
        return rows.select(*scope, F.col("_t").alias(text), F.col("_c").alias(code), F.inline(F.array(*keys)))

    near = cut(a, "left", "_ca").join(cut(b, "right", "_cb"), ["k", "m", *scope])
    differ = F.col("_ca").bitwiseXOR(F.col("_cb"))
    rest = sum((F.when(x == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(blocks_of(differ, n))), F.lit(0))
    first = F.lit(0)
    for _ in range(keep):
        low = rest.bitwiseAND(-rest)
        first, rest = first + low, rest - low
    return near.filter((F.bit_count(differ) <= radius) & (first == F.col("m"))).select(*scope, "left", "right")


def cross_split_pairs(records: DataFrame, scope: list[str], text: str, held_out: str, features: Callable[[Column], Column], same: Callable[[Column, Column], Column], radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """(scope..., eval_text, train_text): texts of the held-out side that stand, exactly or nearly, on the other side of their scope.

    ``features`` gives the list that is fingerprinted, ``same`` verifies a pair
    whose codes differ in at most ``radius`` bits. Rows with a null in scope,
    text or ``held_out`` count for nothing. Repeated rows come out once.
    """
    distinct = records.select(*scope, F.col(text).alias("_t"), F.col(held_out).alias("_out")).dropna().distinct()
    codes = materialise(coded(distinct, features(F.col("_t"))), "codes")  # both sides of the join read it
    near = near_codes(codes.filter("_out"), codes.filter("NOT _out"), scope, radius, keep)
    return near.filter(same(F.col("left"), F.col("right"))).select(*scope, F.col("left").alias("eval_text"), F.col("right").alias("train_text"))


def shingles(text: Column, words: int = 5) -> Column:
    """The distinct runs of so many words of a text, in lower case; a shorter text is one run."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    n = F.greatest(F.size(w) - (words - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, words), " ")))


def shingle_similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two texts' shingles."""
    x, y = shingles(a), shingles(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def similar_texts(records: DataFrame, scope: list[str], text: str, held_out: str, least: float = 0.8) -> DataFrame:
    """``cross_split_pairs`` of running texts whose shingles of five words have a similarity of ``least`` or more.

    The codes admit texts within TEXT_RADIUS bits: equal ones always, others
    the likelier the fewer shingles differ.
    """
    return cross_split_pairs(records, scope, text, held_out, shingles, lambda a, b: shingle_similarity(a, b) >= least, TEXT_RADIUS)


def gene_features(number: Column) -> Column:
    """Features of a gene's number: itself, and its runs of four digits with their places."""
    padded = F.lpad(number, 11, "0")
    return F.array(F.concat(F.lit("n"), number), *[F.concat(F.lit(f"{i}:"), F.substring(padded, i, 4)) for i in range(4, 9)])


def benchmark_rows(go: DataFrame, biogrid: DataFrame) -> DataFrame:
    """(benchmark, scope_key, split, held_out, number): the genes of both benchmarks by split.

    Numbers come from any spelling and are null where there is none; a row
    without gene, split or scope counts for nothing.
    """
    g = go.select(F.lit("go").alias("benchmark"), F.col("go_term").alias("scope_key"), folded("split").alias("split"), F.col("ensg").alias("gene"))
    g = g.filter("split = 'holdout' OR startswith(split, 'cv_fold')").withColumn("held_out", F.col("split") == "holdout")
    b = biogrid.select(
        F.lit("biogrid").alias("benchmark"), F.concat(F.col("task"), F.lit("/"), F.col("outer_fold").cast("string")).alias("scope_key"), folded("fold_partition").alias("split"),
        F.explode(F.array("ensg_a", "ensg_b")).alias("gene"),
    )
    b = b.filter("split <> ''").withColumn("held_out", F.col("split") == "outer_test")
    return g.unionByName(b).dropna().withColumn("number", ensg_number("gene")).drop("gene")


def gene_counts(go: DataFrame, biogrid: DataFrame) -> DataFrame:
    """(benchmark, scope_key, split, held_out, number, n): rows of each gene by split, written once, as all steps read it."""
    return materialise(benchmark_rows(go, biogrid).groupBy("benchmark", "scope_key", "split", "held_out", "number").agg(F.count("*").alias("n")), "genes").filter("number IS NOT NULL")


def gene_collisions(counted: DataFrame) -> DataFrame:
    """(benchmark, scope_key, ensg, number): genes of ``gene_counts`` held out that also stand on the training side of their scope."""
    pairs = cross_split_pairs(counted, ["benchmark", "scope_key"], "number", "held_out", gene_features, lambda a, b: a == b, keep=GENE_KEEP)
    return pairs.select("benchmark", "scope_key", ensg(F.concat(F.lit("ensg"), F.col("eval_text"))).alias("ensg"), F.col("eval_text").alias("number"))


def collision_counts(counted: DataFrame) -> DataFrame:
    """(benchmark, split, n_collisions, n_rows): collisions with a row in the split, and their rows there."""
    hit = counted.join(gene_collisions(counted), ["benchmark", "scope_key", "number"], "left_semi")
    return hit.groupBy("benchmark", "split").agg(F.count("*").alias("n_collisions"), F.sum("n").alias("n_rows"))
