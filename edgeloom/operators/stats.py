"""Statistical transforms of matrices in long form (sample, gene, value).

A matrix is never made wide. Null and NaN values are left out. Per-gene and
per-sample statistics are aggregates joined back, so a group of any size is
combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.ranking import ranked


def known(matrix: DataFrame) -> DataFrame:
    return matrix.filter("value IS NOT NULL AND NOT isnan(value)")


def mean_of_duplicates(matrix: DataFrame, row: str, column: str) -> DataFrame:
    """(sample, gene, value): mean over repeated raw rows, then over raw columns of one gene, so that each column weighs alike."""
    inner = known(matrix).groupBy("sample", "gene", column).agg(F.avg("value").alias("value"))
    return inner.groupBy("sample", "gene").agg(F.avg("value").alias("value"))


def sparse_genes(matrix: DataFrame, share: float = 0.05) -> DataFrame:
    """The genes with a non-zero value in at least int(share * samples) samples."""
    need = matrix.agg(F.floor(F.countDistinct("sample") * share).alias("need"))
    return known(matrix).groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n")).crossJoin(need).filter("n >= need").select("gene", "n")


def robust_scaled(matrix: DataFrame) -> DataFrame:
    """(sample, gene, value): less the gene's median, over its interquartile range (1 where that is 0)."""
    q = known(matrix).groupBy("gene").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
    width = F.col("q")[2] - F.col("q")[0]
    return known(matrix).join(q, "gene").select("sample", "gene", ((F.col("value") - F.col("q")[1]) / F.when(width == 0, 1.0).otherwise(width)).alias("value"))


def quantile_normalised(matrix: DataFrame) -> DataFrame:
    """(sample, gene, value): each value becomes the mean, over samples, of the values of its place; ties take their first place."""
    placed = ranked(known(matrix).select("sample", "gene", "value"), ["sample"], ["value", "gene"], "place")
    mean = placed.groupBy("place").agg(F.avg("value").alias("mean"))
    first = placed.groupBy("sample", "value").agg(F.min("place").alias("place"))
    return placed.drop("place").join(first, ["sample", "value"]).join(mean, "place").select("sample", "gene", F.col("mean").alias("value"))


def extremes(matrix: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(sample, gene, value, side): the k largest and k smallest values of each sample, ties by gene; beyond +-least if given."""
    rows = known(matrix).select("sample", "gene", "value")
    up = rows.withColumn("r", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), "gene"))).filter(F.col("r") <= k)
    down = rows.withColumn("r", F.row_number().over(Window.partitionBy("sample").orderBy("value", "gene"))).filter(F.col("r") <= k)
    if least is not None:
        up, down = up.filter(F.col("value") >= least), down.filter(F.col("value") <= -least)
    return up.withColumn("side", F.lit("up")).unionByName(down.withColumn("side", F.lit("down"))).drop("r")


def zscore_outliers(counts: DataFrame, key: str, value: str, cutoff: float = 3.0) -> DataFrame:
    """The keys whose value is more than ``cutoff`` population deviations over the mean; none among fewer than three."""
    m = counts.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    return counts.crossJoin(m).filter((F.col("_n") >= 3) & (F.col("_s") > 0) & ((F.col(value) - F.col("_m")) / F.col("_s") > cutoff)).select(key, value)


def without_outliers(pairs: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Distinct pairs (n1, n2) of which neither end is an outlier of degree; both sides are judged on all pairs."""
    p = pairs.select("n1", "n2").distinct()
    for side in ("n1", "n2"):
        bad = zscore_outliers(pairs.select("n1", "n2").distinct().groupBy(side).agg(F.count("*").alias("_d")), side, "_d", cutoff)
        p = p.join(bad.select(side), side, "left_anti")
    return p.select("n1", "n2")


def geometric_mean(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The true geometric mean by key; 0 if a value is 0. Null, NaN and negative values are left out."""
    v = F.col(value)
    good = scores.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0))
    zero = F.bool_or(v == 0)
    return good.groupBy(*keys).agg(F.when(zero, 0.0).otherwise(F.exp(F.avg(F.log(F.when(v > 0, v))))).alias("geomean"), F.count("*").alias("n"))


def top_with_override(scores: DataFrame, group: str, key: str, score: str, always: float, least: float, upto: int) -> DataFrame:
    """By group: all rows of score ``always`` or more, filled up to ``upto`` with those of ``least`` or more, the best first."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    eligible = scores.filter(F.col(score) >= least)
    filled = eligible.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= upto)
    # Rows of the override need no rank, so the window's limit still prunes before the shuffle.
    rest = filled.filter(F.col(score) < always).drop("_r")
    return eligible.filter(F.col(score) >= always).unionByName(rest)
