"""Exact ranks without a window over one hot group or over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.durable import materialise

_ROW_BITS = 33


def _cut(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a written table, else written: the bounds of a range partitioning are sampled from it first, which would evaluate it twice."""
    return df if hasattr(df, "_edgeloom_path") else materialise(df, "unranked")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 1 within its group in the order of the columns.

    Rows are range-partitioned by group and order, so a group of any size is
    spread over tasks; a place is the rows of the group in earlier partitions
    plus the place within the partition. Ties take any order, so ``order``
    should be unique. Without a group the whole table is ranked.
    """
    by = [F.col(c) for c in [*group, *order]]
    df = _cut(df)
    rows = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_m", _ROW_BITS)
    sizes = rows.groupBy(*group, part.alias("_p")).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    a, b = rows.withColumn("_p", part).alias("a"), offsets.alias("b")
    on = F.col("a._p") == F.col("b._p")
    for g in group:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    place = (F.col("b._offset") + F.col("a._m") - F.col("b._first") + 1).alias(name)
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], place)


def running_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over the group's rows up to this one in ascending ``order``.

    Rows are range-partitioned by group and order; a running sum is the sums
    of the group's earlier partitions plus the one within the partition, so no
    task sees more of a group than its own range. ``order`` should be unique
    in a group and not null.
    """
    by = [F.col(c) for c in [*group, order]]
    df = _cut(df)
    rows = materialise(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "running")
    parts = rows.groupBy(*group, "_p").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, "_p", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))])
    within = Window.partitionBy(*group, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(within).alias(f"_l{i}") for i, c in enumerate(sums.values())])
    a, b = local.alias("a"), offsets.alias("b")
    on = F.col("a._p") == F.col("b._p")
    for g in group:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"a._l{i}") + F.col(f"b._o{i}")).alias(n) for i, n in enumerate(sums)])


def dense_index(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """(column, idx): the distinct values numbered from 0 in ascending order."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return ranked(values, [], [column], "_r").select(column, (F.col("_r") - 1).alias(name))


def top_within(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; the limit is applied before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)
