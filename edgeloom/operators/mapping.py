"""Identifier mappings with a stated cardinality policy, and joins along them.

A mapping is (key, value[, ord]). Rows with a null key or value map nothing.
No join here forces a broadcast: small mappings are broadcast by the planner's
own size limit, large ones are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(mapping: DataFrame) -> DataFrame:
    """(key, value): of each key the value of the smallest (ord, value)."""
    return mapping.dropna(subset=["key", "value"]).groupBy("key").agg(F.min(F.struct("ord", "value")).alias("m")).select("key", "m.value")


def last_wins(mapping: DataFrame) -> DataFrame:
    """(key, value): of each key the value of the largest (ord, value)."""
    return mapping.dropna(subset=["key", "value"]).groupBy("key").agg(F.max(F.struct("ord", "value")).alias("m")).select("key", "m.value")


def one_to_many(mapping: DataFrame) -> DataFrame:
    """(key, value): the distinct pairs."""
    return mapping.select("key", "value").dropna().distinct()


def alias_union(rows: DataFrame, value: str, *aliases: DataFrame | str) -> DataFrame:
    """(key, value): every alias column of the rows as a key; placeholders must be null already."""
    keys = F.explode(F.array(*[F.col(a).cast("string") for a in aliases]))
    return rows.select(keys.alias("key"), F.col(value).alias("value")).dropna().distinct()


def mapped(rows: DataFrame, column: str, mapping: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``rows`` with ``name``; inner drops what has no mapping, left keeps it as null."""
    return rows.join(mapping.select(F.col("key").alias(column), F.col("value").alias(name)), column, how)


def mapped_or_self(rows: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the mapped value, or the value itself."""
    return mapped(rows, column, mapping, name, "left").withColumn(name, F.coalesce(name, column))


def unmapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The rows that the inner mapping drops, null keys included."""
    return rows.join(mapping.select(F.col("key").alias(column)), column, "left_anti")


def expand_pairs(pairs: DataFrame, a: str, b: str, mapping: DataFrame, symmetric: bool = True) -> DataFrame:
    """(n1, n2): both ends through a 1:N mapping, without self-pairs, distinct, in byte order if symmetric."""
    many = one_to_many(mapping)
    both = mapped(mapped(pairs.select(a, b).distinct(), a, many, "x"), b, many, "y").filter("x <> y")
    ends = [F.least("x", "y").alias("n1"), F.greatest("x", "y").alias("n2")] if symmetric else [F.col("x").alias("n1"), F.col("y").alias("n2")]
    return both.select(*ends).distinct()


def bridge(*steps: DataFrame) -> DataFrame:
    """(key, value) along a chain of mappings."""
    return reduce(lambda m, s: mapped(m.withColumnRenamed("value", "_v"), "_v", one_to_many(s), "value").select("key", "value").distinct(), steps[1:], one_to_many(steps[0]))


def ambiguity(mapping: DataFrame) -> DataFrame:
    """(n_keys, n_values, keys_of_many, values_of_many) of the distinct pairs."""
    pairs = one_to_many(mapping)
    by_key = pairs.groupBy("key").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("keys_of_many"))
    by_value = pairs.groupBy("value").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_values"), F.count_if(F.col("n") > 1).alias("values_of_many"))
    return by_key.crossJoin(by_value)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """(key, value, state) from (key, value, reviewed, has_vector): the choice among a key's candidates.

    One reviewed candidate wins; of several, one with a vector if it is the
    only such, else the first in byte order; then the same among unreviewed
    ones. A key whose candidates are all null has the state ``none``.
    """
    c = candidates.groupBy("key").agg(
        *[F.count_distinct(F.when(cond, F.col("value"))).alias(f"n_{n}") for n, cond in _KINDS()],
        *[F.min(F.when(cond, F.col("value"))).alias(f"v_{n}") for n, cond in _KINDS()],
    )
    value, state = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind in ("reviewed", "unreviewed"):
        one, vec = F.col(f"n_{kind}") == 1, F.col(f"n_{kind}_vector") >= 1
        value = value.when(one, F.col(f"v_{kind}")).when((F.col(f"n_{kind}") > 1) & vec, F.col(f"v_{kind}_vector")).when(F.col(f"n_{kind}") > 1, F.col(f"v_{kind}"))
        state = state.when(one, kind).when((F.col(f"n_{kind}") > 1) & vec, f"{kind}_by_vector").when(F.col(f"n_{kind}") > 1, f"{kind}_by_order")
    return c.select("key", value.alias("value"), state.otherwise("none").alias("state"))


def _KINDS():
    reviewed, vector = F.coalesce(F.col("reviewed"), F.lit(False)), F.coalesce(F.col("has_vector"), F.lit(False))
    return [("reviewed", reviewed), ("reviewed_vector", reviewed & vector), ("unreviewed", ~reviewed), ("unreviewed_vector", ~reviewed & vector)]
