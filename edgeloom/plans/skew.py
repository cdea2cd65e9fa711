"""Joins and broadcasts that don't depend on even keys or small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with fewer rows than this is never hot.
HOT_ROWS = 200_000
#: Hot keys at most: with N rows in all, a key is hot from N / MOST_HOT rows on, so no more can be.
MOST_HOT = 100_000
#: A table is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 64 << 20
#: Bytes of a broadcast row beside its keys.
ROW_BYTES = 64


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def fits(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table of that many rows may be broadcast."""
    return rows * row_bytes <= limit


def hot_from(groups: DataFrame, keys: list[str], size: str, least: int = HOT_ROWS) -> tuple[int, int]:
    """(rows from which a key is hot, number of hot keys).

    The limit is ``least`` or the MOST_HOT-th part of all rows, and is doubled
    while the hot keys' bytes exceed BROADCAST_BYTES. A key under it has so
    few of all rows that a shuffle task holds it.
    """
    most = groups.agg(F.sum(size).alias("rows")).first().rows or 0
    limit = max(least, -(-most // MOST_HOT), 1)
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys]) + ROW_BYTES
    while True:
        n, held = groups.filter(F.col(size) >= limit).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
        if not n or held <= BROADCAST_BYTES:
            return limit, n
        limit *= 2


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of many ``rows`` with one row a key of ``groups``, whose column ``size`` counts the rows of the key.

    Keys from ``hot_from`` on are salted: the rows of a key are dealt by the
    hash of their other columns to as many parts as the key has limits, and
    its group goes to each part. Only the hot keys and their numbers of parts
    are broadcast, whose number and bytes are bounded. All rows take one scan
    and one shuffle, whatever the number of hot keys; with none it is a plain
    join. Rows that are equal in all columns stay in one part. A null key
    joins nothing.
    """
    limit, hot = hot_from(groups, keys, size, hot_rows)
    if not hot:
        return rows.join(groups, keys)
    parts = F.ceil(F.col(size) / limit).cast("int")
    salts = groups.filter(F.col(size) >= limit).select(*keys, parts.alias("_parts"))
    rest = [c for c in rows.columns if c not in keys] or keys
    salted = rows.join(F.broadcast(salts), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")
