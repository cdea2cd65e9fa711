"""Deterministic pseudo-random draws that Spark and any SQL engine with md5 agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_md5(seed: int, *cols: Column | str) -> Column:
    """md5 of the seed and the columns, joined by ``|``; nulls count as empty."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def draw(seed: int, n: Column | int, *cols: Column | str) -> Column:
    """An integer from 0 to n - 1 out of the first 15 hex digits of ``keyed_md5``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(keyed_md5(seed, *cols), 1, 15), 16, 10).cast("bigint"), n)


def uniform(seed: int, *cols: Column | str) -> Column:
    """A double in (0, 1) on a grid of 2**-52, never 0."""
    return (F.conv(F.substring(keyed_md5(seed, *cols), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
