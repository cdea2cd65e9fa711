"""Sinks. Parquet is the table format; the rest are exports of small results."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a text, JSON or HTML export may hold.
EXPORT_ROWS = 1_000_000


def edges_parquet(edges: DataFrame, path: str) -> None:
    """The edge table by relation, so that a task reads its relations only; hot relations are spread over files."""
    edges.repartition(F.col("relation"), F.pmod(F.xxhash64("node1", "node2"), F.lit(16))).write.mode("overwrite").partitionBy("relation").parquet(path)


def sorted_tsv(df: DataFrame, path: str, *order: str) -> None:
    """Tab-separated parts with a header, sorted over all parts in their order."""
    df.orderBy(*(order or df.columns)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def append_results(df: DataFrame, path: str, *by: str) -> None:
    """Results of one unit, added beside those that are there."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def remaining(units: DataFrame, path: str, *by: str) -> DataFrame:
    """The units whose keys have no result at ``path`` yet, so that an interrupted run goes on where it stopped; all if there is no table."""
    spark = units.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return units
    kinds = dict(units.dtypes)
    done = spark.read.parquet(path).select(*[F.col(c).cast(kinds[c]).alias(c) for c in by]).distinct()
    return units.join(done, list(by), "left_anti")


def npz_vectors(vectors: DataFrame, path: str) -> None:
    """A NumPy archive with node_ids and embeddings of a table (node, vec), in the order of the nodes."""
    rows = sorted(_small(vectors.select("node", "vec")), key=lambda r: r.node)
    np.savez(path, node_ids=np.array([r.node for r in rows], dtype=str), embeddings=np.array([r.vec for r in rows], dtype=np.float32))


def _small(df: DataFrame) -> list:
    """The rows of a table of at most EXPORT_ROWS; an error for a larger one, as nothing may be left out."""
    rows = df.limit(EXPORT_ROWS + 1).collect()
    if len(rows) > EXPORT_ROWS:
        raise ValueError(f"an export holds at most {EXPORT_ROWS} rows; write a table instead")
    return rows


def manifest(parts: dict[str, DataFrame | object], path: str) -> None:
    """A JSON file of scalars and small tables."""
    out = {k: [r.asDict(True) for r in _small(v)] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    Path(path).write_text(json.dumps(out, indent=1, default=str, ensure_ascii=False))


def check_report(checks: DataFrame, path: str) -> None:
    """One line a check: OK or FAIL, its name and its count."""
    rows = sorted(_small(checks), key=lambda r: r["check"])
    Path(path).write_text("".join(f"{'OK' if r.ok else 'FAIL'}\t{r['check']}\t{r.n}\n" for r in rows))


def html_table(df: DataFrame, path: str, title: str, rows: int = 1000) -> None:
    """A page with the first rows of a small table."""
    body = df.limit(rows).toPandas().to_html(index=False, border=0)
    Path(path).write_text(f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1>{body}")


def wide_vectors(vectors: DataFrame, dimension: int, *keep: str) -> DataFrame:
    """The keys and e_0001, e_0002, ... of an array column ``vec``."""
    return vectors.select(*keep, *[F.get("vec", F.lit(i)).alias(f"e_{i + 1:04d}") for i in range(dimension)])
