"""Incremental edge ingest: an addition to the batch operators, on the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.text import alnum_key
from edgeloom.operators.edges import edge_table, ends


def edge_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Edges from a folder of Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def new_edges(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Cleaned edges, each key once within the watermark; what comes later than it is dropped."""
    keyed = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).filter("loaded_at IS NOT NULL")
    clean = edge_table(keyed.withColumn("edge_id", F.struct("edge_id", "loaded_at"))).select("*", F.col("edge_id.loaded_at").alias("loaded_at"))
    return clean.withColumn("edge_id", F.col("edge_id.edge_id")).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["node1", "node2", "relation", "database"])


def degree_windows(stream: DataFrame, width: str = "30 days", late: str = "30 days") -> DataFrame:
    """(start, node, degree): rows that name a node, by window of loading time, with late rows up to the watermark."""
    keyed = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    rows = keyed.select("loaded_at", alnum_key("node1").alias("node1"), alnum_key("node2").alias("node2"), "node1_type", "node2_type").filter("node1 <> '' AND node2 <> ''")
    return ends(rows, "loaded_at").groupBy(F.window("loaded_at", width), "node").agg(F.count("*").alias("degree")).select(F.col("window.start").alias("start"), "node", "degree")
