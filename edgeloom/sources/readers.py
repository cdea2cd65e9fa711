"""Readers of the raw formats. Schemas are given, never inferred; bad rows are counted, not guessed.

All return DataFrames whose scans prune columns and push filters where the
format can. Compressed text that can't be split is one task a file.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotGzip(ValueError):
    """The file is empty or isn't gzip, as when a server answers with a web page."""


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, comment: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Delimited text (plain or gzip) of a schema; lines that begin with ``comment`` are skipped. Empty fields are null."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE")
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """``delimited``, or an empty table where there is no file."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return delimited(spark, path, schema, **options) if there else spark.createDataFrame([], schema)


def lines_after(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """(value) of one text file without its first ``skip`` lines.

    Lines are told by their number in the file's first split, never by their
    text; ``skip`` must be no more than the lines of a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    return lines.filter((F.col("_at") > 0) | (F.col("_n") >= skip)).select("value") if skip else lines.select("value")


def guarded(spark: SparkSession, path: str, names: list[str], sep: str = "\t", comment: str | None = "#", skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with exactly as many fields as names, one row with n_lines and n_rejected)."""
    lines = lines_after(spark, path, skip).filter(F.col("value") != "")
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    parts = lines.select(F.split("value", rf"\Q{sep}\E", -1).alias("p"))
    good = F.size("p") == len(names)
    rows = parts.filter(good).select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    return rows, parts.agg(F.count("*").alias("n_lines"), F.count_if(~good).alias("n_rejected"))


def whitespace(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Headerless text parted by runs of white space; missing fields are null."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def last_column_scores(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(protein1, protein2, score) of space-delimited text with one header line, the score being the last field."""
    p = F.split("value", " ")
    rows = lines_after(spark, path, 1).filter(F.size(p) >= least)
    return rows.select(p[0].alias("protein1"), p[1].alias("protein2"), F.element_at(p, -1).try_cast("int").alias("score")).dropna()


def keyed_directory(spark: SparkSession, path: str, schema: str, sep: str = "\t", key: str = "key") -> DataFrame:
    """All files of a folder as one table, with each file's name as the key."""
    df = spark.read.schema(schema).option("sep", sep).csv(path)
    return df.select("*", F.col("_metadata.file_name").alias(key))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, one row with n_bad) of JSON lines."""
    # The corrupt column alone can't be read from a scan, so the text is parsed by an expression.
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    both = lines.select(row.alias("r"))
    return both.filter("r._bad IS NULL AND r IS NOT NULL").select("r.*").drop("_bad"), both.agg(F.count_if(F.col("r._bad").isNotNull() | F.col("r").isNull()).alias("n_bad"))


def disorders(spark: SparkSession, path: str) -> DataFrame:
    """(orpha, name, gene, kind) of disorder-gene associations in XML whose gene has an Ensembl reference."""
    schema = """OrphaCode string, Name string, DisorderGeneAssociationList struct<DisorderGeneAssociation: array<struct<
      Gene: struct<ExternalReferenceList: struct<ExternalReference: array<struct<Source: string, Reference: string>>>>,
      DisorderGeneAssociationType: struct<Name: string>>>>"""
    d = spark.read.format("xml").option("rowTag", "Disorder").schema(schema).load(path)
    a = d.select("OrphaCode", "Name", F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("a"))
    refs = F.filter("a.Gene.ExternalReferenceList.ExternalReference", lambda x: x["Source"] == "Ensembl")
    return a.select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("orpha"), F.col("Name").alias("name"), F.explode(refs).alias("r"), F.col("a.DisorderGeneAssociationType.Name").alias("kind")).select("orpha", "name", F.col("r.Reference").alias("gene"), "kind")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec) of the text format of word2vec; ids may hold spaces. The first line's count and dimension are checked."""
    head = spark.read.text(path).first()[0].split()
    if len(head) != 2 or not all(h.isdigit() for h in head):
        raise ValueError("no header of count and dimension")
    n, dim = map(int, head)
    p = F.split(F.rtrim("value"), " ")
    rows = lines_after(spark, path, 1).filter(F.size(p) > dim)
    out = rows.select(F.array_join(F.slice(p, F.lit(1), F.size(p) - dim), " ").alias("node"), F.transform(F.slice(p, -dim, dim), lambda x: x.cast("float")).alias("vec"))
    if (found := out.count()) != n:
        raise ValueError(f"the header tells {n} vectors, the file has {found}")
    return out


def npz_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec) of a NumPy archive with node_ids and embeddings; never unpickles."""
    with np.load(path, allow_pickle=False) as z:
        return spark.createDataFrame([(str(i), v.astype(float).tolist()) for i, v in zip(z["node_ids"], z["embeddings"])], "node string, vec array<float>")


def wide_matrix(spark: SparkSession, path: str, sample: str, drop: list[str] = (), sep: str = ",") -> DataFrame:
    """(sample, gene, value): a wide matrix with a header in long form; cells that are no number are null."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path).drop(*drop)
    genes = [c for c in wide.columns if c != sample]
    long = wide.unpivot([sample], genes, "gene", "value")
    return long.select(F.col(sample).alias("sample"), "gene", F.col("value").try_cast("double").alias("value"))


def parquet_tree(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of all Parquet files under a folder, however deep."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).select(*columns)


def result_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All result tables that match a pattern of any file system, one after the other; an empty table where none does."""
    return optional(spark, pattern, schema)


def check_gzip(spark: SparkSession, path: str) -> None:
    """Raise NotGzip unless the file, on any file system, begins as gzip does."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        if (stream.read(), stream.read()) != (0x1F, 0x8B):
            raise NotGzip(path)
    finally:
        stream.close()


def first_column_like(df: DataFrame, *marks: str) -> str | None:
    """The first column whose name holds one of the marks, in their order and regardless of case."""
    for m in marks:
        for c in df.columns:
            if m.lower() in c.lower():
                return c
    return None
