"""Orphan references of the evaluation pairs (queries p2_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.text import folded
from edgeloom.operators.references import orphan_references
from edgeloom.session import table


def eval_pair_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, ref_column, run_id, split, loaded_at), one row for each orphan reference as delivered."""
    pairs = table(spark, sf_dir, "eval_pairs").select("pair_id", "run_id", "split", "n1", "n2", "loaded_at").withColumn("run_key", folded("run_id"))
    runs = table(spark, sf_dir, "seccion12_tabla_completa").select(folded("run_id").alias("run_key"), folded("source").alias("run_source"))
    sources = runs.filter("run_key IS NOT NULL").groupBy("run_key").agg(F.min("run_source").alias("run_source"), F.lit(True).alias("known"))
    key = lambda end: F.when(F.col("known"), F.concat_ws("|", F.lit("emb"), F.coalesce("run_source", F.lit("")), folded(end)))
    refs = pairs.join(sources, "run_key", "left").select(
        "pair_id", "run_id", "split", "loaded_at",
        F.explode(F.array(
            F.struct(F.lit("run_id").alias("ref_column"), F.concat(F.lit("run|"), F.col("run_key")).alias("ref_key")),
            *[F.struct(F.lit(e).alias("ref_column"), F.when(F.col(e).isNotNull(), key(e)).alias("ref_key")) for e in ("n1", "n2")],
        )).alias("r"),
    ).select("pair_id", "run_id", "split", "loaded_at", "r.*")
    vectors = table(spark, sf_dir, "embedding_catalog").select(
        F.concat_ws("|", F.lit("emb"), folded("embedding_source"), folded("node_id")).alias("ref_key"), "exported_at", "retired_at", F.lit(False).alias("always")
    ).filter("embedding_source IS NOT NULL AND node_id IS NOT NULL")
    named = sources.select(F.concat(F.lit("run|"), F.col("run_key")).alias("ref_key"), F.lit(None).cast("timestamp_ntz").alias("exported_at"), F.lit(None).cast("timestamp_ntz").alias("retired_at"), F.lit(True).alias("always"))
    return orphan_references(refs, vectors.unionByName(named), "ref_key", "loaded_at", "exported_at", "retired_at", "always").drop("ref_key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, ref_column): each distinct orphan reference of eval_pairs."""
    return eval_pair_orphans(spark, sf_dir).select("pair_id", "ref_column").distinct()


def p2_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_column, month, n_orphans): distinct orphan references by column and month of loading; month is null where loaded_at is."""
    distinct = eval_pair_orphans(spark, sf_dir).select("pair_id", "ref_column", F.date_format("loaded_at", "yyyy-MM").alias("month")).distinct()
    return distinct.groupBy("ref_column", "month").agg(F.count("*").alias("n_orphans"))


def p2_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: reported and counted dropped pairs of train and test, and whether the report is right.

    A pair is dropped if an end is null or an orphan. Runs without pairs count 0.
    """
    orphans = eval_pair_orphans(spark, sf_dir).filter(F.col("ref_column") != "run_id").select("pair_id").distinct()
    pairs = table(spark, sf_dir, "eval_pairs").select("pair_id", folded("run_id").alias("run_key"), F.lower("split").alias("split"), (F.col("n1").isNull() | F.col("n2").isNull()).alias("holed"))
    bad = pairs.filter("holed").select("pair_id").union(orphans).distinct()
    dropped = pairs.filter("split IN ('train', 'test')").select("pair_id", "run_key", "split").distinct().join(bad, "pair_id", "left_semi")
    counted = dropped.groupBy("run_key").agg(
        F.count_if(F.col("split") == "train").alias("found_dropped_train"), F.count_if(F.col("split") == "test").alias("found_dropped_test")
    )
    runs = table(spark, sf_dir, "seccion12_tabla_completa").select(folded("run_id").alias("run_key"), "n_dropped_train", "n_dropped_test")
    runs = runs.filter("run_key IS NOT NULL").groupBy("run_key").agg(F.max("n_dropped_train").alias("n_dropped_train"), F.max("n_dropped_test").alias("n_dropped_test"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return runs.join(counted, "run_key", "left").select(
        F.col("run_key").alias("run_id"), "n_dropped_train", "n_dropped_test",
        zero(F.col("found_dropped_train")).alias("found_dropped_train"), zero(F.col("found_dropped_test")).alias("found_dropped_test"),
        (F.col("n_dropped_train").eqNullSafe(zero(F.col("found_dropped_train"))) & F.col("n_dropped_test").eqNullSafe(zero(F.col("found_dropped_test")))).alias("report_holds"),
    )


_FOLD = r"lower(regexp_replace({}, '^[\s\x{{00a0}}\x{{00ad}}\x{{2000}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{205f}}\x{{2060}}\x{{3000}}\x{{feff}}]+|[\s\x{{00a0}}\x{{00ad}}\x{{2000}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{205f}}\x{{2060}}\x{{3000}}\x{{feff}}]+$', '', 'g'))"
_ORPHANS = f"""
WITH runs AS (SELECT {_FOLD.format('run_id')} AS run_key, min({_FOLD.format('source')}) AS src FROM seccion12_tabla_completa WHERE run_id IS NOT NULL GROUP BY 1),
cat AS (SELECT DISTINCT {_FOLD.format('embedding_source')} AS src, {_FOLD.format('node_id')} AS node, exported_at, retired_at FROM embedding_catalog),
pairs AS (SELECT DISTINCT pair_id, {_FOLD.format('run_id')} AS run_key, split, n1, n2, loaded_at FROM eval_pairs),
ends AS (
  SELECT pair_id, 'n1' AS ref_column, run_key, {_FOLD.format('n1')} AS node, loaded_at FROM pairs WHERE n1 IS NOT NULL
  UNION ALL SELECT pair_id, 'n2', run_key, {_FOLD.format('n2')}, loaded_at FROM pairs WHERE n2 IS NOT NULL),
orphans AS (
  SELECT pair_id, 'run_id' AS ref_column, loaded_at FROM pairs p WHERE run_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_key = p.run_key)
  UNION ALL
  SELECT e.pair_id, e.ref_column, e.loaded_at FROM ends e JOIN runs r ON r.run_key = e.run_key
  WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.src = r.src AND c.node = e.node AND c.exported_at <= e.loaded_at AND (c.retired_at IS NULL OR c.retired_at > e.loaded_at)))
"""

QUERIES = {"p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month, "p2_dropped": p2_dropped}

ORACLE = {
    "p2_found": _ORPHANS + "SELECT DISTINCT pair_id, ref_column FROM orphans",
    "p2_orphans_by_month": _ORPHANS + "SELECT ref_column, strftime(loaded_at, '%Y-%m') AS month, count(DISTINCT pair_id) AS n_orphans FROM orphans GROUP BY 1, 2",
    "p2_dropped": _ORPHANS
    + """, bad AS (SELECT pair_id FROM orphans WHERE ref_column <> 'run_id' UNION SELECT pair_id FROM pairs WHERE n1 IS NULL OR n2 IS NULL),
counted AS (SELECT run_key, count(DISTINCT CASE WHEN lower(split) = 'train' THEN pair_id END) AS t, count(DISTINCT CASE WHEN lower(split) = 'test' THEN pair_id END) AS e
  FROM pairs WHERE pair_id IN (SELECT pair_id FROM bad) GROUP BY 1),
told AS (SELECT """
    + _FOLD.format("run_id")
    + """ AS run_key, max(n_dropped_train) AS n_dropped_train, max(n_dropped_test) AS n_dropped_test FROM seccion12_tabla_completa WHERE run_id IS NOT NULL GROUP BY 1)
SELECT a.run_key AS run_id, n_dropped_train, n_dropped_test, coalesce(t, 0) AS found_dropped_train, coalesce(e, 0) AS found_dropped_test,
  n_dropped_train IS NOT DISTINCT FROM coalesce(t, 0) AND n_dropped_test IS NOT DISTINCT FROM coalesce(e, 0) AS report_holds
FROM told a LEFT JOIN counted c ON a.run_key = c.run_key""",
}
