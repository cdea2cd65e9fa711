"""Duplicates hidden by formatting differences.

Records are canonicalised (letters and digits in order, lower case; exchangeable
fields sorted), hashed to 128 bits and counted with map-side combining. A second,
independent 64-bit hash of the same text travels along as minimum and maximum:
where they differ, two texts met in one 128-bit value, and those few groups are
counted again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import alnum_key, given
from edgeloom.plans.durable import materialise
from edgeloom.plans.skew import join_hot

SEPARATOR = "\u0001"


def canonical_text(fields: list[Column], exchangeable: tuple[Column, Column] | None = None, may_exchange: Column | None = None) -> Column:
    """One text for all spellings: the fixed fields, then the two exchangeable ones, sorted where ``may_exchange``."""
    parts = list(fields)
    if exchangeable:
        a, b = exchangeable
        swap = F.coalesce(may_exchange, F.lit(False)) & (a > b)
        parts += [F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)]
    return F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts])


def fingerprints(df: DataFrame, record_id: str, text: Column) -> DataFrame:
    """(_id, _h, _check, _text): the 128-bit hash, the independent 64-bit one and the canonical text."""
    return df.select(F.col(record_id).alias("_id"), text.alias("_text")).withColumn("_h", F.unhex(F.md5("_text"))).withColumn("_check", F.xxhash64("_text", F.lit("check")))


def copy_groups(hashed: DataFrame, marked: DataFrame, more_than_one: bool = True) -> DataFrame:
    """(_h, _check, keep_id, n_copies) of each group of equal records, written to the shared folder.

    ``hashed`` holds what is grouped, ``marked`` the texts, which are read only
    where hashes collide. keep_id is the smallest id. A hot group costs its
    partial aggregates only.
    """
    agg = (F.min("_id").alias("keep_id"), F.count("*").alias("n_copies"), F.min("_check").alias("_check"), F.max("_check").alias("_most"))
    groups = hashed.groupBy("_h").agg(*agg)
    groups = materialise(groups.filter("n_copies > 1") if more_than_one else groups, "copies")
    clash = groups.filter("_check <> _most").select("_h")
    clean = groups.filter("_check = _most").select("_h", "_check", "keep_id", "n_copies")
    if clash.isEmpty():
        return clean
    again = marked.join(clash, "_h", "left_semi").groupBy("_h", "_text").agg(*agg).select("_h", "_check", "keep_id", "n_copies")
    return clean.unionByName(again.filter("n_copies > 1") if more_than_one else again)


def copies(marked: DataFrame) -> DataFrame:
    """(keep_id, copy_id): each record other than the kept one of its group.

    Records whose text is null are no copies. Rows that repeat one id are one
    record. An empty table gives no rows.
    """
    marked = marked.filter("_text IS NOT NULL")
    hashed = materialise(marked.select("_h", "_check", "_id"), "hashes")  # texts are canonicalised once
    pairs = join_hot(hashed, copy_groups(hashed, marked), ["_h", "_check"], "n_copies")
    return pairs.filter("_id <> keep_id").select("keep_id", F.col("_id").alias("copy_id")).distinct()


def exchangeable_relations(catalog: DataFrame) -> DataFrame:
    """(relation, may_exchange): true if the ends' types differ or some entry calls the relation symmetric."""
    swap = (F.col("node1_type") != F.col("node2_type")) | F.col("is_symmetric")
    return catalog.filter("relation IS NOT NULL").groupBy("relation").agg(F.coalesce(F.bool_or(swap), F.lit(False)).alias("may_exchange"))


def edge_fingerprints(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """``fingerprints`` of typed edges: equal relation, and equal letters and digits of both ends and the database.

    Rows with a null or blank end or a null relation have no part. A null
    database equals an empty one. A relation that the catalog lacks has
    exchangeable ends if the first and last part of its name differ.
    """
    rows = edges.select("edge_id", "relation", "node1", "node2", "database").filter(given("node1") & given("node2") & F.col("relation").isNotNull())
    named = F.split_part("relation", F.lit("-"), F.lit(1)) != F.split_part("relation", F.lit("-"), F.lit(-1))
    rows = rows.join(exchangeable_relations(catalog), "relation", "left")
    text = canonical_text([F.col("relation"), alnum_key("database")], (alnum_key("node1"), alnum_key("node2")), F.coalesce("may_exchange", named))
    return fingerprints(rows, "edge_id", text)


def collapsed_edges(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(keep_id, n_copies): one row for each edge whatever its spelling; n_copies counts its rows."""
    marked = edge_fingerprints(edges, catalog)
    return copy_groups(marked, marked, more_than_one=False).select("keep_id", "n_copies")
