"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.text import given
from edgeloom.llm import corpus_encoding, cross_split, formatting_copies, grouped_splits, languages, leakage, match_groups, representatives, similar_vectors
from edgeloom.llm.oracle import ORACLE
from edgeloom.session import table


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, split): every edge, 70/10/20 by relation, one split for all edges of a relation naming the same node1."""
    return grouped_splits.grouped_split(grouped_splits.edge_records(table(spark, sf_dir, "graph_edges"))).select(F.col("id").alias("edge_id"), "split")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relation, split, n_edges, n_sources): what each split of a relation got."""
    placed = grouped_splits.grouped_split(grouped_splits.edge_records(table(spark, sf_dir, "graph_edges")))
    return placed.groupBy(F.col("scope").alias("relation"), "split").agg(F.count("*").alias("n_edges"), F.countDistinct("component").alias("n_sources"))


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.gene_counts(table(spark, sf_dir, "go_split"), table(spark, sf_dir, "biogrid_split"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(benchmark, scope_key, ensg): genes held out that also stand on the training side of their scope."""
    return cross_split.gene_collisions(_genes(spark, sf_dir)).drop("number")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(benchmark, split, n_collisions, n_rows): collisions with a row in the split, and their rows there."""
    return cross_split.collision_counts(_genes(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keep_id, copy_id): edges that are one but for spelling or the order of exchangeable ends."""
    return formatting_copies.copies(formatting_copies.edge_fingerprints(table(spark, sf_dir, "graph_edges"), table(spark, sf_dir, "relation_catalog")))


def p4_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keep_id, n_copies): one row for each edge with the number of its rows."""
    return formatting_copies.collapsed_edges(table(spark, sf_dir, "graph_edges"), table(spark, sf_dir, "relation_catalog"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_node_id, uniprot_accession, estado_mapeo, simbolo_genico) of genes with two or more rows."""
    return representatives.best_genes(table(spark, sf_dir, "gen_id_mapping_table"))


def p5_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_node_id, by_order, by_time, agree): the latest states of each gene by the learned order alone, beside the newest row's."""
    return representatives.latest_by_order(table(spark, sf_dir, "gen_id_mapping_table"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_lo, vec_hi): pairs of cosine 0.80 or more of which one is among the other's ten nearest of its collection."""
    return similar_vectors.similar_pairs(table(spark, sf_dir, "embedding_catalog"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, near_id, cosine): the ten most similar vectors of every vector, whatever the cosine."""
    return similar_vectors.neighbours(similar_vectors.comparable(table(spark, sf_dir, "embedding_catalog")))


def _identity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "graph_edges").filter(F.col("relation").contains("-syn-"))
    return edges.filter(given("node1") & given("node2")).select("node1", "node2")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, node_id): every node of an identity match with the smallest node linked to it."""
    return match_groups.match_groups(_identity_matches(spark, sf_dir), "node1", "node2")


def p7_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nodes, n_groups): how many groups have how many nodes."""
    sizes = p7_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count("*").alias("n_groups"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): every document's text as byte_bpe_50k ids, without special tokens."""
    return corpus_encoding.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents with at least twelve consecutive words of an item."""
    return _leaks(spark, sf_dir).filter(F.col("run") >= leakage.WORDS).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, n_documents, n_exact, longest_run): what leaked of each item, altered passages included."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count_if(F.col("errors") == 0).alias("n_exact"), F.max("run").alias("longest_run"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = languages.fitted(table(spark, sf_dir, "lang_samples"), "lang", "text")
    return languages.language_segments(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, segment, lang): the segments' languages of documents whose label is missing or wrong, or that mix languages."""
    return _segments(spark, sf_dir).filter("is_case").select("doc_id", "segment", "lang")


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, confidence, n_segments, n_languages): the language of most segments of each document with one.

    Ties go to the higher summed confidence, then to the first code.
    """
    each = _segments(spark, sf_dir).groupBy("doc_id", "lang").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    best = F.max(F.struct("n", "c", F.transform(F.split("lang", ""), lambda x: -F.ascii(x)).alias("o"), "lang"))
    whole = each.groupBy("doc_id").agg(best.alias("b"), F.sum("n").alias("n_segments"), F.count("*").alias("n_languages"))
    return whole.select("doc_id", F.col("b.lang").alias("lang"), (F.col("b.c") / F.col("n_segments")).alias("confidence"), "n_segments", "n_languages")


QUERIES = {
    "p1_splits": p1_splits,
    "p1_shares": p1_shares,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_edges": p4_edges,
    "p5_found": p5_found,
    "p5_latest": p5_latest,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_found": p7_found,
    "p7_group_sizes": p7_group_sizes,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
}
