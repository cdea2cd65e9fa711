"""Queries of readers, sinks and ingest recipes: test tables are brought into the raw formats' shapes, and read or cooked from there.

Files lie in the session's shared folder and are deleted when the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import scalars as X
from edgeloom.operators.edges import union_all
from edgeloom.plans.durable import materialise, scratch
from edgeloom.session import table
from edgeloom.sources import readers as R
from edgeloom.sources import recipes as C
from edgeloom.sources import sinks as K


def _path(s: SparkSession, name: str) -> str:
    return scratch(s, f"{name}-{uuid.uuid4().hex}")


def _text(lines: DataFrame, path: str, **options) -> str:
    lines.write.options(**options).text(path)
    return path


def _tsv(s, d):
    path = _path(s, "tsv")
    K.sorted_tsv(table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, "s_suppkey")
    return R.delimited(s, path, "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double", columns=["s_suppkey", "s_name", "s_acctbal"])


def _gzip(s, d):
    path = _path(s, "gzip")
    table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("sep", "\t").option("compression", "gzip").csv(path)
    return R.delimited(s, path, "c_custkey bigint, c_name string, c_mktsegment string", header=False).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


def _comments(s, d):
    """Lines that begin with # and those with a wrong number of fields are left out, and counted."""
    t = table(s, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 7 == 0, "#").otherwise(""), F.col("s_suppkey").cast("string"), F.lit("\t"), "s_name", F.when(F.col("s_suppkey") % 5 == 0, "\textra").otherwise("")))
    rows, counts = R.guarded(s, _text(t, _path(s, "guarded")), ["k", "name"])
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.col("k").cast("bigint")).alias("total")).crossJoin(counts)


def _scores(s, d):
    """The score is the last field of a line, whatever is between."""
    t = table(s, d, "lineitem").select(F.concat_ws(" ", F.concat(F.lit("9606.P"), F.col("l_suppkey")), F.concat(F.lit("9606.P"), F.col("l_partkey")), F.when(F.col("l_linenumber") % 2 == 0, F.lit("mid")), (F.col("l_orderkey") % 1000).cast("string")))
    path = _path(s, "scores")
    t.coalesce(1).write.text(path)
    name = s.read.text(path).inputFiles()[0]
    # The first line stands for a header.
    return R.last_column_scores(s, name).agg((F.count("*") + 1).alias("n"))


def _whitespace(s, d):
    t = table(s, d, "nation").select(F.concat(F.lit("  "), F.col("n_nationkey").cast("string"), F.lit(" \t "), F.col("n_regionkey").cast("string"), F.lit("  ")))
    return R.whitespace(s, _text(t, _path(s, "blanks")), ["nation", "region", "more"]).select(F.col("nation").cast("bigint").alias("nation"), F.col("region").cast("bigint").alias("region"), F.col("more").isNull().alias("lacks"))


def _json(s, d):
    good = table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    bad = table(s, d, "region").select(F.concat(F.lit("{bad "), "r_name"))
    rows, counts = R.json_lines(s, _text(good.union(bad), _path(s, "json")), "n_nationkey bigint, n_name string")
    return rows.agg(F.count("*").alias("n"), F.max("n_name").alias("last")).crossJoin(counts)


def _keyed(s, d):
    """One file a key, found again by the files' folder."""
    path = _path(s, "keyed")
    table(s, d, "customer").select("c_custkey", "c_mktsegment").write.partitionBy("c_mktsegment").option("sep", "\t").csv(path)
    read = R.keyed_directory(s, f"{path}/c_mktsegment=BUILDING", "c_custkey bigint")
    return read.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"), F.max(F.col("key").isNotNull()).alias("named"))


def _tree(s, d):
    path = _path(s, "tree")
    for i in range(2):
        table(s, d, "orders").filter(F.col("o_orderkey") % 2 == i).select("o_orderkey", "o_totalprice").write.parquet(f"{path}/deep{i}/er")
    return R.parquet_tree(s, path, ["o_orderkey"]).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def _results(s, d):
    """Result files that match a pattern, units added one by one, and a pattern that matches none."""
    path = _path(s, "results")
    for i in range(3):
        table(s, d, "nation").filter(F.col("n_regionkey") == i).select("n_nationkey", "n_name").coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{path}/unit{i}__results.tsv")
    none = R.result_files(s, f"{path}/none*", "n_nationkey bigint, n_name string")
    return R.result_files(s, f"{path}/unit*__results.tsv", "n_nationkey bigint, n_name string").unionByName(none)


def _wide(s, d):
    """A wide matrix with a header in long form again; what is no number is null."""
    long = table(s, d, "lineitem").filter("l_linenumber <= 3").select((F.col("l_suppkey") % 20).alias("sample"), F.concat(F.lit("G"), F.col("l_linenumber")).alias("gene"), F.col("l_quantity").cast("double").alias("v"))
    wide = long.groupBy("sample").pivot("gene", ["G1", "G2", "G3"]).agg(F.max("v")).withColumn("G3", F.when(F.col("sample") % 4 == 0, "NA").otherwise(F.col("G3").cast("string")))
    path = _path(s, "wide")
    wide.write.option("header", True).csv(path)
    return R.wide_matrix(s, path, "sample").select(F.col("sample").cast("bigint").alias("sample"), "gene", "value")


def _vectors(s, d):
    """Vectors through the text format of word2vec: a line with count and dimension, then id and values."""
    v = table(s, d, "embedding_catalog").filter((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))).select("vec_id", "embedding")
    head = v.agg(F.concat(F.count("*").cast("string"), F.lit(" 64")).alias("value"), F.lit(-1).cast("bigint").alias("o"))
    lines = head.unionByName(v.select(F.concat_ws(" ", F.concat(F.lit("node "), F.col("vec_id")), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"), F.col("vec_id").alias("o")))
    path = _path(s, "w2v")
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    back = R.word_vectors(s, s.read.text(path).inputFiles()[0])
    return back.select(F.substring("node", 6, 20).cast("bigint").alias("vec_id"), F.size("vec").alias("dimension"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


def _proteins(s, d) -> DataFrame:
    """(key, value): a made mapping of proteins to genes, several to one and one to several."""
    p = table(s, d, "part").select("p_partkey")
    one = p.select(F.concat(F.lit("P"), "p_partkey").alias("key"), F.concat(F.lit("G"), F.col("p_partkey") % 500).alias("value")).filter("p_partkey % 11 <> 0")
    return one.unionByName(p.filter("p_partkey % 13 = 0").select(F.concat(F.lit("P"), "p_partkey"), F.concat(F.lit("H"), "p_partkey")).toDF("key", "value"))


def _links(s, d):
    raw = table(s, d, "lineitem").select(F.concat(F.lit("9606.P"), "l_partkey").alias("protein1"), F.concat(F.lit("9606.P"), "l_suppkey").alias("protein2"), (F.col("l_orderkey") % 1000).cast("int").alias("score"))
    return C.protein_links(raw, _proteins(s, d))


def _associations(s, d):
    raw = table(s, d, "lineitem").select(F.concat(F.lit("MONDO_"), F.col("l_suppkey") % 40).alias("diseaseId"), F.concat(F.lit("ENSG"), "l_partkey").alias("targetId"), ((F.col("l_orderkey") % 997) / 1000.0).alias("associationScore"))
    return C.associations(raw, upto=30)


def _pathways(s, d):
    raw = table(s, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("protein"), F.concat(F.when(F.col("l_linenumber") < 4, "R-HSA-").otherwise("R-MMU-"), F.col("l_suppkey") % 60).alias("pathway"))
    return C.pathways(raw, _proteins(s, d))


def _drug_targets(s, d):
    raw = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("P"), "l_partkey"))), "| ").alias("target")).select(F.concat(F.lit("drug"), F.col("l_orderkey") % 700).alias("pert_iname"), "target")
    return C.drug_targets(raw, _proteins(s, d))


def _human(c: str):
    return F.when(F.col(c) % 9 == 0, "10090").otherwise("9606")


def _regulation(s, d):
    t = table(s, d, "lineitem")
    raw = t.select(
        F.concat(F.lit("P"), "l_partkey").alias("source"), F.concat(F.lit("P"), "l_suppkey").alias("target"), (F.col("l_linenumber") < 6).alias("dorothea"), _human("l_orderkey").alias("ncbi_tax_id_source"), F.lit("9606").alias("ncbi_tax_id_target"),
        F.concat_ws(";", F.when(F.col("l_orderkey") % 3 == 0, "A"), F.when(F.col("l_orderkey") % 4 == 0, "D"), F.lit("E")).alias("dorothea_level"), (F.col("l_linenumber") % 2 == 0).alias("consensus_stimulation"), (F.col("l_linenumber") % 3 == 0).alias("consensus_inhibition"),
    )
    reviewed = table(s, d, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("protein"))
    return C.regulation(raw, reviewed, _proteins(s, d), "AB")


def _interactions(s, d):
    t = table(s, d, "lineitem")
    a, b = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("P"), "l_suppkey")
    raw = t.select(a.alias("source"), b.alias("target"), (F.col("l_linenumber") < 3).alias("omnipath"), _human("l_orderkey").alias("ncbi_tax_id_source"), _human("l_suppkey").alias("ncbi_tax_id_target"))
    sites = t.select(a.alias("enzyme"), b.alias("substrate"), _human("l_orderkey").alias("ncbi_tax_id"), F.when(F.col("l_linenumber") == 5, "phosphorylation").when(F.col("l_linenumber") == 6, "dephosphorylation").otherwise("other").alias("modification"))
    reviewed = table(s, d, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("protein"))
    return C.interactions(raw, sites, reviewed, _proteins(s, d))


def _profiles(s, d):
    raw = table(s, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("source"), F.concat(F.lit("L"), F.col("l_suppkey") % 50).alias("target"), F.when(F.col("l_linenumber") == 1, "1.0").when(F.col("l_linenumber") == 2, "-1").when(F.col("l_linenumber") == 3, "x").otherwise("0.5").alias("weight"))
    lines = s.range(40).select(F.concat(F.lit("L"), "id").alias("key"), F.concat(F.lit("CVCL"), "id").alias("value"))
    return C.signed_profiles(raw, _proteins(s, d), lines, "CLL-cnu-GEN", "CLL-cnd-GEN")


def _mutations(s, d):
    cells = table(s, d, "lineitem").select(F.concat(F.lit("L"), F.col("l_suppkey") % 50).alias("sample"), F.concat(F.lit("P"), F.col("l_partkey"), F.lit(" ("), F.col("l_orderkey"), F.lit(")")).alias("gene"), (F.col("l_linenumber") % 4).cast("double").alias("value"))
    lines = s.range(40).select(F.concat(F.lit("L"), "id").alias("key"), F.concat(F.lit("CVCL"), "id").alias("value"))
    return C.mutations([cells.filter("sample < 'L3'"), cells.filter("sample >= 'L3'")], _proteins(s, d), lines)


def _chemicals(s, d):
    e = F.when(F.col("l_linenumber") == 1, " Therapeutic").when(F.col("l_linenumber") == 2, "marker/mechanism").otherwise("")
    ids = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("MESH:D"), F.col("l_suppkey"))).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("OMIM:"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("MEDGEN:"), F.col("l_suppkey")))
    raw = table(s, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("ChemicalID"), ids.alias("DiseaseID"), e.alias("DirectEvidence"))
    one = _proteins(s, d).filter("value LIKE 'G%'")
    genes = C.gene_diseases(raw.withColumnRenamed("ChemicalID", "GeneID"), _proteins(s, d))
    return union_all([C.chemical_diseases(raw, one), genes])


def _actions(s, d):
    a = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "increases").otherwise("decreases"), F.lit("^"), F.when(F.col("l_linenumber") < 3, "expression").when(F.col("l_linenumber") < 5, "binding").otherwise("transport"))
    raw = table(s, d, "lineitem").select(F.concat(F.lit("C"), F.col("l_suppkey")).alias("ChemicalID"), F.concat(F.lit("P"), "l_partkey").alias("GeneID"), _human("l_orderkey").alias("OrganismID"), F.concat(a, F.lit("|affects^binding|junk")).alias("InteractionActions"))
    rules = s.createDataFrame([("expression", "increases", "upr"), ("expression", "decreases", "dwr"), ("binding", None, "int")], "kind string, degree string, relation string")
    chemicals = s.range(50).select(F.concat(F.lit("C"), "id").alias("key"), F.concat(F.lit("MESH:"), "id").alias("value"))
    return C.chemical_actions(raw, _proteins(s, d), chemicals, rules).groupBy("relation").agg(F.count("*").alias("n_pairs"), F.countDistinct("n1").alias("n_chemicals"), F.countDistinct("n2").alias("n_genes"))


def _proteome(s, d):
    raw = table(s, d, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_partkey") % 400).alias("Gene"), F.concat(F.lit("T"), F.col("l_suppkey") % 30).alias("Tissue"), F.when(F.col("l_linenumber") == 1, "High").when(F.col("l_linenumber") == 2, "Low").otherwise("Medium").alias("Level"),
        F.when(F.col("l_orderkey") % 5 == 0, "Uncertain").when(F.col("l_orderkey") % 5 == 1, "Approved").alias("Reliability"),
    )
    return C.proteome(raw)


def _tissues(s, d):
    raw = table(s, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("protein"), F.when(F.col("l_linenumber") == 1, "root").otherwise(F.concat(F.lit("BTO:"), F.col("l_suppkey") % 30)).alias("tissue"))
    return C.tissues(raw, _proteins(s, d), "root")


def _levels(s, d):
    levels = table(s, d, "lineitem").select(F.concat(F.lit("T"), F.col("l_suppkey") % 20).alias("sample"), F.concat(F.lit("G"), F.col("l_partkey") % 200).alias("gene"), F.col("l_quantity").cast("double").alias("value"))
    return C.tissue_expression(levels, 15)


def _coexpressed(s, d):
    ranks = table(s, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("key"), F.concat(F.lit("P"), "l_suppkey").alias("target"), (F.col("l_orderkey") % 300).cast("double").alias("rank"))
    reliable = table(s, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("gene"))
    return C.coexpression(ranks.groupBy("key", "target").agg(F.min("rank").alias("rank")), _proteins(s, d), reliable).withColumn("mutual_rank", F.col("mutual_rank").cast("bigint"))


def _evidence(s, d):
    t = table(s, d, "lineitem")
    genes = t.select(F.concat(F.lit("G"), F.col("l_partkey") % 100).alias("gene"), F.concat(F.lit("D"), F.col("l_suppkey") % 90).alias("disease")).distinct()
    codes = t.filter("l_linenumber = 7").select(F.concat(F.lit("D"), F.col("l_suppkey") % 90).alias("disease"), F.element_at(F.array(F.lit("IEA"), F.lit("TAS"), F.lit("PCS"), F.lit("zzz")), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("evidence"))
    return C.best_evidence(genes, codes)


def _funnel(s, d):
    """Links of proteins from the raw pairs over the mapped to the kept ones, and what each stage holds."""
    raw = table(s, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("n1"), F.concat(F.lit("P"), "l_suppkey").alias("n2"))
    return C.funnel(raw, materialise(_tissues(s, d), "tissues").select("n1", "n2"), _links(s, d).select("n1", "n2"))


def _status(s, d):
    """By mapping state: rows, genes, how many have an accession, and the share of all rows in percent."""
    t = table(s, d, "gen_id_mapping_table").select(F.lower(F.trim("estado_mapeo")).alias("state"), "graph_node_id", F.coalesce(F.trim("uniprot_accession") != "", F.lit(False)).alias("has"))
    per = t.groupBy("state").agg(F.count("*").alias("n_rows"), F.countDistinct("graph_node_id").alias("n_nodes"), F.count_if("has").alias("n_with_accession"))
    return per.crossJoin(t.agg(F.count("*").alias("_n"))).withColumn("pct", F.round(100.0 * F.col("n_rows") / F.col("_n"), 2)).drop("_n")


def _report(s, d):
    """(relation, n_edges, n_nodes, display): edges as text with thousands separators, databases in a stated order, others behind."""
    t = table(s, d, "graph_edges")
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ["idmatch", "string", "ctd"])), F.lower("database")), F.lit(0))
    return t.groupBy("relation").agg(F.count("*").alias("n_edges"), F.min(F.when(order == 0, 99).otherwise(order)).cast("int").alias("place")).withColumn("display", X.grouped_number(F.col("n_edges")))


QUERIES = {
    "read_tsv": _tsv, "read_gzip": _gzip, "read_guarded": _comments, "read_last_column": _scores, "read_whitespace": _whitespace, "read_json_lines": _json, "read_keyed": _keyed, "read_tree": _tree, "read_results": _results,
    "read_wide": _wide, "read_word_vectors": _vectors, "recipe_links": _links, "recipe_associations": _associations, "recipe_pathways": _pathways, "recipe_drug_targets": _drug_targets, "recipe_regulation": _regulation,
    "recipe_interactions": _interactions, "recipe_profiles": _profiles, "recipe_mutations": _mutations, "recipe_diseases": _chemicals, "recipe_actions": _actions, "recipe_proteome": _proteome, "recipe_tissues": _tissues,
    "recipe_tissue_levels": _levels, "recipe_coexpression": _coexpressed, "recipe_evidence": _evidence, "recipe_stats": lambda s, d: C.recipe_stats(_regulation(s, d)), "recipe_funnel": _funnel, "status_breakdown": _status, "report_table": _report,
}

_PROT = "prot AS (SELECT 'P' || p_partkey AS key, 'G' || (p_partkey % 500) AS value FROM part WHERE p_partkey % 11 <> 0 UNION SELECT 'P' || p_partkey, 'H' || p_partkey FROM part WHERE p_partkey % 13 = 0)"
_HUMAN = "{} % 9 <> 0"
_REV = "rev AS (SELECT 'P' || p_partkey AS p FROM part WHERE p_partkey % 3 <> 0)"
_LINKS = f"WITH {_PROT}, lk AS (SELECT a.value AS a, b.value AS b, l_orderkey % 1000 AS score FROM lineitem JOIN prot a ON a.key = 'P' || l_partkey JOIN prot b ON b.key = 'P' || l_suppkey WHERE l_orderkey % 1000 >= 700 AND a.value <> b.value), links AS (SELECT least(a, b) AS n1, greatest(a, b) AS n2, round(min(score) / 1000, 3) AS score, 'GEN-ppi-GEN' AS relation FROM lk GROUP BY 1, 2)"
_REG = f"""WITH {_PROT}, {_REV}, r0 AS (SELECT 'P' || l_partkey AS s, 'P' || l_suppkey AS t, l_linenumber AS n FROM lineitem WHERE l_linenumber < 6 AND {_HUMAN.format('l_orderkey')} AND l_orderkey % 3 = 0),
r1 AS (SELECT DISTINCT a.value AS n1, b.value AS n2, n FROM r0 JOIN prot a ON a.key = s JOIN prot b ON b.key = t WHERE s IN (SELECT p FROM rev) AND t IN (SELECT p FROM rev) AND a.value <> b.value),
reg AS (SELECT DISTINCT n1, n2, 'GEN-reg-GEN' AS relation FROM r1 UNION ALL SELECT DISTINCT n1, n2, 'GEN-upr-GEN' FROM r1 WHERE n % 2 = 0 UNION ALL SELECT DISTINCT n1, n2, 'GEN-dwr-GEN' FROM r1 WHERE n % 3 = 0)"""
_TISSUES = f"SELECT DISTINCT value AS n1, 'BTO:' || (l_suppkey % 30) AS n2, 'GEN-ass-TIS' AS relation FROM lineitem JOIN prot ON key = 'P' || l_partkey WHERE l_linenumber <> 1"
_DIS = "CASE l_suppkey % 3 WHEN 0 THEN 'MESH:D' || l_suppkey WHEN 1 THEN 'OMIM:' || l_suppkey END"
_EXTREMES = """q AS (SELECT gene, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM mean GROUP BY 1),
z AS (SELECT sample, gene, (value - m) / CASE WHEN b - a = 0 THEN 1 ELSE b - a END AS v FROM mean JOIN q USING (gene)),
x AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, gene) AS u, row_number() OVER (PARTITION BY sample ORDER BY v, gene) AS d FROM z)"""

ORACLE = {
    "read_tsv": "SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier",
    "read_gzip": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1",
    "read_guarded": "SELECT count(*) FILTER (s_suppkey % 5 <> 0) AS n_rows, CAST(sum(s_suppkey) FILTER (s_suppkey % 5 <> 0) AS BIGINT) AS total, count(*) AS n_lines, count(*) FILTER (s_suppkey % 5 = 0) AS n_rejected FROM supplier WHERE s_suppkey % 7 <> 0",
    "read_last_column": "SELECT count(*) AS n FROM lineitem",
    "read_whitespace": "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region, true AS lacks FROM nation",
    "read_json_lines": "SELECT count(*) AS n, max(n_name) AS last, (SELECT count(*) FROM region) AS n_bad FROM nation",
    "read_keyed": "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total, true AS named FROM customer WHERE c_mktsegment = 'BUILDING'",
    "read_tree": "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders",
    "read_results": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey < 3",
    "read_wide": "WITH l AS (SELECT l_suppkey % 20 AS sample, 'G' || l_linenumber AS gene, max(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), k AS (SELECT DISTINCT sample FROM l), g AS (SELECT unnest(['G1', 'G2', 'G3']) AS gene) SELECT CAST(k.sample AS BIGINT) AS sample, g.gene, CASE WHEN g.gene = 'G3' AND k.sample % 4 = 0 THEN NULL ELSE v END AS value FROM k CROSS JOIN g LEFT JOIN l ON l.sample = k.sample AND l.gene = g.gene",
    "read_word_vectors": "SELECT vec_id, CAST(64 AS INTEGER) AS dimension, round(list_sum(CAST(embedding AS DOUBLE[])), 3) AS total FROM embedding_catalog WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])",
    "recipe_links": _LINKS + " SELECT * FROM links",
    "recipe_associations": "WITH b AS (SELECT 'ENSG' || l_partkey AS n1, 'MONDO:' || (l_suppkey % 40) AS n2, max((l_orderkey % 997) / 1000.0) AS score FROM lineitem WHERE (l_orderkey % 997) / 1000.0 >= 0.3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n2 ORDER BY score DESC, n1) AS k FROM b) SELECT n1, n2, CAST(score AS DOUBLE) AS score, 'GEN-ass-DIS' AS relation FROM r WHERE score >= 0.7 OR k <= 30",
    "recipe_pathways": f"WITH {_PROT} SELECT DISTINCT value AS n1, 'R-HSA-' || (l_suppkey % 60) AS n2, 'GEN-ass-PWY' AS relation FROM lineitem JOIN prot ON key = 'P' || l_partkey WHERE l_linenumber < 4",
    "recipe_drug_targets": f"""WITH {_PROT}, p AS (SELECT DISTINCT 'drug' || (l_orderkey % 700) AS n1, value AS n2 FROM lineitem JOIN prot ON key = 'P' || l_partkey),
a AS (SELECT n1, count(*) AS d FROM p GROUP BY 1), b AS (SELECT n2, count(*) AS d FROM p GROUP BY 1), sa AS (SELECT avg(d) AS m, stddev_pop(d) AS s, count(*) AS n FROM a), sb AS (SELECT avg(d) AS m, stddev_pop(d) AS s, count(*) AS n FROM b)
SELECT n1, n2, 'CPD-int-GEN' AS relation FROM p JOIN a USING (n1) JOIN b USING (n2), sa, sb WHERE NOT (sa.n >= 3 AND sa.s > 0 AND (a.d - sa.m) / sa.s > 3) AND NOT (sb.n >= 3 AND sb.s > 0 AND (b.d - sb.m) / sb.s > 3)""",
    "recipe_regulation": _REG + " SELECT * FROM reg",
    "recipe_stats": _REG + " SELECT relation, count(*) AS total, count(DISTINCT n1) AS n_n1, count(DISTINCT n2) AS n_n2 FROM reg GROUP BY 1",
    "recipe_interactions": f"""WITH {_PROT}, {_REV}, r AS (SELECT 'P' || l_partkey AS s, 'P' || l_suppkey AS t, l_linenumber AS n, {_HUMAN.format('l_orderkey')} AS h, {_HUMAN.format('l_suppkey')} AS g FROM lineitem),
m AS (SELECT a.value AS x, b.value AS y, n, h, g FROM r JOIN prot a ON a.key = s JOIN prot b ON b.key = t WHERE s IN (SELECT p FROM rev) AND t IN (SELECT p FROM rev) AND a.value <> b.value)
SELECT DISTINCT least(x, y) AS n1, greatest(x, y) AS n2, 'GEN-ppi-GEN' AS relation FROM m WHERE n < 3 AND h AND g UNION ALL SELECT DISTINCT x, y, 'GEN-pho-GEN' FROM m WHERE n = 5 AND h UNION ALL SELECT DISTINCT x, y, 'GEN-dph-GEN' FROM m WHERE n = 6 AND h""",
    "recipe_profiles": f"WITH {_PROT} SELECT DISTINCT 'CVCL' || (l_suppkey % 50) AS n1, value AS n2, CASE l_linenumber WHEN 1 THEN 'CLL-cnu-GEN' ELSE 'CLL-cnd-GEN' END AS relation FROM lineitem JOIN prot ON key = 'P' || l_partkey WHERE l_linenumber IN (1, 2) AND l_suppkey % 50 < 40",
    "recipe_mutations": f"WITH {_PROT} SELECT DISTINCT 'CVCL' || (l_suppkey % 50) AS n1, value AS n2, 'CLL-mut-GEN' AS relation FROM lineitem JOIN prot ON key = 'P' || l_partkey WHERE l_linenumber % 4 = 1 AND l_suppkey % 50 < 40",
    "recipe_diseases": f"""WITH {_PROT}, c AS (SELECT DISTINCT coalesce(value, 'P' || l_partkey) AS n1, {_DIS} AS n2, CASE l_linenumber WHEN 1 THEN 'CPD-trt-DIS' ELSE 'CPD-cau-DIS' END AS relation FROM lineitem LEFT JOIN (SELECT * FROM prot WHERE value LIKE 'G%') ON key = 'P' || l_partkey WHERE l_linenumber IN (1, 2)),
g AS (SELECT DISTINCT value AS n1, {_DIS} AS n2, 'GEN-ass-DIS' AS relation FROM lineitem JOIN prot ON key = 'P' || l_partkey WHERE l_linenumber IN (1, 2)) SELECT * FROM c WHERE n2 IS NOT NULL UNION ALL SELECT * FROM g WHERE n2 IS NOT NULL""",
    "recipe_actions": f"""WITH {_PROT}, r AS (SELECT CASE WHEN l_suppkey < 50 THEN 'MESH:' || l_suppkey ELSE 'C' || l_suppkey END AS n1, value AS n2, unnest([CASE WHEN l_linenumber < 3 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'upr' ELSE 'dwr' END WHEN l_linenumber < 5 THEN 'int' ELSE 'afe' END, 'int']) AS k FROM lineitem JOIN prot ON key = 'P' || l_partkey WHERE {_HUMAN.format('l_orderkey')})
SELECT 'CPD-' || k || '-GEN' AS relation, count(DISTINCT (n1, n2)) AS n_pairs, count(DISTINCT n1) AS n_chemicals, count(DISTINCT n2) AS n_genes FROM r GROUP BY 1""",
    "recipe_proteome": """WITH r AS (SELECT DISTINCT 'G' || (l_partkey % 400) AS n1, 'T' || (l_suppkey % 30) AS n2, l_linenumber AS n FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_linenumber < 3),
c AS (SELECT n1, n2, min(n) AS n FROM r GROUP BY 1, 2 HAVING count(*) = 1) SELECT n1, n2, CASE n WHEN 1 THEN 'GEN-pab-TIS' ELSE 'GEN-pdf-TIS' END AS relation FROM c""",
    "recipe_tissues": f"WITH {_PROT} {_TISSUES}",
    "recipe_tissue_levels": f"WITH mean AS (SELECT 'T' || (l_suppkey % 20) AS sample, 'G' || (l_partkey % 200) AS gene, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2), {_EXTREMES} SELECT gene AS n1, sample AS n2, 'GEN-upr-TIS' AS relation FROM x WHERE u <= 15 AND v >= 0.5 UNION ALL SELECT gene, sample, 'GEN-dwr-TIS' FROM x WHERE d <= 15 AND v <= -0.5",
    "recipe_coexpression": f"""WITH {_PROT}, r AS (SELECT l_partkey AS a, l_suppkey AS b, min(l_orderkey % 300) AS k FROM lineitem GROUP BY 1, 2), top AS (SELECT ceil(count(*) * 0.1) AS upto FROM part WHERE p_partkey % 2 = 0), ok AS (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT x.value AS a, y.value AS b, k FROM r JOIN top ON k <= upto JOIN prot x ON x.key = 'P' || a JOIN prot y ON y.key = 'P' || b WHERE a IN (SELECT p_partkey FROM ok) AND b IN (SELECT p_partkey FROM ok) AND x.value <> y.value)
SELECT least(a, b) AS n1, greatest(a, b) AS n2, CAST(round(CASE WHEN bool_or(k = 0) THEN 0 ELSE exp(avg(ln(greatest(k, 1)))) END) AS BIGINT) AS mutual_rank, 'GEN-cex-GEN' AS relation FROM m GROUP BY 1, 2""",
    "recipe_evidence": """WITH g AS (SELECT DISTINCT 'G' || (l_partkey % 100) AS gene, 'D' || (l_suppkey % 90) AS disease FROM lineitem), c AS (SELECT 'D' || (l_suppkey % 90) AS disease, l_orderkey % 4 AS k FROM lineitem WHERE l_linenumber = 7),
b AS (SELECT disease, max(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END) AS r, count(*) AS n FROM c GROUP BY 1) SELECT gene, g.disease, CASE r WHEN 3 THEN 'PCS' WHEN 2 THEN 'TAS' WHEN 0 THEN 'zzz' ELSE 'IEA' END AS evidence, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (disease)""",
    "recipe_funnel": f"""{_LINKS}, o AS (SELECT 'P' || l_partkey AS n1, 'P' || l_suppkey AS n2 FROM lineitem), t AS ({_TISSUES}),
u AS (SELECT 'original' AS stage, n1, n2 FROM o UNION ALL SELECT 'homogenised', n1, n2 FROM t UNION ALL SELECT 'filtered', n1, n2 FROM links) SELECT stage, count(*) AS n_rows, count(DISTINCT (n1, n2)) AS n_pairs, count(DISTINCT n1) AS n_n1, count(DISTINCT n2) AS n_n2 FROM u GROUP BY 1""",
    "status_breakdown": "WITH t AS (SELECT lower(trim(estado_mapeo)) AS state, graph_node_id, coalesce(trim(uniprot_accession) <> '', false) AS has FROM gen_id_mapping_table) SELECT state, count(*) AS n_rows, count(DISTINCT graph_node_id) AS n_nodes, count(*) FILTER (has) AS n_with_accession, round(100.0 * count(*) / (SELECT count(*) FROM t), 2) AS pct FROM t GROUP BY 1",
    "report_table": "SELECT relation, count(*) AS n_edges, CAST(min(CASE lower(database) WHEN 'idmatch' THEN 1 WHEN 'string' THEN 2 WHEN 'ctd' THEN 3 ELSE 99 END) AS INTEGER) AS place, format('{:,}', count(*)) AS display FROM graph_edges GROUP BY 1",
}
