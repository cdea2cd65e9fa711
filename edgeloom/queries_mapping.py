"""Queries on mappings, scalars, top lists and matrix transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions import scalars as X
from edgeloom.functions.text import alnum_key, ensg, real_value
from edgeloom.operators import edges as E
from edgeloom.operators import mapping as P
from edgeloom.operators import stats as T
from edgeloom.queries_edges import CLEAN, alnum, edges
from edgeloom.session import table


def mapping_rows(s, d):
    return table(s, d, "gen_id_mapping_table").select(
        ensg("graph_node_id").alias("gene"), "map_id", F.upper(real_value("simbolo_genico")).alias("symbol"), F.upper(real_value("uniprot_accession")).alias("accession"),
        F.upper(real_value("identificador_gen_original")).alias("original"), F.lower(F.trim("estado_mapeo")).alias("state"), "uniprot_has_embedding",
    ).filter("gene IS NOT NULL")


def _map(s, d, key, value):
    return mapping_rows(s, d).select(F.col(key).alias("key"), F.col(value).alias("value"), F.col("map_id").alias("ord"))


def _genes(s, d):
    e = edges(s, d).filter("relation = 'GEN-ppi-GEN'")
    return e.select(F.upper("node1").alias("a"), F.upper("node2").alias("b"))


def _ambiguous(s, d):
    """By gene with several accessions: them, sorted, and how many genes they stand for besides."""
    pairs = P.one_to_many(_map(s, d, "gene", "accession")).toDF("gene", "accession")
    shared = pairs.groupBy("accession").agg(F.count("*").alias("n_genes"))
    both = pairs.join(shared, "accession").groupBy("gene").agg(F.array_join(F.array_sort(F.collect_set("accession")), ";").alias("accessions"), F.count("*").alias("n_accessions"), F.max("n_genes").alias("max_genes"))
    return both.filter("n_accessions > 1")


def _candidates(s, d):
    return P.best_candidate(mapping_rows(s, d).select(F.col("gene").alias("key"), F.col("accession").alias("value"), F.col("state").startswith("mapeado_revisado").alias("reviewed"), F.col("uniprot_has_embedding").alias("has_vector")))


def _node_types(s, d):
    """(node_id, node_type, n): the catalog's nodes with the type that the edges give them, DESCONOCIDO without one."""
    types = E.ends(edges(s, d)).filter(F.col("node_type") != E.UNKNOWN).groupBy("node").agg(F.max("node_type").alias("t"))
    vectors = table(s, d, "embedding_catalog").select(alnum_key("node_id").alias("node"))
    return vectors.join(types, "node", "left").groupBy(F.coalesce("t", F.lit(E.UNKNOWN)).alias("node_type")).agg(F.count("*").alias("n_vectors"), F.countDistinct("node").alias("n_nodes"))


def _ids(s, d):
    raw = table(s, d, "graph_edges").filter("node2_type = 'DIS'").select(F.trim("node2").alias("raw")).distinct()
    return raw.select("raw", X.disease_id(F.col("raw")).alias("disease"), X.last_token(F.col("raw"), ":").alias("code"))


def _exploded(s, d):
    p = table(s, d, "part").select("p_partkey", F.explode(X.list_items(F.col("p_type"), " ")).alias("word"))
    return p.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("n_parts"))


def _routed(s, d):
    """Lines whose flags route them to a relation: by degree and kind, by kind alone, else affects."""
    pieces = table(s, d, "lineitem").select("l_suppkey", "l_partkey", F.explode(X.action_pieces(F.concat("l_returnflag", F.lit("^"), "l_linestatus", F.lit("|"), "l_linestatus"))).alias("a"))
    rules = s.createDataFrame([("R", "F", "upe"), ("A", "F", "dwe"), (None, "O", "exp")], "degree string, kind string, relation string")
    exact = rules.filter("degree IS NOT NULL")
    general = rules.filter("degree IS NULL").select("kind", F.col("relation").alias("any_degree"))
    got = pieces.select("l_suppkey", "l_partkey", "a.*").join(exact, ["degree", "kind"], "left").join(general, "kind", "left")
    return got.select("l_suppkey", "l_partkey", F.coalesce("relation", "any_degree", F.lit("afe")).alias("relation")).distinct().groupBy("relation").agg(F.count("*").alias("n_pairs"))


def _histogram(s, d):
    b = X.bucket(F.col("l_quantity"), [0.0, 10.0, 20.0, 30.0, 40.0, 50.0])
    return table(s, d, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), X.grouped_number(F.count("*")).alias("shown"))


def pair_scores(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("n1"), F.col("l_partkey").alias("n2"), F.col("l_discount").alias("score"))


def _pair_aggregates(s, d):
    return pair_scores(s, d).groupBy("n1", "n2").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("score"), 6).alias("avg_score"))


def _geomean(s, d):
    return T.geometric_mean(pair_scores(s, d), ["n1", "n2"], "score").select("n1", "n2", F.round("geomean", 6).alias("geomean"), "n")


def _override(s, d):
    best = pair_scores(s, d).groupBy("n1", "n2").agg(F.max("score").alias("score"))
    return T.top_with_override(best, "n1", "n2", "score", 0.1, 0.02, 100)


def matrix(s, d):
    """(sample, gene, raw, value): suppliers by brand and size, with the quantities sold."""
    l = table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount")
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("gene"), F.col("p_size").alias("raw"), F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).otherwise(0.0).alias("value"))


def _mean(s, d):
    return T.mean_of_duplicates(matrix(s, d), "sample", "raw")


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


def _exact(s, d):
    """Means rounded first, so that later ranks break ties alike everywhere."""
    return _rounded(_mean(s, d))


def _hits(s, d):
    """Binary matrix: a sample has a gene if any raw entry sold; those that hold, with their maximum."""
    m = T.known(matrix(s, d)).groupBy("sample", "gene").agg(F.max(F.when(F.col("value") >= 49, 1).otherwise(0)).alias("hit"))
    return m.filter("hit = 1").select("sample", "gene")


def _outliers(s, d):
    return T.without_outliers(edges(s, d).filter("relation = 'CPD-int-GEN'").select(F.col("node1").alias("n1"), F.col("node2").alias("n2")), 2.0)


def results(s, d):
    """Distinct result rows of the runs."""
    return table(s, d, "seccion12_tabla_completa").dropDuplicates()


def _pivot(s, d):
    r = results(s, d).select("run_id", "source", "relation", "test_auprc")
    return r.groupBy("source").pivot("relation", ["CLL-mut-GEN", "CPD-int-GEN", "CPD-trt-DIS", "GEN-ass-DIS", "GEN-ass-PWY", "GEN-ass-TIS", "GEN-ppi-GEN"]).agg(F.round(F.avg("test_auprc"), 6))


def _master(s, d):
    """By source: mean and median of the areas, beside the benchmark pairs of its runs; either side may lack."""
    a = results(s, d).groupBy("source").agg(F.round(F.avg("test_auprc"), 6).alias("auprc_mean"), F.round(F.median("test_auprc"), 6).alias("auprc_median"), F.round(F.avg("test_auroc"), 6).alias("auroc_mean"))
    b = table(s, d, "embedding_catalog").groupBy(F.col("embedding_source").alias("source")).agg(F.count("*").alias("n_vectors"), F.countDistinct("node_id").alias("n_nodes"))
    return a.join(b, "source", "full_outer")


def _best_run(s, d):
    r = results(s, d).select("relation", "run_id", "source", "test_auprc").filter("test_auprc IS NOT NULL AND relation IS NOT NULL")
    return E.distinct_on(r, ["relation"], [-F.col("test_auprc"), F.col("run_id")])


def _parameters(s, d):
    return results(s, d).groupBy("modelo_elegido", "linear_best_c").agg(F.count("*").alias("n_runs"), F.round(F.avg("threshold"), 6).alias("avg_threshold"), F.round(F.sum("elapsed_seconds"), 3).alias("seconds"))


QUERIES = {
    "map_first_wins": lambda s, d: P.first_wins(_map(s, d, "symbol", "gene")),
    "map_last_wins": lambda s, d: P.last_wins(_map(s, d, "symbol", "gene")),
    "map_one_to_many": lambda s, d: P.one_to_many(_map(s, d, "accession", "gene")),
    "map_many_to_many": lambda s, d: P.expand_pairs(_genes(s, d), "a", "b", _map(s, d, "gene", "symbol")),
    "map_coalesce": lambda s, d: P.mapped_or_self(_genes(s, d), "a", P.last_wins(_map(s, d, "gene", "symbol")), "name").groupBy("name").agg(F.count("*").alias("n")),
    "map_unmapped_count": lambda s, d: P.unmapped(_genes(s, d), "a", _map(s, d, "gene", "symbol").dropna()).agg(F.count("*").alias("n_rows"), F.countDistinct("a").alias("n_genes")),
    "map_bridge": lambda s, d: P.bridge(_map(s, d, "symbol", "gene"), _map(s, d, "gene", "accession")),
    "alias_union": lambda s, d: P.alias_union(mapping_rows(s, d), "gene", "symbol", "accession", "original"),
    "map_ambiguity": lambda s, d: P.ambiguity(_map(s, d, "gene", "accession")),
    "string_agg_multi": _ambiguous,
    "best_candidate": _candidates,
    "type_lookup": _node_types,
    "id_normalise": _ids,
    "list_explode": _exploded,
    "action_routing": _routed,
    "bucket_hist": _histogram,
    "pair_aggregates": _pair_aggregates,
    "geomean_per_pair": _geomean,
    "topn_override": _override,
    "topn_updown": lambda s, d: T.extremes(_exact(s, d), 5),
    "topn_updown_threshold": lambda s, d: T.extremes(_rounded(T.robust_scaled(_exact(s, d))), 5, 0.5),
    "topk_global": lambda s, d: pair_scores(s, d).groupBy("n2").agg(F.sum(F.bround(F.col("score") * 100).cast("bigint")).alias("total")).orderBy(F.desc("total"), "n2").limit(10),
    "matrix_mean": _exact,
    "robust_scale": lambda s, d: _rounded(T.robust_scaled(_exact(s, d))),
    # A mean of ten rounded values often ends in a 5; the small addend keeps the order of its sum from deciding the rounding.
    "quantile_norm": lambda s, d: _rounded(T.quantile_normalised(_exact(s, d)).withColumn("value", F.col("value") + 1e-9)),
    "sparsity_filter": lambda s, d: T.sparse_genes(_exact(s, d), 0.8),
    "unpivot_hits": _hits,
    "zscore_outliers": _outliers,
    "pivot_metric": _pivot,
    "master_outer_merge": _master,
    "argmax_run": _best_run,
    "hyperparameters": _parameters,
}

_PLACE = "('', 'none', 'nan', '-', 'n/a')"


def _strip(c):
    cls = r"[\s\x{00a0}\x{00ad}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
    return f"regexp_replace({c}, '^{cls}+|{cls}+$', '', 'g')"


def _real(c):
    return f"upper(CASE WHEN lower({_strip(c)}) NOT IN {_PLACE} THEN {_strip(c)} END)"


_NUM = r"nullif(regexp_extract(regexp_replace(lower(graph_node_id), '[^a-z0-9.]', '', 'g'), 'ensg\.?([0-9]+)', 1), '')"
ROWS = f"""m AS (SELECT * FROM (SELECT 'ENSG' || lpad(CAST(CAST({_NUM} AS BIGINT) AS VARCHAR), 11, '0') AS gene, map_id, {_real('simbolo_genico')} AS symbol, {_real('uniprot_accession')} AS accession,
  {_real('identificador_gen_original')} AS original, lower(trim(estado_mapeo)) AS state, uniprot_has_embedding AS v FROM gen_id_mapping_table) WHERE gene IS NOT NULL)"""
_PPI = CLEAN + ", g AS (SELECT upper(node1) AS a, upper(node2) AS b FROM e WHERE relation = 'GEN-ppi-GEN')"
_SCORE = "p AS (SELECT l_suppkey AS n1, l_partkey AS n2, l_discount AS score FROM lineitem)"
_MATRIX = """x AS (SELECT l_suppkey AS sample, p_brand AS gene, p_size AS raw, CASE WHEN l_discount > 0.01 THEN l_quantity ELSE 0.0 END AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
y AS (SELECT sample, gene, round(avg(value), 6) AS value FROM (SELECT sample, gene, raw, avg(value) AS value FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_SCALED = _MATRIX + ", q AS (SELECT gene, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM y GROUP BY 1), z AS (SELECT sample, gene, round((value - q[2]) / CASE WHEN q[3] = q[1] THEN 1 ELSE q[3] - q[1] END, 6) AS value FROM y JOIN q USING (gene))"
_UPDOWN = """SELECT sample, gene, value, 'up' AS side FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS r FROM {t}) WHERE r <= 5{up}
UNION ALL SELECT sample, gene, value, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, gene) AS r FROM {t}) WHERE r <= 5{down}"""
_RUNS = "r AS (SELECT DISTINCT * FROM seccion12_tabla_completa)"
_KIND = [("reviewed", "reviewed"), ("reviewed_vector", "reviewed AND v"), ("unreviewed", "NOT reviewed"), ("unreviewed_vector", "NOT reviewed AND v")]

ORACLE = {
    "map_first_wins": f"WITH {ROWS} SELECT DISTINCT ON (symbol) symbol AS key, gene AS value FROM m WHERE symbol IS NOT NULL ORDER BY symbol, map_id, gene",
    "map_last_wins": f"WITH {ROWS} SELECT DISTINCT ON (symbol) symbol AS key, gene AS value FROM m WHERE symbol IS NOT NULL ORDER BY symbol, map_id DESC, gene DESC",
    "map_one_to_many": f"WITH {ROWS} SELECT DISTINCT accession AS key, gene AS value FROM m WHERE accession IS NOT NULL",
    "map_many_to_many": f"WITH {ROWS}, {_PPI} SELECT DISTINCT least(x.symbol, y.symbol) AS n1, greatest(x.symbol, y.symbol) AS n2 FROM g JOIN m x ON x.gene = a JOIN m y ON y.gene = b WHERE x.symbol <> y.symbol",
    "map_coalesce": f"WITH {ROWS}, {_PPI}, l AS (SELECT DISTINCT ON (gene) gene, symbol FROM m WHERE symbol IS NOT NULL ORDER BY gene, map_id DESC, symbol DESC) SELECT coalesce(symbol, a) AS name, count(*) AS n FROM g LEFT JOIN l ON gene = a GROUP BY 1",
    "map_unmapped_count": f"WITH {ROWS}, {_PPI} SELECT count(*) AS n_rows, count(DISTINCT a) AS n_genes FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE gene = a AND symbol IS NOT NULL)",
    "map_bridge": f"WITH {ROWS} SELECT DISTINCT x.symbol AS key, y.accession AS value FROM m x JOIN m y USING (gene) WHERE x.symbol IS NOT NULL AND y.accession IS NOT NULL",
    "alias_union": f"WITH {ROWS} SELECT symbol AS key, gene AS value FROM m WHERE symbol IS NOT NULL UNION SELECT accession, gene FROM m WHERE accession IS NOT NULL UNION SELECT original, gene FROM m WHERE original IS NOT NULL",
    "map_ambiguity": f"WITH {ROWS}, p AS (SELECT DISTINCT gene, accession FROM m WHERE accession IS NOT NULL), k AS (SELECT count(*) AS n FROM p GROUP BY gene), v AS (SELECT count(*) AS n FROM p GROUP BY accession) SELECT (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM k WHERE n > 1) AS keys_of_many, (SELECT count(*) FROM v) AS n_values, (SELECT count(*) FROM v WHERE n > 1) AS values_of_many",
    "string_agg_multi": f"WITH {ROWS}, p AS (SELECT DISTINCT gene, accession FROM m WHERE accession IS NOT NULL), s AS (SELECT accession, count(*) AS n FROM p GROUP BY 1) SELECT gene, string_agg(accession, ';' ORDER BY accession) AS accessions, count(*) AS n_accessions, max(n) AS max_genes FROM p JOIN s USING (accession) GROUP BY 1 HAVING count(*) > 1",
    "best_candidate": f"""WITH {ROWS}, c AS (SELECT gene, accession AS a, coalesce(starts_with(state, 'mapeado_revisado'), false) AS reviewed, coalesce(v, false) AS v FROM m),
k AS (SELECT gene, {", ".join(f"count(DISTINCT a) FILTER ({c}) AS n_{n}, min(a) FILTER ({c}) AS v_{n}" for n, c in _KIND)} FROM c GROUP BY 1)
SELECT gene AS key, CASE WHEN n_reviewed = 1 THEN v_reviewed WHEN n_reviewed > 1 AND n_reviewed_vector >= 1 THEN v_reviewed_vector WHEN n_reviewed > 1 THEN v_reviewed WHEN n_unreviewed = 1 THEN v_unreviewed WHEN n_unreviewed > 1 AND n_unreviewed_vector >= 1 THEN v_unreviewed_vector WHEN n_unreviewed > 1 THEN v_unreviewed END AS value,
CASE WHEN n_reviewed = 1 THEN 'reviewed' WHEN n_reviewed > 1 AND n_reviewed_vector >= 1 THEN 'reviewed_by_vector' WHEN n_reviewed > 1 THEN 'reviewed_by_order' WHEN n_unreviewed = 1 THEN 'unreviewed' WHEN n_unreviewed > 1 AND n_unreviewed_vector >= 1 THEN 'unreviewed_by_vector' WHEN n_unreviewed > 1 THEN 'unreviewed_by_order' ELSE 'none' END AS state FROM k""",
    "type_lookup": f"""WITH {CLEAN}, n AS (SELECT node1 AS node, node1_type AS t FROM e UNION ALL SELECT node2, node2_type FROM e), l AS (SELECT node, max(t) AS t FROM n WHERE t <> 'DESCONOCIDO' GROUP BY 1), c AS (SELECT {alnum('node_id')} AS node FROM embedding_catalog)
SELECT coalesce(t, 'DESCONOCIDO') AS node_type, count(*) AS n_vectors, count(DISTINCT c.node) AS n_nodes FROM c LEFT JOIN l ON l.node = c.node GROUP BY 1""",
    "id_normalise": f"""WITH r AS (SELECT DISTINCT regexp_replace(node2, '^ +| +$', '', 'g') AS raw FROM graph_edges WHERE node2_type = 'DIS'), u AS (SELECT raw, upper(raw) AS up, split_part(split_part(split_part(raw, ':', -1), '_', -1), ' ', 1) AS code FROM r)
SELECT raw, CASE WHEN length(raw) <= 1 OR regexp_matches(up, '{"|".join(X.IGNORED_VOCABULARIES)}') THEN NULL {" ".join(f"WHEN regexp_matches(up, '{m}') THEN '{p}:' || code" for m, p in (*X.DISEASE_RULES, *X.NAKED_RULES))} END AS disease, split_part(raw, ':', -1) AS code FROM u""",
    "list_explode": "SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1",
    "action_routing": "SELECT relation, count(*) AS n_pairs FROM (SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'upe' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'dwe' WHEN l_linestatus = 'O' THEN 'exp' ELSE 'afe' END AS relation FROM lineitem) GROUP BY 1",
    "bucket_hist": "SELECT CAST(CASE WHEN l_quantity < 0 OR l_quantity > 50 THEN NULL WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n, format('{:,}', count(*)) AS shown FROM lineitem GROUP BY 1",
    "pair_aggregates": f"WITH {_SCORE} SELECT n1, n2, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS avg_score FROM p GROUP BY 1, 2",
    "geomean_per_pair": f"WITH {_SCORE} SELECT n1, n2, CASE WHEN min(score) = 0 THEN 0.0 ELSE round(exp(avg(CASE WHEN score > 0 THEN ln(score) END)), 6) END AS geomean, count(*) AS n FROM p WHERE score >= 0 GROUP BY 1, 2",
    "topn_override": f"WITH {_SCORE}, b AS (SELECT n1, n2, max(score) AS score FROM p GROUP BY 1, 2) SELECT n1, n2, score FROM (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY score DESC, n2) AS r FROM b WHERE score >= 0.02) WHERE score >= 0.1 OR r <= 100",
    "topn_updown": f"WITH {_MATRIX} " + _UPDOWN.format(t="y", up="", down=""),
    "topn_updown_threshold": f"WITH {_SCALED} " + _UPDOWN.format(t="z", up=" AND value >= 0.5", down=" AND value <= -0.5"),
    "topk_global": f"WITH {_SCORE} SELECT n2, CAST(sum(CAST(round_even(score * 100, 0) AS BIGINT)) AS BIGINT) AS total FROM p GROUP BY 1 ORDER BY total DESC, n2 LIMIT 10",
    "matrix_mean": f"WITH {_MATRIX} SELECT sample, gene, value FROM y",
    "robust_scale": f"WITH {_SCALED} SELECT sample, gene, value FROM z",
    "quantile_norm": f"WITH {_MATRIX}, o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, gene) AS k, rank() OVER (PARTITION BY sample ORDER BY value) AS r FROM y), a AS (SELECT k, avg(value) AS v FROM o GROUP BY 1) SELECT sample, gene, round(v + 1e-9, 6) AS value FROM o JOIN a ON a.k = o.r",
    "sparsity_filter": f"WITH {_MATRIX} SELECT gene, count(*) FILTER (value <> 0) AS n FROM y GROUP BY 1 HAVING count(*) FILTER (value <> 0) >= (SELECT floor(count(DISTINCT sample) * 0.8) FROM y)",
    "unpivot_hits": f"WITH {_MATRIX} SELECT sample, gene FROM x GROUP BY 1, 2 HAVING max(value) >= 49",
    "zscore_outliers": f"""WITH {CLEAN}, p AS (SELECT DISTINCT node1 AS n1, node2 AS n2 FROM e WHERE relation = 'CPD-int-GEN'), a AS (SELECT n1, count(*) AS d FROM p GROUP BY 1), b AS (SELECT n2, count(*) AS d FROM p GROUP BY 1)
SELECT n1, n2 FROM p WHERE n1 NOT IN (SELECT n1 FROM a WHERE (d - (SELECT avg(d) FROM a)) / (SELECT stddev_pop(d) FROM a) > 2) AND n2 NOT IN (SELECT n2 FROM b WHERE (d - (SELECT avg(d) FROM b)) / (SELECT stddev_pop(d) FROM b) > 2)""",
    "pivot_metric": f"WITH {_RUNS} SELECT source, " + ", ".join(f"round(avg(test_auprc) FILTER (relation = '{x}'), 6) AS \"{x}\"" for x in ["CLL-mut-GEN", "CPD-int-GEN", "CPD-trt-DIS", "GEN-ass-DIS", "GEN-ass-PWY", "GEN-ass-TIS", "GEN-ppi-GEN"]) + " FROM r GROUP BY 1",
    "master_outer_merge": f"WITH {_RUNS}, a AS (SELECT source, round(avg(test_auprc), 6) AS auprc_mean, round(median(test_auprc), 6) AS auprc_median, round(avg(test_auroc), 6) AS auroc_mean FROM r GROUP BY 1), b AS (SELECT embedding_source AS source, count(*) AS n_vectors, count(DISTINCT node_id) AS n_nodes FROM embedding_catalog GROUP BY 1) SELECT * FROM a FULL JOIN b USING (source)",
    "argmax_run": f"WITH {_RUNS} SELECT DISTINCT ON (relation) relation, run_id, source, test_auprc FROM r WHERE test_auprc IS NOT NULL AND relation IS NOT NULL ORDER BY relation, test_auprc DESC, run_id",
    "hyperparameters": f"WITH {_RUNS} SELECT modelo_elegido, linear_best_c, count(*) AS n_runs, round(avg(threshold), 6) AS avg_threshold, round(sum(elapsed_seconds), 3) AS seconds FROM r GROUP BY 1, 2",
}
