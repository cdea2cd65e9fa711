"""Queries of the functional benchmarks (GO terms and BioGRID pairs), and comparisons of all embedding spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.text import ensg, folded
from edgeloom.operators import benchmarks as B
from edgeloom.operators import edges as E
from edgeloom.operators import metrics as M
from edgeloom.operators import vectors as V
from edgeloom.plans.durable import materialise
from edgeloom.queries_graph import AREAS
from edgeloom.session import table


def gene_vectors(s, d) -> DataFrame:
    """(source, seed, gene, vec): each gene's last sound vector in each space."""
    v = V.latest_vectors(table(s, d, "embedding_catalog"), ensg("node_id"))
    return v.filter("node IS NOT NULL").withColumnRenamed("node", "gene")


def go_genes(s, d) -> DataFrame:
    """(go_term, gene, split, label): the distinct genes of each term; the label is positive if any row says so.

    A gene of the holdout is taken out of the folds; one in several folds stays in the first.
    """
    rows = table(s, d, "go_split").select("go_term", ensg("ensg").alias("gene"), folded("split").alias("split"), "label").dropna().filter((F.col("split") == "holdout") | F.col("split").isin(*B.FOLDS))
    held = F.max(F.col("split") == "holdout")
    return rows.groupBy("go_term", "gene").agg(F.when(held, "holdout").otherwise(F.min("split")).alias("split"), F.max("label").alias("label"))


def biogrid_pairs(s, d) -> DataFrame:
    """(task, outer_fold, split, inner_fold, pair, a, b, label): the distinct pairs of each part; a pair with a gene of the outer test is taken out of the training parts."""
    rows = table(s, d, "biogrid_split").select(
        "task", "outer_fold", folded("fold_partition").alias("split"), F.coalesce("inner_fold", F.lit(-1)).alias("inner_fold"), F.col("pair_index_reference").alias("pair"), ensg("ensg_a").alias("a"), ensg("ensg_b").alias("b"), "label",
    ).dropna().distinct()
    rows = materialise(rows, "pairs")
    test = rows.filter("split = 'outer_test'").select("task", "outer_fold", F.explode(F.array("a", "b")).alias("g")).distinct()
    train = rows.filter("split <> 'outer_test'")
    for end in ("a", "b"):
        train = train.join(test.withColumnRenamed("g", end), ["task", "outer_fold", end], "left_anti")
    return train.select(*rows.columns).unionByName(rows.filter("split = 'outer_test'"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def go_benchmark(s, d) -> DataFrame:
    """One row a space and term: the exact machine chosen by three folds and judged on the holdout. Genes without a vector are left out."""
    rows = go_genes(s, d).join(gene_vectors(s, d), "gene")
    return _rounded(B.per_unit(rows, ["source", "seed", "go_term"], ["gene"], B.term_unit, B.TERM_COLUMNS))


def biogrid_benchmark(s, d) -> DataFrame:
    """One row a space, task and outer fold: the exact machine on the sum of the two genes' vectors, chosen by the inner folds."""
    v = gene_vectors(s, d)
    a, b = v.select("source", "seed", F.col("gene").alias("a"), F.col("vec").alias("va")), v.select("source", "seed", F.col("gene").alias("b"), F.col("vec").alias("vb"))
    rows = biogrid_pairs(s, d).join(a, "a").join(b, ["source", "seed", "b"]).withColumn("vec", V.feature_sum(F.col("va"), F.col("vb"))).drop("va", "vb")
    return _rounded(B.per_unit(rows, ["source", "seed", "task", "outer_fold"], ["split", "inner_fold", "pair", "a", "b", "label"], B.nested_unit, B.NESTED_COLUMNS))


def _summary(s, d):
    """Both benchmarks by space, one beside the other."""
    go = B.summary(materialise(go_benchmark(s, d), "go"), ["source", "seed"], ["test_auroc", "test_auprc"])
    bio = B.summary(materialise(biogrid_benchmark(s, d), "biogrid"), ["source", "seed"], ["test_auroc", "test_pr_at_10"])
    name = lambda df, p: df.select("source", "seed", *[F.col(c).alias(f"{p}_{c}") for c in df.columns[2:]])
    return _rounded(name(go, "go").join(name(bio, "biogrid"), ["source", "seed"], "full"))


def _go_folds(s, d):
    """(source, seed, go_term, split, n_genes, n_positive, n_with_vector): what each unit has to train and test on."""
    genes = materialise(go_genes(s, d), "genes")
    spaces = gene_vectors(s, d).select("source", "seed", "gene")
    spaces = materialise(spaces, "spaces")
    have = genes.join(spaces, "gene").groupBy("source", "seed", "go_term", "split").agg(F.count("*").alias("n_with_vector"))
    sizes = genes.groupBy("go_term", "split").agg(F.count("*").alias("n_genes"), F.sum("label").alias("n_positive"))
    every = sizes.crossJoin(F.broadcast(spaces.select("source", "seed").distinct()))  # a handful of spaces
    return every.join(have, ["source", "seed", "go_term", "split"], "left").na.fill(0, ["n_with_vector"])


def _biogrid_folds(s, d):
    """(task, outer_fold, split, inner_fold, n_pairs, n_positive) after pairs with a gene of the outer test left the training parts."""
    return biogrid_pairs(s, d).groupBy("task", "outer_fold", "split", "inner_fold").agg(F.count("*").alias("n_pairs"), F.sum("label").alias("n_positive"))


def _biogrid_scored(s, d):
    v = gene_vectors(s, d)
    a, b = v.select("source", "seed", F.col("gene").alias("a"), F.col("vec").alias("va")), v.select("source", "seed", F.col("gene").alias("b"), F.col("vec").alias("vb"))
    return biogrid_pairs(s, d).filter("split = 'outer_test'").join(a, "a").join(b, ["source", "seed", "b"]).select("source", "seed", "task", "label", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("score"))


def _biogrid_cosine(s, d):
    """(source, seed, task, auroc, auprc, n_test, n_pos_test): the outer tests of all folds pooled, scored by the cosine of the two genes."""
    return M.ranking_report(_biogrid_scored(s, d), ["source", "seed", "task"])


#: Nodes that two spaces must share at least to be compared, and those that Spearman and neighbours take as queries at most.
LEAST_COMMON = 30
SAMPLE = 1500
NEAREST = (10, 25, 50)


def compared_spaces(s, d, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(shared, sampled): the nodes (pair, node, va, vb) of each two spaces with enough in common, and the sampled ones of them; pair is ``source/seed|source/seed`` in byte order."""
    v = V.latest_vectors(table(s, d, "embedding_catalog").filter("node_type = 'GEN'"), ensg("node_id")).filter("node IS NOT NULL")
    v = v.select(F.concat_ws("/", "source", "seed").alias("space"), "node", "vec")
    a, b = v.toDF("sa", "node", "va"), v.toDF("sb", "node", "vb")
    both = materialise(a.join(b, "node").filter("sa < sb").select(F.concat_ws("|", "sa", "sb").alias("pair"), "node", "va", "vb"), "common")
    enough = both.groupBy("pair").agg(F.count("*").alias("n_common")).filter(F.col("n_common") >= LEAST_COMMON)
    shared = materialise(both.join(enough, "pair"), "shared")
    place = V.ranked(shared.select("pair", "node", V.keyed_md5(42, "node").alias("_h")), ["pair"], ["_h", "node"], "_r").filter(F.col("_r") <= sample)
    return both, materialise(shared.join(place.select("pair", "node"), ["pair", "node"]), "sampled")


def _space_pairs(s, d):
    """One row for each two spaces: common nodes, and, with enough of them, Spearman of all sampled similarities and the neighbours' mean overlap among all common nodes."""
    both, sampled = compared_spaces(s, d)
    parts = F.ceil(F.col("n_common") / V.NODES_A_TASK).cast("int")
    every = both.join(sampled.select("pair", parts.alias("parts")).distinct(), "pair").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    asked = sampled.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    columns = ["pair", "part", "node", "va", "vb"]
    near = V.nearest_parts(asked.select(columns), every.select(columns), max(NEAREST))
    rho = V.sample_spearman(sampled)
    near = V.jaccard_of(near, list(NEAREST)).groupBy("pair").pivot("k", list(NEAREST)).agg(F.first("jaccard"))
    sizes = both.groupBy("pair").agg(F.count("*").alias("n_common"))
    out = sizes.join(rho, "pair", "left").join(near, "pair", "left")
    return out.select("pair", "n_common", "n_pairs", "spearman", *[F.col(str(k)).alias(f"jaccard_{k}") for k in NEAREST])


def _space_fits(s, d):
    """(pair, n_common, linear_cka, ridge_r2, ridge_r2_std): over all common nodes, predicting the second space from the first in five folds."""
    both, sampled = compared_spaces(s, d)
    shared = both.join(sampled.select("pair").distinct(), "pair", "left_semi")
    names = sorted(r.pair for r in shared.select("pair").distinct().collect())  # pairs of spaces, not of nodes
    index = s.createDataFrame(list(enumerate(names)), "p int, pair string")
    fold = F.pmod(F.conv(F.substring(V.keyed_md5(42, "node"), 1, 8), 16, 10).cast("bigint"), F.lit(5))
    grams = V.grams(shared.join(F.broadcast(index), "pair").withColumn("k", F.col("p") * 5 + fold), "k")
    out = []
    for i, name in enumerate(names):
        parts = {k: g for k, g in grams.items() if k // 5 == i}
        cka, ridge = V.cka_of(*(sum(g[j] for g in parts.values()) for j in range(3))), V.ridge_of(parts)
        out.append((name, sum(g[2] for g in parts.values()), None if cka is None else round(cka, 4), *((None, None) if ridge is None else (round(r, 4) for r in ridge))))
    return s.createDataFrame(out, "pair string, n_common bigint, linear_cka double, ridge_r2 double, ridge_r2_std double")


QUERIES = {
    "go_benchmark": go_benchmark,
    "biogrid_benchmark": biogrid_benchmark,
    "benchmark_summary": _summary,
    "go_folds": _go_folds,
    "biogrid_folds": _biogrid_folds,
    "biogrid_cosine": _biogrid_cosine,
    "space_pairs": _space_pairs,
    "space_fits": _space_fits,
}

_NUMBER = r"nullif(regexp_extract(regexp_replace(lower({}), '[^a-z0-9.]', '', 'g'), 'ensg\.?([0-9]+)', 1), '')"


def _ensg(c: str) -> str:
    return f"'ENSG' || lpad(CAST(CAST({_NUMBER.format(c)} AS BIGINT) AS VARCHAR), 11, '0')"


_VEC = f"""vec AS MATERIALIZED (SELECT DISTINCT ON (source, seed, gene) embedding_source AS source, seed, {_ensg('node_id')} AS gene, CAST(embedding AS DOUBLE[]) AS v FROM embedding_catalog
  WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND {_NUMBER.format('node_id')} IS NOT NULL ORDER BY source, seed, gene, exported_at DESC, vec_id)"""
_GO = f"""gr AS (SELECT go_term, {_ensg('ensg')} AS gene, lower(trim(split)) AS split, label FROM go_split WHERE go_term IS NOT NULL AND label IS NOT NULL AND {_NUMBER.format('ensg')} IS NOT NULL),
gg AS (SELECT go_term, gene, CASE WHEN bool_or(split = 'holdout') THEN 'holdout' ELSE min(split) END AS split, max(label) AS label FROM gr WHERE split IN ('holdout', 'cv_fold1', 'cv_fold2', 'cv_fold3') GROUP BY 1, 2)"""
_BIO = f"""br AS (SELECT DISTINCT task, outer_fold, lower(trim(fold_partition)) AS split, CAST(coalesce(inner_fold, -1) AS INTEGER) AS inner_fold, pair_index_reference AS pair, {_ensg('ensg_a')} AS a, {_ensg('ensg_b')} AS b, label FROM biogrid_split
  WHERE task IS NOT NULL AND outer_fold IS NOT NULL AND fold_partition IS NOT NULL AND pair_index_reference IS NOT NULL AND label IS NOT NULL AND {_NUMBER.format('ensg_a')} IS NOT NULL AND {_NUMBER.format('ensg_b')} IS NOT NULL),
bt AS (SELECT DISTINCT task, outer_fold, unnest([a, b]) AS g FROM br WHERE split = 'outer_test'),
bp AS (SELECT * FROM br WHERE split = 'outer_test' OR NOT EXISTS (SELECT 1 FROM bt WHERE bt.task = br.task AND bt.outer_fold = br.outer_fold AND (g = a OR g = b)))"""
_PAIR = f"""one AS MATERIALIZED (SELECT DISTINCT ON (source, seed, node) embedding_source AS source, seed, {_ensg('node_id')} AS node, CAST(embedding AS DOUBLE[]) AS v FROM embedding_catalog
  WHERE node_type = 'GEN' AND len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND {_NUMBER.format('node_id')} IS NOT NULL ORDER BY source, seed, node, exported_at DESC, vec_id),
sp AS (SELECT concat_ws('/', source, seed) AS space, node, v FROM one), bo AS MATERIALIZED (SELECT a.space || '|' || b.space AS pair, a.node, a.v AS va, b.v AS vb FROM sp a JOIN sp b ON a.node = b.node AND a.space < b.space),
nc AS (SELECT pair, count(*) AS n_common FROM bo GROUP BY 1), sh AS MATERIALIZED (SELECT bo.*, row_number() OVER (PARTITION BY pair ORDER BY md5(concat_ws('|', '42', node)), node) AS r FROM bo JOIN nc USING (pair) WHERE n_common >= {LEAST_COMMON}),
sims AS MATERIALIZED (SELECT x.pair, x.node AS x, y.node AS y, y.r AS yr, round(list_cosine_similarity(x.va, y.va), 8) AS sa, round(list_cosine_similarity(x.vb, y.vb), 8) AS sb FROM sh x JOIN sh y ON x.pair = y.pair AND x.node <> y.node WHERE x.r <= {SAMPLE}),
rk AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY sa) + (count(*) OVER (PARTITION BY pair, sa) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair ORDER BY sb) + (count(*) OVER (PARTITION BY pair, sb) - 1) / 2.0 AS b FROM sims WHERE x < y AND yr <= {SAMPLE}),
rho AS (SELECT pair, round(corr(a, b), 6) AS spearman, count(*) AS n_pairs FROM rk GROUP BY 1),
o AS (SELECT pair, x, row_number() OVER (PARTITION BY pair, x ORDER BY sa DESC, y) AS ra, row_number() OVER (PARTITION BY pair, x ORDER BY sb DESC, y) AS rb FROM sims),
j AS (SELECT pair, {", ".join(f"round(avg(j{k}), 6) AS jaccard_{k}" for k in NEAREST)} FROM (SELECT pair, x, {", ".join(f"count(*) FILTER (ra <= {k} AND rb <= {k}) / count(*) FILTER (ra <= {k} OR rb <= {k}) AS j{k}" for k in NEAREST)} FROM o GROUP BY 1, 2) GROUP BY 1)"""

ORACLE = {
    "go_folds": f"WITH {_VEC}, {_GO}, z AS (SELECT go_term, split, count(*) AS n_genes, CAST(sum(label) AS BIGINT) AS n_positive FROM gg GROUP BY 1, 2), h AS (SELECT source, seed, go_term, split, count(*) AS n FROM gg JOIN vec USING (gene) GROUP BY 1, 2, 3, 4), w AS (SELECT DISTINCT source, seed FROM vec) SELECT source, seed, go_term, split, n_genes, n_positive, coalesce(n, 0) AS n_with_vector FROM z CROSS JOIN w LEFT JOIN h USING (source, seed, go_term, split)",
    "biogrid_folds": f"WITH {_BIO} SELECT task, outer_fold, split, inner_fold, count(*) AS n_pairs, CAST(sum(label) AS BIGINT) AS n_positive FROM bp GROUP BY 1, 2, 3, 4",
    "biogrid_cosine": f"WITH {_VEC}, {_BIO}, l AS (SELECT x.source, x.seed, task, label, round(CASE WHEN list_inner_product(x.v, x.v) > 0 AND list_inner_product(y.v, y.v) > 0 THEN list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) ELSE 0 END, 6) AS score FROM bp JOIN vec x ON x.gene = a JOIN vec y ON y.gene = b AND y.source = x.source AND y.seed = x.seed WHERE split = 'outer_test')"
    + AREAS.format(g="source, seed, task")
    + " SELECT source, seed, task, round(sum(p * (neg - fp + 0.5 * n)) / nullif(max(pos * neg), 0), 6) AS auroc, round(sum(p / nullif(pos, 0) * tp / (tp + fp)), 6) AS auprc, CAST(sum(p + n) AS BIGINT) AS n_test, CAST(sum(p) AS BIGINT) AS n_pos_test FROM c GROUP BY 1, 2, 3",
    "space_pairs": f"WITH {_PAIR} SELECT pair, n_common, n_pairs, spearman, {', '.join(f'jaccard_{k}' for k in NEAREST)} FROM nc LEFT JOIN rho USING (pair) LEFT JOIN j USING (pair)",
}
