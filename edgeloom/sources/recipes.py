"""The source databases' recipes: raw tables and mappings to pairs (n1, n2[, score], relation).

Mappings are (key, value). What a mapping lacks is dropped. Every recipe ends
in distinct pairs, so repeated raw rows don't matter, and empty inputs give
empty pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import scalars as X
from edgeloom.operators import mapping as P
from edgeloom.operators import stats as T
from edgeloom.operators.edges import incongruent, union_all

HUMAN = "9606"


def _pairs(df: DataFrame, a: str | Column, b: str | Column, *rest) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(a).alias("n1"), col(b).alias("n2"), *rest).dropna(subset=["n1", "n2"]).distinct()


def signed_profiles(raw: DataFrame, symbols: DataFrame, lines: DataFrame, up: str, down: str) -> DataFrame:
    """(source, target, weight) of cell lines and symbols: weight 1 is ``up``, -1 ``down``; other weights and bad numbers are left out."""
    w = X.number_or_null(F.col("weight"))
    rows = raw.withColumn("relation", F.when(w == 1, up).when(w == -1, down)).filter("relation IS NOT NULL")
    rows = P.mapped(P.mapped(rows, "source", symbols, "gene"), "target", lines, "line")
    return _pairs(rows, "line", "gene", "relation")


def mutations(matrices: list[DataFrame], symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of 1 in any of the matrices (sample, gene, value), whose genes are ``SYMBOL (ENTREZ)``."""
    hit = union_all(matrices).filter("value = 1").select("sample", X.symbol_of(F.col("gene")).alias("symbol")).distinct()
    return _pairs(P.mapped(P.mapped(hit, "symbol", symbols, "gene"), "sample", lines, "line"), "line", "gene", F.lit("CLL-mut-GEN").alias("relation"))


def expression(matrix: DataFrame, symbols: DataFrame, lines: DataFrame, k: int = 250) -> DataFrame:
    """The k highest and lowest genes of each cell line after means, quantile normalisation and robust scaling."""
    kept = matrix.join(T.sparse_genes(matrix).select("gene"), "gene", "left_semi")
    named = P.mapped(P.mapped(kept.withColumn("symbol", X.symbol_of(F.col("gene"))).withColumnRenamed("gene", "raw"), "symbol", symbols, "gene").withColumnRenamed("sample", "model"), "model", lines, "sample")
    scaled = T.robust_scaled(T.quantile_normalised(T.mean_of_duplicates(named, "model", "raw")))
    return _pairs(T.extremes(scaled, k), "sample", "gene", F.when(F.col("side") == "up", "CLL-upr-GEN").otherwise("CLL-dwr-GEN").alias("relation"))


def tissue_expression(levels: DataFrame, k: int = 250, least: float = 0.5) -> DataFrame:
    """(sample, gene, value) of tissues: robust scaling of means, then the k extremes beyond +-least."""
    mean = T.known(levels).groupBy("sample", "gene").agg(F.avg("value").alias("value"))
    return _pairs(T.extremes(T.robust_scaled(mean), k, least), "gene", "sample", F.when(F.col("side") == "up", "GEN-upr-TIS").otherwise("GEN-dwr-TIS").alias("relation"))


def coexpression(ranks: DataFrame, entrez: DataFrame, reliable: DataFrame, share: float = 0.1) -> DataFrame:
    """(key, target, rank): pairs of reliable genes among each key's best share, with the geometric mean of both ranks, rounded."""
    good = ranks.filter(~F.isnan("rank")).withColumn("rank", X.clamped(F.col("rank")))
    limit = reliable.agg(F.ceil(F.count("*") * share).alias("upto"))
    genes = reliable.select("gene")
    near = good.crossJoin(limit).filter("rank <= upto").join(genes.toDF("key"), "key", "left_semi").join(genes.toDF("target"), "target", "left_semi")
    many = P.one_to_many(entrez)
    named = P.mapped(P.mapped(near, "key", many, "a"), "target", many, "b").filter("a <> b")
    both = named.select(F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2"), "rank")
    return T.geometric_mean(both, ["n1", "n2"], "rank").select("n1", "n2", F.round("geomean").cast("int").alias("mutual_rank"), F.lit("GEN-cex-GEN").alias("relation"))


def chemical_actions(raw: DataFrame, entrez: DataFrame, chemicals: DataFrame, rules: DataFrame, default: str = "afe") -> DataFrame:
    """(ChemicalID, GeneID, OrganismID, InteractionActions) of humans; ``rules`` are (kind, degree or null, relation)."""
    rows = raw.filter(F.col("OrganismID") == HUMAN).select("ChemicalID", "GeneID", F.explode(X.action_pieces(F.col("InteractionActions"))).alias("p")).select("ChemicalID", "GeneID", "p.*")
    exact = rules.filter("degree IS NOT NULL")
    general = rules.filter("degree IS NULL").select("kind", F.col("relation").alias("_any"))
    routed = rows.join(exact, ["kind", "degree"], "left").join(general, "kind", "left").withColumn("relation", F.concat(F.lit("CPD-"), F.coalesce("relation", "_any", F.lit(default)), F.lit("-GEN")))
    named = P.mapped(P.mapped_or_self(routed, "ChemicalID", chemicals, "chemical"), "GeneID", entrez, "gene")
    return _pairs(named, "chemical", "gene", "relation")


def chemical_diseases(raw: DataFrame, chemicals: DataFrame) -> DataFrame:
    """(ChemicalID, DiseaseID, DirectEvidence): therapeutic is trt, marker/mechanism cau; without direct evidence nothing."""
    e = F.lower(F.trim("DirectEvidence"))
    rows = raw.withColumn("relation", F.when(e == "therapeutic", "CPD-trt-DIS").when(e.contains("marker"), "CPD-cau-DIS")).filter("relation IS NOT NULL")
    return _pairs(P.mapped_or_self(rows, "ChemicalID", chemicals, "chemical"), "chemical", X.disease_id(F.col("DiseaseID")), "relation")


def gene_diseases(raw: DataFrame, entrez: DataFrame) -> DataFrame:
    """(GeneID, DiseaseID, DirectEvidence): genes of direct evidence, 1:N."""
    rows = P.mapped(raw.filter(F.trim("DirectEvidence") != ""), "GeneID", P.one_to_many(entrez), "gene")
    return _pairs(rows, "gene", X.disease_id(F.col("DiseaseID")), F.lit("GEN-ass-DIS").alias("relation"))


def regulation(raw: DataFrame, reviewed: DataFrame, proteins: DataFrame, levels: str) -> DataFrame:
    """Directed regulation of the levels' letters: all as reg, stimulation as upr, inhibition as dwr."""
    rows = raw.filter((F.col("dorothea") == True) & (F.col("ncbi_tax_id_source") == HUMAN) & (F.col("ncbi_tax_id_target") == HUMAN) & F.col("dorothea_level").rlike(f"[{levels}]"))  # noqa: E712
    rows = _reviewed(rows, reviewed, "source", "target")
    part = lambda d, r: P.expand_pairs(d, "source", "target", proteins, symmetric=False).withColumn("relation", F.lit(r))
    return union_all([part(rows, "GEN-reg-GEN"), part(rows.filter("consensus_stimulation"), "GEN-upr-GEN"), part(rows.filter("consensus_inhibition"), "GEN-dwr-GEN")])


def _reviewed(rows: DataFrame, reviewed: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.join(reviewed.select(F.col("protein").alias(c)).distinct(), c, "left_semi")
    return rows


def interactions(raw: DataFrame, enzymes: DataFrame, reviewed: DataFrame, proteins: DataFrame) -> DataFrame:
    """Protein interactions without direction, and (de)phosphorylation with it."""
    ppi = raw.filter((F.col("omnipath") == True) & (F.col("ncbi_tax_id_source") == HUMAN) & (F.col("ncbi_tax_id_target") == HUMAN))  # noqa: E712
    out = [P.expand_pairs(_reviewed(ppi, reviewed, "source", "target"), "source", "target", proteins).withColumn("relation", F.lit("GEN-ppi-GEN"))]
    sites = _reviewed(enzymes.filter(F.col("ncbi_tax_id") == HUMAN), reviewed, "enzyme", "substrate")
    for kind, relation in (("phosphorylation", "GEN-pho-GEN"), ("dephosphorylation", "GEN-dph-GEN")):
        out.append(P.expand_pairs(sites.filter(F.col("modification") == kind), "enzyme", "substrate", proteins, symmetric=False).withColumn("relation", F.lit(relation)))
    return union_all(out)


def proteome(raw: DataFrame) -> DataFrame:
    """(Gene, Tissue, Level, Reliability): high is pab, low pdf; pairs that are both are neither. A null reliability counts as certain."""
    sure = raw.filter(~F.col("Reliability").eqNullSafe("Uncertain")).select(F.col("Gene").alias("n1"), F.col("Tissue").alias("n2"), "Level").dropna(subset=["n1", "n2"])
    high, low, _ = incongruent(sure.filter("Level = 'High'"), sure.filter("Level = 'Low'"), ["n1", "n2"])
    return high.withColumn("relation", F.lit("GEN-pab-TIS")).unionByName(low.withColumn("relation", F.lit("GEN-pdf-TIS")))


def tissues(raw: DataFrame, proteins: DataFrame, root: str) -> DataFrame:
    """(protein, tissue): proteins to genes, without the root of the tissues."""
    return _pairs(P.mapped(raw.filter(F.col("tissue") != root), "protein", proteins, "gene"), "gene", "tissue", F.lit("GEN-ass-TIS").alias("relation"))


def associations(raw: DataFrame, always: float = 0.7, least: float = 0.3, upto: int = 100) -> DataFrame:
    """(diseaseId, targetId, associationScore): of each disease all strong genes, filled up with the best of the others."""
    best = raw.select(X.curie(F.col("diseaseId")).alias("n2"), F.col("targetId").alias("n1"), F.col("associationScore").alias("score")).filter(F.col("score") >= least).dropna().groupBy("n1", "n2").agg(F.max("score").alias("score"))
    return T.top_with_override(best, "n2", "n1", "score", always, least, upto).select("n1", "n2", "score", F.lit("GEN-ass-DIS").alias("relation"))


def pathways(raw: DataFrame, proteins: DataFrame, prefix: str = "R-HSA-") -> DataFrame:
    """(protein, pathway) of humans, 1:N."""
    return _pairs(P.mapped(raw.filter(F.col("pathway").startswith(prefix)), "protein", P.one_to_many(proteins), "gene"), "gene", "pathway", F.lit("GEN-ass-PWY").alias("relation"))


def drug_targets(raw: DataFrame, aliases: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """(pert_iname, target): lists of symbols by the alias mapping, without outliers of degree on either side."""
    each = raw.select("pert_iname", F.explode(X.list_items(F.col("target"))).alias("symbol"))
    named = _pairs(P.mapped(each, "symbol", aliases, "gene"), "pert_iname", "gene")
    return T.without_outliers(named, cutoff).withColumn("relation", F.lit("CPD-int-GEN"))


def protein_links(raw: DataFrame, proteins: DataFrame, least: int = 700) -> DataFrame:
    """(protein1, protein2, score): pairs of at least that score, in byte order, with the smallest score over 1000."""
    strong = raw.filter(F.col("score") >= least).select(X.last_token(F.col("protein1")).alias("p"), X.last_token(F.col("protein2")).alias("q"), "score")
    named = P.mapped(P.mapped(strong, "p", proteins, "a"), "q", proteins, "b").filter("a <> b")
    return named.groupBy(F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2")).agg(F.round(F.min("score") / 1000, 3).alias("score")).withColumn("relation", F.lit("GEN-ppi-GEN"))


def best_evidence(genes: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """(gene, disease, evidence, n): each gene-disease row with the disease's strongest evidence code, IEA without one."""
    per = phenotypes.groupBy("disease").agg(F.max(F.struct(X.evidence_rank(F.col("evidence")).alias("r"), "evidence")).alias("b"), F.count("*").alias("n"))
    return genes.join(per, "disease", "left").select("gene", "disease", F.coalesce("b.evidence", F.lit("IEA")).alias("evidence"), F.coalesce("n", F.lit(0)).alias("n"))


def recipe_stats(pairs: DataFrame) -> DataFrame:
    """By relation: pairs and distinct ends."""
    return pairs.groupBy("relation").agg(F.count("*").alias("total"), F.countDistinct("n1").alias("n_n1"), F.countDistinct("n2").alias("n_n2"))


def funnel(original: DataFrame, homogenised: DataFrame, filtered: DataFrame) -> DataFrame:
    """(stage, n_rows, n_pairs, n_n1, n_n2) of a source from its raw pairs to the kept ones."""
    one = lambda d, s: d.agg(F.count("*").alias("n_rows"), F.countDistinct("n1", "n2").alias("n_pairs"), F.countDistinct("n1").alias("n_n1"), F.countDistinct("n2").alias("n_n2")).withColumn("stage", F.lit(s))
    return union_all([one(original, "original"), one(homogenised, "homogenised"), one(filtered, "filtered")])
