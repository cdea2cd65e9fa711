import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.sources import readers as R
from edgeloom.sources import recipes as C
from edgeloom.sources import sinks as K


def write(path, text):
    path.write_text(text)
    return str(path)


def test_delimited_gzip_comments_and_projection(spark, tmp_path):
    p = tmp_path / "x.tsv.gz"
    with gzip.open(p, "wt") as f:
        f.write("# made by\na\tb\tc\n1\tx\t0.5\n2\t\tbad\n")
    df = R.delimited(spark, str(p), "a int, b string, c double", comment="#", columns=["a", "c"])
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 0.5), (2, None)]
    R.check_gzip(spark, str(p))
    with pytest.raises(R.NotGzip):
        R.check_gzip(spark, write(tmp_path / "page.gz", "<html>"))
    assert R.optional(spark, str(tmp_path / "absent.tsv"), "a int").count() == 0


def test_guarded_rows(spark, tmp_path):
    rows, counts = R.guarded(spark, write(tmp_path / "g.tsv", "#c\nhead\nother head\na\tb\na\tb\tc\n\nd\t\n"), ["x", "y"], skip=3)
    assert sorted(map(tuple, rows.collect())) == [("a", "b"), ("d", "")]
    assert tuple(counts.first()) == (3, 1)


def test_odd_formats(spark, tmp_path):
    assert [tuple(r) for r in R.whitespace(spark, write(tmp_path / "w.txt", " a   b\tc\nd\n\n"), ["x", "y"]).orderBy("x").collect()] == [("a", "b"), ("d", None)]
    s = R.last_column_scores(spark, write(tmp_path / "s.txt", "p q n score\n9606.P1 9606.P2 7 800\n9606.P1 9606.P3 7 x\n"))
    assert [tuple(r) for r in s.collect()] == [("9606.P1", "9606.P2", 800)]
    d = tmp_path / "keys"
    d.mkdir()
    write(d / "101", "5\t1.5\n")
    write(d / "102", "6\tNaN\n")
    k = R.keyed_directory(spark, str(d), "target string, rank double")
    assert sorted((r.key, r.target) for r in k.collect()) == [("101", "5"), ("102", "6")]
    good, bad = R.json_lines(spark, write(tmp_path / "j.json", '{"targetId": "T", "score": 0.5}\n{oops\n'), "targetId string, score double")
    assert [tuple(r) for r in good.collect()] == [("T", 0.5)] and bad.first().n_bad == 1


def test_xml(spark, tmp_path):
    gene = "<DisorderGeneAssociation><Gene><ExternalReferenceList>{}</ExternalReferenceList></Gene><DisorderGeneAssociationType><Name>Role</Name></DisorderGeneAssociationType></DisorderGeneAssociation>"
    ref = "<ExternalReference><Source>{}</Source><Reference>{}</Reference></ExternalReference>"
    text = f"<JDBOR><DisorderList><Disorder id='1'><OrphaCode>58</OrphaCode><Name>N</Name><DisorderGeneAssociationList>{gene.format(ref.format('Ensembl', 'ENSG1') + ref.format('HGNC', '9'))}{gene.format(ref.format('HGNC', '8'))}</DisorderGeneAssociationList></Disorder></DisorderList></JDBOR>"
    assert [tuple(r) for r in R.disorders(spark, write(tmp_path / "o.xml", text)).collect()] == [("ORPHA:58", "N", "ENSG1", "Role")]


def test_vectors(spark, tmp_path):
    v = R.word_vectors(spark, write(tmp_path / "v.emb", "2 2\nold name 1 2\nb 3 4\n"))
    assert {r.node: list(r.vec) for r in v.collect()} == {"old name": [1.0, 2.0], "b": [3.0, 4.0]}
    with pytest.raises(ValueError):
        R.word_vectors(spark, write(tmp_path / "w.emb", "3 2\nb 3 4\n"))
    np.savez(tmp_path / "z.npz", node_ids=np.array(["a"]), embeddings=np.array([[1.0, 2.0]]))
    n = R.npz_vectors(spark, str(tmp_path / "z.npz"))
    assert K.wide_vectors(n, 2, "node").first().asDict() == {"node": "a", "e_0001": 1.0, "e_0002": 2.0}


def test_wide_matrix_and_results(spark, tmp_path):
    m = R.wide_matrix(spark, write(tmp_path / "m.csv", "ModelID,meta,A (1),B (2)\nm1,x,1,\nm2,y,0,oops\n"), "ModelID", ["meta"])
    assert sorted((r.sample, r.gene, r.value) for r in m.dropna().collect()) == [("m1", "A (1)", 1.0), ("m2", "A (1)", 0.0)]
    write(tmp_path / "a__r.tsv", "x\ty\n1\t2\n")
    write(tmp_path / "b__r.tsv", "x\ty\n3\t4\n")
    assert R.result_files(spark, str(tmp_path / "*__r.tsv"), "x int, y int").count() == 2
    assert R.result_files(spark, str(tmp_path / "none*"), "x int").count() == 0
    assert R.first_column_like(m, "GEN", "val") == "gene"


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("b", "c", "r"), ("a", "c", "s")], "node1 string, node2 string, relation string")
    K.edges_parquet(e, str(tmp_path / "e"))
    assert R.parquet_tree(spark, str(tmp_path / "e"), ["node1"]).count() == 2
    K.sorted_tsv(e, str(tmp_path / "t"), "node1")
    assert R.delimited(spark, str(tmp_path / "t"), "node1 string, node2 string, relation string").count() == 2
    K.append_results(e, str(tmp_path / "r"), "relation")
    K.append_results(e, str(tmp_path / "r"), "relation")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    K.manifest({"n": 1, "rows": e}, str(tmp_path / "m.json"))
    assert len(json.loads((tmp_path / "m.json").read_text())["rows"]) == 2
    K.check_report(spark.createDataFrame([("a", 0, True), ("b", 2, False)], "check string, n int, ok boolean"), str(tmp_path / "c.txt"))
    assert (tmp_path / "c.txt").read_text() == "OK\ta\t0\nFAIL\tb\t2\n"
    K.html_table(e, str(tmp_path / "h.html"), "Edges")
    assert "<table" in (tmp_path / "h.html").read_text()


def m(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def got(df):
    return sorted(tuple(r) for r in df.select("n1", "n2", "relation").collect())


def test_cell_line_recipes(spark):
    genes, lines = m(spark, ("TP53", "E1"), ("KRAS", "E2")), m(spark, ("L1", "CVCL_1"))
    raw = spark.createDataFrame([("TP53", "L1", "1.0"), ("TP53", "L1", "1.0"), ("KRAS", "L1", "-1.0"), ("KRAS", "L1", "x"), ("KRAS", "L9", "1.0"), (None, "L1", "1.0"), ("TP53", "L1", "0.5")], "source string, target string, weight string")
    assert got(C.signed_profiles(raw, genes, lines, "CLL-cnu-GEN", "CLL-cnd-GEN")) == [("CVCL_1", "E1", "CLL-cnu-GEN"), ("CVCL_1", "E2", "CLL-cnd-GEN")]
    mat = spark.createDataFrame([("L1", "TP53 (7157)", 1.0), ("L1", "KRAS (3845)", 0.0)], "sample string, gene string, value double")
    assert got(C.mutations([mat, mat], genes, lines)) == [("CVCL_1", "E1", "CLL-mut-GEN")]
    assert {r[2] for r in got(C.expression(mat, genes, lines, 1))} <= {"CLL-upr-GEN", "CLL-dwr-GEN"}
    levels = spark.createDataFrame([(t, g, v) for g in "ab" for t, v in (("t1", 1.0), ("t2", 5.0), ("t3", 9.0))], "sample string, gene string, value double")
    assert ("a", "t3", "GEN-upr-TIS") in got(C.tissue_expression(levels, 1))


def test_chemical_recipes(spark):
    raw = spark.createDataFrame([("D1", "7", "9606", "increases^expression|affects^binding|odd"), ("D1", "7", "10090", "increases^expression"), ("D2", None, "9606", "decreases^expression")], "ChemicalID string, GeneID string, OrganismID string, InteractionActions string")
    rules = spark.createDataFrame([("expression", "increases", "upe"), ("expression", None, "exp")], "kind string, degree string, relation string")
    assert got(C.chemical_actions(raw, m(spark, ("7", "E7")), m(spark, ("D1", "KEY")), rules)) == [("KEY", "E7", "CPD-afe-GEN"), ("KEY", "E7", "CPD-upe-GEN")]
    dis = spark.createDataFrame([("D1", "MESH:D000001", "therapeutic"), ("D2", "OMIM:5", "marker/mechanism"), ("D2", "OMIM:6", None), ("D2", "SNOMED:6", "therapeutic")], "ChemicalID string, DiseaseID string, DirectEvidence string")
    assert got(C.chemical_diseases(dis, m(spark, ("D1", "KEY")))) == [("D2", "OMIM:5", "CPD-cau-DIS"), ("KEY", "MESH:D000001", "CPD-trt-DIS")]
    g = spark.createDataFrame([("7", "OMIM:5", "marker"), ("7", "OMIM:6", "")], "GeneID string, DiseaseID string, DirectEvidence string")
    assert got(C.gene_diseases(g, m(spark, ("7", "E7"), ("7", "E8")))) == [("E7", "OMIM:5", "GEN-ass-DIS"), ("E8", "OMIM:5", "GEN-ass-DIS")]
    drugs = spark.createDataFrame([("drug", "TP53| KRAS|"), ("none", None)], "pert_iname string, target string")
    assert got(C.drug_targets(drugs, m(spark, ("TP53", "E1"), ("KRAS", "E2")))) == [("drug", "E1", "CPD-int-GEN"), ("drug", "E2", "CPD-int-GEN")]


def test_protein_recipes(spark):
    prot = m(spark, ("P1", "E1"), ("P2", "E2"), ("P2", "E3"))
    rev = spark.createDataFrame([("P1",), ("P2",)], "protein string")
    cols = "source string, target string, ncbi_tax_id_source string, ncbi_tax_id_target string, omnipath boolean, dorothea boolean, dorothea_level string, consensus_stimulation boolean, consensus_inhibition boolean"
    raw = spark.createDataFrame([("P1", "P2", "9606", "9606", True, True, "A;D", True, False), ("P1", "P9", "9606", "9606", True, True, "A", True, None), ("P2", "P1", "9606", "10090", True, True, "B", True, True), ("P1", "P2", "9606", "9606", None, None, None, None, None)], cols)
    assert {r for r in got(C.regulation(raw, rev, prot, "AB"))} == {("E1", e, r) for e in ("E2", "E3") for r in ("GEN-reg-GEN", "GEN-upr-GEN")}
    enz = spark.createDataFrame([("P1", "P2", "phosphorylation", "9606"), ("P1", "P2", "acetylation", "9606")], "enzyme string, substrate string, modification string, ncbi_tax_id string")
    assert {r[2] for r in got(C.interactions(raw, enz, rev, prot))} == {"GEN-ppi-GEN", "GEN-pho-GEN"}
    links = spark.createDataFrame([("9606.P1", "9606.P2", 900), ("9606.P2", "9606.P1", 800), ("9606.P1", "9606.P2", 100)], "protein1 string, protein2 string, score int")
    assert sorted((r.n1, r.n2, r.score) for r in C.protein_links(links, prot).collect()) == [("E1", "E2", 0.8), ("E1", "E3", 0.8)]
    assert got(C.pathways(spark.createDataFrame([("P1", "R-HSA-1"), ("P1", "R-MMU-1")], "protein string, pathway string"), prot)) == [("E1", "R-HSA-1", "GEN-ass-PWY")]
    assert got(C.tissues(spark.createDataFrame([("P1", "BTO:0"), ("P1", "BTO:5")], "protein string, tissue string"), prot, "BTO:0")) == [("E1", "BTO:5", "GEN-ass-TIS")]


def test_disease_recipes(spark):
    p = spark.createDataFrame([("g", "t", "High", "Approved"), ("g", "u", "High", None), ("g", "u", "Low", "Approved"), ("h", "t", "Low", "Uncertain"), ("i", "t", "Low", "Enhanced")], "Gene string, Tissue string, Level string, Reliability string")
    assert got(C.proteome(p)) == [("g", "t", "GEN-pab-TIS"), ("i", "t", "GEN-pdf-TIS")]
    a = spark.createDataFrame([("Orphanet_1", "E1", 0.9), ("Orphanet_1", "E1", 0.5), ("Orphanet_1", "E2", 0.8), ("Orphanet_1", "E3", 0.5), ("Orphanet_1", "E4", 0.1)], "diseaseId string, targetId string, associationScore double")
    assert got(C.associations(a, upto=2)) == [("E1", "ORPHA:1", "GEN-ass-DIS"), ("E2", "ORPHA:1", "GEN-ass-DIS")]
    ranks = spark.createDataFrame([("1", "2", 4.0), ("2", "1", 9.0), ("1", "3", float("nan")), ("1", "2", -1.0)], "key string, target string, rank double")
    reliable = spark.createDataFrame([(str(i),) for i in range(1, 100)], "gene string")
    out = C.coexpression(ranks.filter("rank > 0 OR isnan(rank)"), m(spark, ("1", "E1"), ("2", "E2")), reliable)
    assert [(r.n1, r.n2, r.mutual_rank) for r in out.collect()] == [("E1", "E2", 6)]
    g = spark.createDataFrame([("E1", "d"), ("E2", "x")], "gene string, disease string")
    ev = spark.createDataFrame([("d", "IEA"), ("d", "PCS")], "disease string, evidence string")
    assert sorted(map(tuple, C.best_evidence(g, ev).collect())) == [("E1", "d", "PCS", 2), ("E2", "x", "IEA", 0)]
    pairs = C.proteome(p)
    assert C.recipe_stats(pairs).count() == 2 and C.funnel(pairs, pairs, pairs).count() == 3
    empty = p.limit(0)
    assert C.proteome(empty).count() == 0 and C.associations(a.limit(0)).count() == 0


def test_only_the_first_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("id\tx\nA\t1\nid\tx\nB\t2\n")
    rows, counts = R.guarded(spark, str(path), ["id", "x"], skip=1)
    assert sorted(map(tuple, rows.collect())) == [("A", "1"), ("B", "2"), ("id", "x")] and counts.first().n_lines == 3
    assert R.lines_after(spark, str(path), 0).count() == 4 and R.lines_after(spark, str(path), 9).count() == 0
    big = tmp_path / "big.txt"
    big.write_text("".join(f"line {i}\n" for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        left = R.lines_after(spark, str(big), 3)
        assert left.rdd.getNumPartitions() > 4 and left.count() == 199_997 and left.filter("value IN ('line 0', 'line 1', 'line 2')").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_exports_leave_nothing_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "EXPORT_ROWS", 3)
    K.manifest({"t": spark.range(3)}, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        K.manifest({"t": spark.range(4)}, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        K.check_report(spark.range(4).selectExpr("concat('c', id) AS check", "id AS n", "true AS ok"), str(tmp_path / "r.txt"))


def test_vectors_as_an_archive_and_runs_that_go_on(spark, tmp_path):
    v = spark.createDataFrame([("b", [3.0, 4.0]), ("a", [1.0, 2.0])], "node string, vec array<double>")
    K.npz_vectors(v, str(tmp_path / "v.npz"))
    assert [(r.node, r.vec) for r in R.npz_vectors(spark, str(tmp_path / "v.npz")).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    units = spark.createDataFrame([("t1", 0), ("t1", 1), ("t2", 0)], "task string, fold int")
    path = str(tmp_path / "results")
    assert K.remaining(units, path, "task", "fold").count() == 3
    K.append_results(units.limit(2).withColumn("x", F.lit(1.0)), path, "task", "fold")
    assert K.remaining(units, path, "task", "fold").count() == 1
