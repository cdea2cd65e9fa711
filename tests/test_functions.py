import duckdb
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import scalars as X
from edgeloom.functions import text as T
from edgeloom.functions.hashing import draw


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_gene_spellings(spark):
    same = ["ENSG00000744505", "ensg744505.8", "ENSG00000​744505", "9606.ENSG00000744505", '"ENSG-00000744505"', "ensembl:ENSG 00000 744505", "\tENSG000000000744505\n", "hsapiens/Ensg_00000744505.12"]
    assert set(one(spark, T.ensg, same)) == {"ENSG00000744505"}
    assert one(spark, T.ensg, [None, "", "  ", "TP53", "744505"]) == [None] * 5


def test_keys_and_blanks(spark):
    assert one(spark, T.alnum_key, ["A-b_C 1", "  ", None, "Ä­ß"]) == ["abc1", "", None, "äß"]
    assert one(spark, T.given, ["x", "", "  \t", None]) == [True, False, False, False]
    assert one(spark, T.real_value, [" P1 ", "None", "NAN", "n/a", "-", "", None]) == ["P1", None, None, None, None, None, None]
    assert one(spark, T.folded, ["  R1 ", None]) == ["r1", None]


def test_disease_ids(spark):
    given = ["MESH:D054198", "Orphanet_166", "SNOMED:1", "", "C0000001", "D012345", None, "EFO_0000400", "OMIM:1 x", "other", "MONDO:7", "10012345", "x"]
    want = ["MESH:D054198", "ORPHA:166", None, None, "UMLS:C0000001", "MESH:D012345", None, "EFO:0000400", "OMIM:1", None, "MONDO:7", "MEDDRA:10012345", None]
    assert one(spark, X.disease_id, given) == want
    assert one(spark, X.curie, ["Orphanet_166", "DOID_0050890", "a_b_c"]) == ["ORPHA:166", "DOID:0050890", "a:b_c"]


def test_scalars(spark):
    assert one(spark, lambda c: X.list_items(c), ["a| b||c", "", None]) == [["a", "b", "c"], [], []]
    assert one(spark, X.list_length, ["a|b", None]) == [2, 0]
    assert [[tuple(p) for p in r] for r in one(spark, X.action_pieces, ["increases^expression|x|affects^binding"])] == [[("increases", "expression"), ("affects", "binding")]]
    assert one(spark, X.evidence_rank, ["IEA", "PCS", "zz", None]) == [1, 3, 0, 0]
    assert one(spark, X.tier, ["Disease-causing germline mutation(s) in", "Candidate gene tested in", "other"]) == [1, 4, 5]
    assert one(spark, lambda c: X.bucket(c, [0.0, 1.0, 2.0]), [0.0, 1.0, 2.0, 2.1, None], "double") == [0, 1, 1, None, None]
    assert one(spark, X.number_or_null, ["1.5", "x", "nan", None]) == [1.5, None, None, None]
    assert one(spark, X.grouped_number, [1234567, None], "bigint") == ["1,234,567", "~"]


def test_draws_agree_with_sql(spark):
    df = spark.range(50).select("id", draw(42, 1000, F.lit("a"), "id").alias("d")).orderBy("id")
    want = duckdb.sql("SELECT ('0x' || substr(md5(concat_ws('|', '42', 'a', CAST(id AS VARCHAR))), 1, 15))::BIGINT % 1000 FROM range(50) t(id) ORDER BY id").fetchall()
    assert [r.d for r in df.collect()] == [w[0] for w in want]


@pytest.mark.parametrize("value", ["ENSG99999999999999", "ENSG0"])
def test_long_and_zero_numbers(spark, value):
    assert one(spark, T.ensg, [value])[0].startswith("ENSG")


def test_pairs_as_integers_and_categories_in_order(spark):
    df = spark.createDataFrame([(0, 0), (3, 999_999), (999_999, 7)], "a bigint, b bigint").withColumn("k", X.pair_key(F.col("a"), F.col("b"), 1_000_000))
    a, b = X.pair_of(F.col("k"), 1_000_000)
    assert all((r.a, r.b) == (r.x, r.y) for r in df.select("a", "b", a.alias("x"), b.alias("y")).collect())
    t = spark.createDataFrame([("low",), ("high",), ("odd",), (None,)], "c string").select("c", X.category_order(F.col("c"), ["high", "low"]).alias("o"))
    assert {r.c: r.o for r in t.collect()} == {"high": 1, "low": 2, "odd": 3, None: 3}
