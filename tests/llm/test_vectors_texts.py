import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import corpus_encoding as E
from edgeloom.llm import languages as G
from edgeloom.llm import leakage as K
from edgeloom.llm import similar_vectors as V

CATALOG = "vec_id bigint, node_id string, node_type string, embedding_source string, training_condition string, seed int, dimension int, embedding array<float>, grp int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, f"n{i}", t, "src", "c", 1, 64, v, 0) for i, t, v in rows], CATALOG)


def brute(rows, least):
    out = set()
    for t in {t for _, t, _ in rows}:
        ids = np.array([i for i, u, _ in rows if u == t])
        x = np.array([v for _, u, v in rows if u == t], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -9)
        for i in range(len(ids)):
            for j in np.lexsort((ids, -np.round(s[i], 9)))[:10]:
                if s[i, j] >= least:
                    out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clustered(n, seed, centres=12, spread=0.35):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 64))
    return [((c[i % centres] + spread * rng.normal(size=64)) * rng.uniform(0.5, 3)).tolist() for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = [(i, "GEN" if i % 4 else "DIS", v) for i, v in enumerate(clustered(2400, 4))]
    got = {tuple(r) for r in V.similar_pairs(vectors(spark, rows)).collect()}
    want = brute(rows, 0.8)
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_unfit_vectors_take_no_part(spark):
    good = clustered(3, 1, centres=1, spread=0.01)
    rows = [(1, "GEN", good[0]), (2, "GEN", good[1]), (3, "DIS", good[2]), (4, None, good[0]), (5, "DESCONOCIDO", good[0]), (6, "GEN", None), (7, "GEN", good[0][:48]), (8, "GEN", [0.0] * 64), (9, "GEN", [float("nan")] + good[0][1:]), (10, "GEN", [float("inf")] + good[0][1:]), (11, "GEN", [None] + good[0][1:])]
    assert {tuple(r) for r in V.similar_pairs(vectors(spark, rows)).collect()} == {(1, 2)}
    assert V.similar_pairs(vectors(spark, rows).limit(0)).count() == 0


def test_many_copies_of_one_vector(spark):
    v = clustered(40, 2)
    rows = [(i, "GEN", v[0]) for i in range(30)] + [(100 + i, "GEN", x) for i, x in enumerate(v[1:])]
    near = V.neighbours(V.comparable(vectors(spark, rows)))
    by = {}
    for r in near.collect():
        by.setdefault(r.vec_id, []).append(r.near_id)
    assert all(len(set(n)) == 10 and i not in n for i, n in by.items()) and len(by) == 69
    assert sorted(by[29]) == list(range(10)) and sorted(by[0]) == list(range(1, 11))


@pytest.mark.parametrize(("n", "sizes"), [(600, {}), (3000, {"CELL": 200}), (3000, {"CELL": 200, "PART": 150, "TURN": 200, "BLOCK": 500}), (9000, {"CELL": 900, "PART": 1000})])
def test_recall_with_cells_parts_turns_and_blocks(spark, monkeypatch, n, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(V, name, value)
    rows = [(i, "GEN", v) for i, v in enumerate(clustered(n, 8, centres=30))] + [(n + i, "DIS", v) for i, v in enumerate(clustered(40, 9))]
    df = V.comparable(vectors(spark, rows))
    if sizes:
        reps = df.select("grp", F.col("vec_id").alias("rep"), "embedding")
        counted = reps.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1000").withColumn("cells", F.lit(V.cells_of(n)))
        grid = V._celled(reps.join(counted.select("grp"), "grp"), counted)
        # Each vector meets as a query all items of its own cell, once.
        own = grid.filter("item").select("grp", "cell", "part", "turn", "rep")
        met = grid.filter("query").select("grp", "cell", "part", "turn", F.col("rep").alias("asked")).join(own, ["grp", "cell", "part", "turn"]).groupBy("asked", "rep").count()
        cells = own.select("cell", "rep").distinct()
        assert cells.count() == n and met.filter("count > 1").isEmpty() and met.filter("asked = rep").count() == n
        home = cells.alias("a").join(cells.alias("b"), "cell")
        assert home.join(met.select(F.col("asked"), F.col("rep").alias("seen")), (F.col("a.rep") == F.col("asked")) & (F.col("b.rep") == F.col("seen")), "left_anti").isEmpty()
        assert grid.select("cell", "part", "turn").distinct().count() > cells.select("cell").distinct().count() or "TURN" not in sizes
    got = {tuple(r) for r in V.similar_pairs(vectors(spark, rows)).collect()}
    want = brute(rows, 0.8)
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_repeated_ids_and_copies_near_others(spark):
    v = clustered(60, 5, centres=1, spread=0.1)
    rows = [(i, "GEN", x) for i, x in enumerate(v)] + [(3, "GEN", v[3]), (70, "GEN", v[5]), (71, "GEN", v[5]), (72, "GEN", [2 * a for a in v[6]])]
    near = V.neighbours(V.comparable(vectors(spark, rows))).collect()
    by = {}
    for r in near:
        by.setdefault(r.vec_id, []).append((-round(r.cosine, 6), r.near_id))
    assert set(by) == {*range(60), 70, 71, 72} and all(len(n) == len(set(n)) == 10 and all(i != j for _, j in n) for i, n in by.items())
    assert {j for _, j in sorted(by[70])[:2]} == {5, 71} and sorted(by[6])[0][1] == 72


def test_anisotropic_codes_keep_the_score_along_the_vector():
    x = np.array(clustered(800, 3), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = V.Index(x)
    home = (x @ index.centres.T).argmax(1)
    r = x - index.centres[home]
    plain = np.stack([((r.reshape(-1, V.SUBSPACES, V.SUB)[:, m, None] - index.books[m][None]) ** 2).sum(2).argmin(1) for m in range(V.SUBSPACES)], 1)
    decoded = lambda codes: index.books[np.arange(V.SUBSPACES), codes].reshape(len(x), -1)
    error = lambda codes: np.abs(((r - decoded(codes)) * x).sum(1)).mean()
    codes = V.encode(x, r, index.books)
    assert error(codes) < 0.7 * error(plain)
    places, approx = index.scan(x[:5], np.array([2, 5]))
    own = index.order[places]
    assert set(home[own]) == {2, 5} and len(own) == (np.isin(home, [2, 5])).sum()
    assert np.allclose(approx, (index.centres[home] + decoded(codes))[own] @ x[:5].T, atol=1e-4)


ODD = ["", "a", " ", "  a  b ", "x\n\n y\r\n\tz", "don't I'll we've", "<|endoftext|> is text", "é naïve   café　x", "a​b c", "1234567890 " * 30, "\U0001f600 \U0001f468‍\U0001f469", "word" * 5000, "a b " * 9000, " leading", "trailing ", "tab\there", "İstanbul 中文 русский text", "ends with space ", "!? ... -- \"q\""]


RANKS = Path(E.ranks_path()).read_bytes()


def encoded(encoder, texts):
    flat, at = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_encoding_is_exact():
    direct, encoder = E.load(RANKS), E.Encoder(RANKS)
    rng = random.Random(7)
    pool = ["the", "gene", "it's", "été", "4.5", " ", "\n", "\u3000", "-", "don't", "中", "ENSG00000650001;", "\t", "''", "\u200b"]
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["".join(rng.choice(pool) for _ in range(30)) for _ in range(200)]
    for _ in range(2):  # the second time from memory
        assert encoded(encoder, texts) == [direct.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("rate", [0.9, 0.3, 0.05])
def test_joins_agree_wherever_texts_are_cut(monkeypatch, rate):
    monkeypatch.setattr(E, "CUT_RATE", rate)
    direct, encoder, rng = E.load(RANKS), E.Encoder(RANKS), random.Random(3)
    signs = [*"ab'sStdlmrev  \n\t.,-!?12é中文字ñ\u0301\u0967\u2160\u00a0\u3000\u200b_", "'ll", "'re", "ENSG", "\U0001f600", "\U00020bb7", "don't", "\x1c", "\x85", "\ue000", "\u0378"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    assert encoded(encoder, texts) == [direct.encode_ordinary(t) for t in texts]


def test_scripts_without_spaces_are_reused():
    one, two = "".join(chr(0x4E00 + 37 * i % 5000) + ("。" if i % 9 == 8 else "") for i in range(3000)), "русский текст, повторенный дословно; " * 60
    encoder = E.Encoder(RANKS)
    first = encoded(encoder, [one, two])
    encoded_first = encoder.encoded
    assert encoded(encoder, ["начало " + one, two]) == [encoder.encoding.encode_ordinary(t) for t in ("начало " + one, two)] and first[0]
    assert encoder.encoded - encoded_first <= 3 < encoded_first


def test_encoded_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(99, None, "x"), (0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in E.encode_corpus(df, "doc_id", "text").collect())
    direct = E.load(RANKS)
    assert got == sorted((i, direct.encode_ordinary(t or "")) for i, t, _ in rows)
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_shared_pieces_are_frequent_and_right(spark):
    df = spark.createDataFrame([("the same opening words of every note stand here now, and these go on for some time, as notes do",)] * 50 + [(None,)], "text string")
    shared = E.shared_pieces(df, "text", RANKS)
    direct = E.load(RANKS)
    assert shared and all(ids.tolist() == direct.encode_ordinary(c) for c, ids in shared.items())


def test_cuts_depend_on_the_text_alone():
    t = " ".join(f"passage {i} that {i * i} documents share, word {i % 7} for word," for i in range(30))
    alone = E.Pieces([t]).parts
    assert len(alone) > 3 and E.Pieces(["other text ", t, "", "x"]).parts[-1 - len(alone) : -1] == alone


def test_edit_distance_against_tables():
    rng = random.Random(1)

    def table(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            last, row = row, [i] + [0] * len(t)
            for j, b in enumerate(t, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
        return min(row)

    for _ in range(300):
        p = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        t = [rng.randint(0, 3) for _ in range(rng.randint(0, 20))]
        assert K.myers(p, t) == table(p, t)


def test_leaks(spark):
    item = "Given that drug ABC slows gene X1 in both replicates, name the step at which it acts on the route"
    w = K.words(item)
    docs = [
        (1, "Before. " + item.upper().replace(" ", "  ") + " after"), (2, " ".join(w[:12])), (3, " ".join(w[:11])), (4, " ".join(w[3:9] + ["other"] + w[10:20])), (5, None), (6, ""), (7, " ".join(w[5:17]) + " x"),
        (8, " ".join(w[:6] + ["zz"] + w[6:])), (9, "x " * 50_000 + " ".join(w[-12:])), (9, "none"), (10, "drug ABC slows gene"),
    ]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(70, item, "x"), (71, "too short", "x"), (72, None, "x"), (None, item, "x")], "item_id bigint, text string, doc_id string")
    got = {r.doc_id: (r.item_id, r.run, r.errors) for r in K.leaks(d, "doc_id", "text", items, "item_id", "text").collect()}
    assert {i for i, (_, run, _) in got.items() if run >= 12} == {1, 2, 7, 8, 9}
    assert got[4][2] == 1 and got[3] == (70, 11, 1) and got[8][1] == len(w) - 6 and 10 not in got
    assert K.leaks(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert K.leaks(d.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


@pytest.fixture(scope="module")
def samples(spark, small):
    rows = spark.read.parquet(f"{small}/lang_samples.parquet").orderBy("sample_id").collect()
    return [(r.lang, r.text) for r in rows]


def test_held_out_accuracy(samples):
    model = G.fit(sorted(samples[::2]))
    told = G.Classifier(model).classify([G.language_words(t) for _, t in samples[1::2]])
    assert sum(a == lang for (a, _), (lang, _) in zip(told, samples[1::2])) >= 0.98 * len(told)
    assert all(0 < c <= 1 for _, c in told)


def test_segments_and_labels():
    assert G.segments("a\nb\n \t\n\r\n\nc\n") == ["a\nb", "c"] and G.segments(" \n\t") == []
    assert [G.label_code(x) for x in ("EN", "pt-BR", "Spanish", " deu ", "ca", "??", "", None)] == ["en", "pt", "es", "de", None, None, None, None]


def test_documents(spark, samples):
    by = {}
    for lang, text in samples:
        by.setdefault(lang, text)
    ids = "ENSG00000861400; ENSG00000767762\n[94] ENSG00000826791 ≤ 5.6e-05 µM"
    docs = [(1, by["en"], "en"), (2, by["en"], "fr"), (3, f"{by['es']}\n\n{ids}\n \n{by['de']}", "es"), (4, ids, None), (5, None, "en"), (6, "", None), (7, by["pt"].upper(), "??"), (8, by["it"], "Italian"), (9, "\n\n" + by["fr"] * 2000, None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, segment int")
    model = G.fitted(spark.createDataFrame(samples + [(None, "x"), ("en", None)], "lang string, text string"), "lang", "text")
    rows = G.language_segments(df, "doc_id", "text", "lang", model).collect()
    assert {(r.doc_id, r.segment, r.lang) for r in rows if r.is_case} == {(2, 1, "en"), (3, 1, "es"), (3, 3, "de"), (7, 1, "pt"), (9, 1, "fr")}
    assert {r.doc_id for r in rows if not r.is_case} == {1, 8}
    assert G.language_segments(df.limit(0), "doc_id", "text", "lang", model).count() == 0


@pytest.mark.parametrize("name", ["p1_splits", "p1_shares", "p6_found", "p6_neighbours", "p8_ids", "p9_items", "p10_found", "p10_documents"])
def test_queries_run(name, spark, small):
    from edgeloom.llm.queries import QUERIES

    assert QUERIES[name](spark, small).count() > 0
