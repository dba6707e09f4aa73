"""Distances, parsing and signatures on the word-vector fixture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import vectors as V

# Fixed fixture: six word vectors and the probe "fruit".
FRUIT = [-5.1, 2.9, 0.8, 7.9, 3.1]
WORDS = {
    "apple": [-5.2, 3.1, 0.2, 8.1, 3.5],
    "strawberry": [-4.9, 3.6, 0.9, 7.8, 3.6],
    "cat": [1.5, -0.4, 7.2, 19.6, 20.2],
    "dog": [1.7, -0.3, 6.9, 19.1, 21.1],
    "car": [81.6, -72.1, 16, -20.2, 102],
    "building": [60.1, -60.3, 10, -12.3, 9.2],
}
EXPECTED = {  # cosine, l2, negative inner product
    "apple": (0.002185, 0.7810, -110.51), "strawberry": (0.003448, 0.8944, -108.93),
    "cat": (0.287819, 22.9065, -214.41), "dog": (0.300719, 23.3051, -212.28),
    "car": (1.290934, 154.7377, 455.83), "building": (1.601477, 93.6759, 542.03),
}


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, w, [float(x) for x in v]) for i, (w, v) in enumerate(WORDS.items())]
    return spark.createDataFrame(rows, "id long, text string, embedding array<float>")


def test_word_distances(words):
    out = words.select("text", V.distance_to("cosine", "embedding", FRUIT).alias("c"),
                       V.distance_to("l2", "embedding", FRUIT).alias("l"),
                       V.distance_to("ip", "embedding", FRUIT).alias("i")).collect()
    for r in out:
        c, l2, ip = EXPECTED[r.text]
        assert r.c == pytest.approx(c, abs=1e-5)
        assert r.l == pytest.approx(l2, abs=1e-3)
        assert r.i == pytest.approx(ip, abs=1e-2)


def test_column_and_literal_forms_agree(words):
    q = F.array(*[F.lit(x) for x in FRUIT])
    out = words.select(V.cosine_distance("embedding", q).alias("a"),
                       V.distance_to("cosine", "embedding", FRUIT).alias("b"),
                       V.l2_distance("embedding", q).alias("c"),
                       V.distance_to("l2", "embedding", FRUIT).alias("d")).collect()
    for r in out:
        assert r.a == pytest.approx(r.b, abs=1e-12)
        assert r.c == pytest.approx(r.d, abs=1e-12)


def test_rankings(words):
    from mnemospark.operators.search import exact_top_k
    cos = [r.text for r in exact_top_k(words, FRUIT, 2, "cosine", id_col="id", columns=["text"]).collect()]
    ip = [r.text for r in exact_top_k(words, FRUIT, 2, "ip", id_col="id", columns=["text"]).collect()]
    assert cos == ["apple", "strawberry"]
    assert ip == ["cat", "dog"]


def test_wrong_length_and_zero_give_null(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0, 0.0],)], "embedding array<float>")
    out = df.select(V.distance_to("cosine", "embedding", [1.0, 1.0, 1.0]).alias("d")).collect()
    assert [r.d for r in out] == [None, None]
    with pytest.raises(ValueError):
        V.distance_to("cosine", "embedding", [0.0, 0.0])


def test_parse_vector_fixture(spark):
    df = spark.createDataFrame([("[1.5, -0.4,2e-3]",), ("[]",), (None,), ("[1, x, 3]",)], "t string")
    out = df.select(V.parse_vector("t").alias("v"), V.vector_is_valid("t").alias("ok")).collect()
    assert out[0].v == pytest.approx([1.5, -0.4, 0.002])
    assert out[1].v == []
    assert out[2].v is None
    assert out[3].v[0] == 1.0 and out[3].v[1] is None and out[3].v[2] == 3.0
    assert [r.ok for r in out] == [True, True, False, False]


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    out = df.select(V.l2_normalize("embedding").alias("u")).collect()
    assert out[0].u == pytest.approx([0.6, 0.8])
    assert out[1].u is None


def test_sign_words_and_hamming(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(20, 130)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, e array<float>")
    q = vecs[0].tolist()
    out = df.select("id", V.hamming_to(V.sign_words_expr("e"), V.sign_words_of(q)).alias("h")).collect()
    for r in out:
        assert r.h == int(np.sum((vecs[r.id] > 0) != (vecs[0] > 0)))


def test_sql_functions(spark):
    V.register_sql_functions(spark)
    r = spark.sql("select cosine_distance(array(cast(1 as float), cast(0 as float)), "
                  "array(cast(0 as float), cast(1 as float))) as c, "
                  "l2_distance(array(cast(3 as float)), array(cast(0 as float))) as l").first()
    assert r.c == pytest.approx(1.0)
    assert r.l == pytest.approx(3.0)
    assert math.isclose(spark.sql("select neg_inner_product(array(cast(2 as float)), array(cast(3 as float)))")
                        .first()[0], -6.0)


def test_score_matrix_shape(spark):
    """2 queries x 2 documents of unit vectors, score = 100 x dot."""
    from mnemospark.operators.search import score_pairs
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "query_id long, query_vec array<float>")
    d = spark.createDataFrame([(10, [0.0, 1.0]), (11, [0.8, 0.6])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id): r.s for r in
           score_pairs(d, q, "ip").join(d, "vec_id").join(q, "query_id")
           .select("query_id", "vec_id", V.similarity_score("embedding", "query_vec").alias("s")).collect()}
    want = {(0, 10): 0.0, (0, 11): 80.0, (1, 10): 80.0, (1, 11): 96.0}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items())
