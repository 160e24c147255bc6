"""Sparse role vectors and words inside texts against plain versions."""

import random

from sentrace.operators import features as X
from sentrace.operators.substrings import words_inside


def test_sparse_equals_dense(spark):
    random.seed(1)
    rows = [(i, random.choice(["a", "b", "zz", "ä", None]), float(random.randrange(5)), None if i % 7 == 0 else i * 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id int, role string, x double, y double")
    dense = X.feature_vector(df, X.fit_features(df, ["x", "y"], optional=False, role_mode="roles"))
    model = X.fit_features(df, ["x", "y"], optional=False)
    sparse = X.sparse_vector(df, model, X.role_dictionary(df)).selectExpr("session_id", "role", f"{X.dense_vector('sparse')} AS features", "sparse")
    want = {r["session_id"]: r["features"] for r in dense.collect()}
    for r in sparse.collect():
        assert r["features"] == want[r["session_id"]]
        assert len(r["sparse"]["indices"]) <= 3 and 0.0 not in r["sparse"]["values"]
        assert r["role"] is not None or all(i < 2 for i in r["sparse"]["indices"])


def test_many_roles_without_a_list(spark):
    df = spark.range(1_000_000).selectExpr("id AS session_id", "concat('role ', id) AS role", "CAST(id % 9 AS DOUBLE) AS x")
    found = X.sparse_vector(df, X.fit_features(df, ["x"], optional=False), X.role_dictionary(df))
    got = found.selectExpr("count(DISTINCT element_at(sparse.indices, -1)) AS n", "max(element_at(sparse.indices, -1)) AS last", "min(sparse.size) AS size").first()
    assert (got["n"], got["last"], got["size"]) == (1_000_000, 1_000_000, 1_000_001)


def test_no_roles(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "session_id int, role string, x double")
    row = X.sparse_vector(df, X.fit_features(df, ["x"], optional=False), X.role_dictionary(df)).first()
    assert row["sparse"].asDict() == {"size": 1, "indices": [], "values": []}
    assert X.role_dictionary(df).count() == 0


def test_words_inside_texts(spark):
    random.seed(2)
    words = ["".join(random.choice("abé") for _ in range(random.randrange(1, 4))) for _ in range(40)] + ["", None, "abc"]
    texts = ["".join(random.choice("abéx") for _ in range(random.randrange(12))) for _ in range(100)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for block in (3, 10**6):
        out = words_inside(df, "t", spark.createDataFrame([(w,) for w in words], "w string"), "w", "word", block_words=block)
        want = sorted((i, w) for i, t in enumerate(texts) for w in {w for w in words if w is not None} if t is not None and w in t)
        assert sorted((r["id"], r["word"]) for r in out.collect()) == want
    assert words_inside(df, "t", spark.createDataFrame([], "w string"), "w", "word").count() == 0
