import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foliomill.llm.ann")
from foliomill.llm import ann
from foliomill.llm.queries import QUERIES
from foliomill.operators.vectors import cosine


def brute(ids, vectors, queries, k=5):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {}
    for q in queries:
        scores = np.round(v @ v[list(ids).index(q)], 12)
        ranked = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:k]
        found[q] = [i for _, i in ranked]
    return found


def test_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    got = QUERIES["op5_ann"](spark, folder).toPandas().sort_values(["query_id", "rank"])
    vectors = np.array(table.embedding.tolist(), dtype=np.float64)
    truth = brute(table.vec_id.tolist(), vectors, [i for i in table.vec_id if i % 50 == 0])
    assert set(got.query_id) == set(truth)
    hits = [len(set(truth[q]) & set(part.vec_id)) / 5 for q, part in got.groupby("query_id")]
    assert np.mean(hits) >= 0.9
    at = {i: n for n, i in enumerate(table.vec_id)}
    for r in got.head(200).itertuples():
        a, b = vectors[at[r.query_id]], vectors[at[r.vec_id]]
        assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)
    assert all(list(p["rank"]) == [1, 2, 3, 4, 5] and list(p.score) == sorted(p.score, reverse=True) for _, p in got.groupby("query_id"))


def test_copies_small_tables_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.5], "x") for i in range(0, 400)] + [(1000 + i, [1.0, 0.01 * i, 0.5], "x") for i in range(1, 4)]
    rows += [(2000, None, "x"), (2001, [0.0, 0.0, 0.0], "x"), (2002, [1.0, None, 2.0], "x"), (2003, [nan, 1.0, 1.0], "x"), (2004, [inf, 1.0, 1.0], "x"), (2005, [], "x"), (2006, [1.0, 2.0], "x"), (None, [1.0, 1.0, 1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.ann_search(table, table.where("vec_id in (0, 50, 1001, 2000, 2006)"), block=1).toPandas()
    ranked = {q: list(p.sort_values("rank").vec_id) for q, p in got.groupby("query_id")}
    assert ranked == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 1001: [1002, 0, 1, 2, 3]}
    few = table.where("vec_id in (0, 1002, 1003)")
    assert ann.ann_search(few, few).count() == 6
    assert ann.ann_search(table.limit(0), table).count() == 0
    assert ann.ann_search(table, table.limit(0)).count() == 0


def recall(spark, vectors, every=40, **settings):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = ann.ann_search(table, table.where(f"vec_id % {every} = 0"), **settings).toPandas()
    truth = brute(range(len(vectors)), vectors, range(0, len(vectors), every))
    assert set(got.query_id) == set(truth)
    assert all(len(p) == 5 for _, p in got.groupby("query_id"))
    return np.mean([len(set(truth[q]) & set(p.vec_id)) / 5 for q, p in got.groupby("query_id")])


def test_recall_where_vectors_lie_close_together(spark):
    """All around one point, or half of them a group of near copies, more than codes could tell apart."""
    rng = np.random.default_rng(3)
    around = rng.standard_normal((1, 64)) + 0.01 * rng.standard_normal((4000, 64))
    assert recall(spark, around) >= 0.9
    copies = np.concatenate([rng.standard_normal((2000, 64)), rng.standard_normal((1, 64)) + 0.001 * rng.standard_normal((2000, 64))])
    assert recall(spark, copies) >= 0.9
    # a sample that holds few of the group
    assert recall(spark, copies, sample=400, block=1000) >= 0.9


def test_recall_of_wide_vectors_offset_from_zero(spark):
    rng = np.random.default_rng(4)
    assert recall(spark, rng.standard_normal((3000, 254)) + 3) >= 0.9


def test_scores_are_the_cosine_expression_and_survive_large_components(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((300, 9)).tolist())], "vec_id long, embedding array<double>")
    got = ann.ann_search(table, table.where("vec_id < 5"))
    sides = [table.selectExpr(f"vec_id AS {name}_id", f"embedding AS {name}") for name in ("query", "vec")]
    same = got.join(sides[0], "query_id").join(sides[1], "vec_id").where(cosine(F.col("query"), F.col("vec")) == F.col("score"))
    assert same.count() == got.count() == 25
    large = table.selectExpr("vec_id", "transform(embedding, x -> x * 1e200) AS embedding")
    assert sorted(map(tuple, ann.ann_search(large, large.where("vec_id < 5")).select("query_id", "rank", "vec_id").collect())) == sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect()))


def test_shelves_after_the_first_ones_give_only_what_reaches_the_bar(spark):
    """Rows found for a query grow far less than the number of shelves."""
    vectors = np.random.default_rng(6).standard_normal((4000, 16))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = {block: ann.found_by_shelf(table, table.where("vec_id % 40 = 0"), probe=1.0, block=block).count() / 100 for block in (1000, 100)}
    assert found[1000] <= 20
    assert found[100] <= 60  # 5 from each of 40 shelves would be 200
