"""Exact search by blocks against a plain one."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import blocks
from lodestone.operators import retrieval as R
from lodestone.operators.retrieval import cosine, dense_topk, top


def plain_topk(vectors, queries, k):
    pairs = vectors.crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    return top(pairs.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")), k, F.col("score").desc(), F.col("id"))


def rows(df):
    return sorted((r.query_id, r.rank, r.id, str(r.score)) for r in df.select("query_id", "rank", "id", "score").collect())


def test_dense_search_by_blocks_is_exact_and_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    made = rng.normal(size=(400, 8))
    made[100:180] = made[100]  # copies: ties by id
    data = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(400), made, strict=True)]
    odd = [(1000, None), (1001, [1.0, 2.0]), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1e30] * 8)]
    for kind in ("float", "double"):
        vectors = spark.createDataFrame(data + odd, f"id long, embedding array<{kind}>")
        queries = vectors.where("id % 9 = 0 OR id IN (1000, 1002, 1004)").withColumnRenamed("id", "query_id")
        got = dense_topk(vectors, queries, 5)
        assert rows(got) == rows(plain_topk(vectors, queries, 5))
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    none = vectors.limit(0)
    assert dense_topk(none, queries, 5).count() == dense_topk(vectors, none.withColumnRenamed("id", "query_id"), 5).count() == 0


def test_rounding_is_sparks(spark):
    r = random.Random(1)
    xs = [r.uniform(-2, 2) for _ in range(2000)] + [(i + 0.5) / 1e6 for i in range(-500, 500)] + [1e15 + 0.3, -0.0, 1e-9, -1e-9]
    want = [x[0] for x in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert blocks.rounded(np.array(xs)).tolist() == want


def test_lists_are_searched_by_blocks(spark, monkeypatch):
    """A list cut into parts, whose queries are cut into groups, gives what all pairs of the list give, and no pair is a row of a join."""
    monkeypatch.setattr(blocks, "PART_ROWS", 37)
    monkeypatch.setattr(blocks, "GROUP_ROWS", 5)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:150] = x[50]  # one long list of equal vectors
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    asked = vectors.where("id % 4 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = R.vector_index(vectors, 7)
    got = R.ann_topk(index, asked, 7)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    lists = {r.id: r.list for r in index.lists.collect()}
    want = []
    for i in range(0, 400, 4):
        near = set(np.argsort(-(x[i] @ index.centres.T), kind="stable")[: index.probes].tolist())
        score = {j: round(float(sum(a * b for a, b in zip(x[i].astype(float), x[j].astype(float)))), 6) for j in range(400) if lists[j] in near}
        want += [(i, j, r + 1, score[j]) for r, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:7])]
    assert sorted((r.query_id, r.id, r["rank"], r.score) for r in got.collect()) == sorted(want)
