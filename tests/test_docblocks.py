"""BM25 by blocks of documents against the plain operator, block by block."""

import glob
import random

import pyarrow.parquet as pq

from lodestone.operators import blocks
from lodestone.operators import docblocks as D
from lodestone.operators.retrieval import bm25_topk


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.select("query_id", "rank", "id", "score").collect())


def test_search_by_blocks_is_the_plain_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "QUERIES", 2)
    r, words = random.Random(4), [f"w{i}" for i in range(30)]
    texts = [" ".join(["common", *(r.choice(words) for _ in range(r.randrange(9)))]) for _ in range(200)] + [None, "", "the", "w1 w1 w1"] * 3
    corpus = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "id long, content string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "common"), (3, "nowhere"), (4, None), (5, "w3 common"), (6, "w1 w29")], "query_id long, text string")
    D.write_blocks(corpus.repartition(9), str(tmp_path), docs=16)
    index = D.open_blocks(spark, str(tmp_path))
    assert index.blocks.count() > 5
    for allowed in (None, corpus.where("id % 3 = 0"), corpus.limit(0)):
        for k in (3, 30, 500):
            got = D.topk(index, asked, k, allowed)
            assert rows(got) == rows(bm25_topk(corpus, asked, k, allowed))
    assert "Broadcast" not in D.topk(index, asked, 3)._jdf.queryExecution().executedPlan().toString()


def test_index_counts_documents_of_terms(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a1 b1"), (2, "b1")], "id long, content string")
    D.write_blocks(corpus, str(tmp_path))
    assert sorted((r.term, r.df) for r in D.open_blocks(spark, str(tmp_path)).frequencies.collect()) == [("a1", 1), ("b1", 2)]
    D.write_blocks(corpus.limit(0), f"{tmp_path}/none")
    none = D.open_blocks(spark, f"{tmp_path}/none")
    assert D.topk(none, spark.createDataFrame([(1, "a1")], "query_id long, text string")).count() == 0


def test_a_task_holds_one_block(spark, tmp_path):
    """Each block is a row group of its own, and a search neither buffers blocks beside queries nor writes or sorts them anew."""
    corpus = spark.createDataFrame([(i, f"w{i} common") for i in range(60)], "id long, content string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        D.write_blocks(corpus, str(tmp_path), docs=10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/doc-blocks/*.parquet")]
    assert max(m.num_rows for m in files) > 1 and all(m.num_row_groups == m.num_rows for m in files)
    index = D.open_blocks(spark, str(tmp_path))
    marked = D.only(index.blocks, corpus.where("id % 2 = 0"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan, plan
    pairs = blocks.met(spark.range(3).toDF("block"), index.blocks)
    assert pairs.columns == [*index.blocks.columns, "block"]  # the right side is what Spark buffers
    assert sum(bin(x).count("1") for r in marked.collect() for x in r.stay) == 30


def test_blocks_scanned_in_parts_are_read_where_they_lie(spark, tmp_path):
    """Only the blocks of queries are dealt out; every block meets each of them."""
    spark.range(40).repartition(8).write.parquet(f"{tmp_path}/rows")
    asked, rows = spark.range(3).toDF("block"), spark.read.parquet(f"{tmp_path}/rows")
    pairs = blocks.met(asked, rows)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("RoundRobinPartitioning") == 1
    assert pairs.count() == pairs.distinct().count() == 120
