"""A BM25 index that is written once, opened by its path, and searched without reading most of it.

Documents are dealt into slices of a few dozen: those whose commonest words are the same share slices, as documents of
one language or subject do, and a hash of the id says which. A block holds the postings of one term in one
slice, and the greatest impact among them; blocks lie in folders by a hash of their term, in order of term and slice.
A search adds up, from the blocks' heads alone, the most that any document of a slice can score for a query. The slices
that promise most are scored, which gives the score that a hit must have; of all other slices only those are scored that
can reach it. What comes out is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.fixed import BM25_B, BM25_K1, CANDIDATES
from lodestone.operators.retrieval import Bm25Index, bm25_index, idf, query_terms, top
from lodestone.sources.scratch import written

#: Documents of a slice, folders of blocks, and slices by query that are scored first, at least.
SLICE_DOCS, FOLDERS, FIRST_SLICES = 32, 64, 16
#: Words of the vocabulary that documents are told apart by, the commonest ones, and how many of them make a group.
MARKS, MARKS_OF_A_GROUP = 1000, 3


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def dealt(made: Bm25Index, documents: DataFrame, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """(id, slice) of every document (id), written. A group of documents, however large, has as many slices as it needs."""
    marks = written(made.frequencies.orderBy(F.col("df").desc(), "term").limit(MARKS), "marks")
    have = made.postings.join(F.broadcast(marks), "term").select("id", F.struct(-F.col("df"), "term").alias("m"))
    lists = have.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("m")), 1, MARKS_OF_A_GROUP).alias("g"))  # of at most MARKS
    of = documents.select("id").distinct().join(lists.select("id", F.coalesce(F.xxhash64("g"), F.lit(0)).alias("g")), "id", "left").fillna(0, ["g"])
    of = written(of, "groups")
    sizes = of.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / slice_docs).cast("int").alias("slices"))
    return written(of.join(sizes, "g").select("id", F.xxhash64("g", F.pmod(F.xxhash64("id"), F.col("slices"))).alias("slice")), "slices")


def write_index(corpus: DataFrame, path: str, text: str = "content", slice_docs: int = SLICE_DOCS) -> None:
    """The index of corpus (id, text) under path: blocks, terms (with df and idf), documents, and statistics, which are
    written last, so that an index that isn't complete can't be opened."""
    made = bm25_index(corpus.select("id", F.col(text).alias("content")))
    stats = made.stats.first()  # one row
    slices = dealt(made, corpus, slice_docs)
    impact = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.lit(stats.avgdl or 1.0)))
    posts = made.postings.join(slices, "id").select("term", "slice", F.struct("id", impact.alias("impact")).alias("p"))
    blocks = posts.groupBy("term", "slice").agg(F.max("p.impact").alias("top"), F.array_sort(F.collect_list("p")).alias("posts"))
    blocks = blocks.select(_folder(F.col("term")).alias("folder"), "term", "slice", "top", "posts")
    order = ["folder", "term", "slice"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    idf(made).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    slices.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/documents")
    corpus.sparkSession.createDataFrame([(stats.n_docs, stats.avgdl)], "n_docs long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame
    terms: DataFrame
    documents: DataFrame
    n_docs: int


def open_index(spark: SparkSession, path: str) -> BlockIndex:
    """The index under path; only its statistics are read."""
    stats = spark.read.parquet(f"{path}/stats").first()
    terms, documents = (spark.read.parquet(f"{path}/{t}") for t in ("terms", "documents"))
    kind = documents.schema["id"].dataType.simpleString()
    # an empty index has no folders to read a schema from
    blocks = spark.read.schema(f"term string, slice long, top double, posts array<struct<id: {kind}, impact: double>>, folder int").parquet(f"{path}/blocks")
    return BlockIndex(blocks, terms, documents, stats.n_docs)


def query_weights(index: BlockIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight), written: what a term counts for in a query. A row for each word of a query."""
    df = query_terms(queries).join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    return written(df, "query-weights")


def _read(index: BlockIndex, weights: DataFrame) -> DataFrame:
    """The blocks in the folders of the queries' terms; there are at most FOLDERS."""
    folders = [r.f for r in weights.select(_folder(F.col("term")).alias("f")).distinct().collect()]
    return index.blocks.where(F.col("folder").isin(folders) if folders else F.lit(False))


def bounds(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, slice, bound), written: the most that a document of the slice can score, from the heads of blocks."""
    heads = blocks.select("term", "slice", "top").join(weights, "term")
    return written(heads.groupBy("query_id", "slice").agg(F.sum(F.greatest(F.lit(0.0), F.col("weight") * F.col("top"))).alias("bound")), "slice-bounds")


def scores(blocks: DataFrame, weights: DataFrame, chosen: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of all documents in chosen (query_id, slice) that hold a term of the query."""
    work = chosen.select("query_id", "slice").join(weights, "query_id")
    parts = blocks.join(work, ["term", "slice"]).select("query_id", "weight", F.inline("posts"))
    if allowed is not None:
        parts = parts.join(allowed.select("id"), "id", "left_semi")
    # rounded, so that sums in another order rank alike
    return parts.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))


@dataclass(frozen=True)
class Search:
    """What a search has found, and what it had to read for it: hits (query_id, id, score), bound of all slices, those scored."""

    hits: DataFrame
    bounds: DataFrame
    scored: DataFrame


def search(index: BlockIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, weights: DataFrame | None = None) -> Search:
    weights = query_weights(index, queries) if weights is None else weights
    blocks = _read(index, weights)
    bound = bounds(blocks, weights)
    first = top(bound, max(FIRST_SLICES, -(-2 * k // SLICE_DOCS)), F.col("bound").desc(), F.col("slice")).drop("rank")
    first = written(first, "first-slices")
    early = written(scores(blocks, weights, first, allowed), "first-scores")
    needed = top(early, k, F.col("score").desc(), F.col("id")).where(F.col("rank") == k).select("query_id", F.col("score").alias("needed"))
    # scores are rounded, so a bound may fall short of one by that
    rest = bound.join(first.select("query_id", "slice"), ["query_id", "slice"], "left_anti").join(needed, "query_id", "left")
    rest = written(rest.where(F.col("needed").isNull() | (F.col("bound") >= F.col("needed") - 1e-6)).select("query_id", "slice"), "other-slices")
    hits = early if rest.isEmpty() else early.unionByName(scores(blocks, weights, rest, allowed))
    return Search(hits, bound, first.select("query_id", "slice").unionByName(rest))


def block_topk(index: BlockIndex, queries: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """The k best documents of allowed (id; a part of the corpus) for every query, as bm25_topk gives them: documents that
    score nothing fill what is left, lowest ids first."""
    weights = query_weights(index, queries)
    best = written(top(search(index, queries, k, allowed, weights).hits.where("score <> 0"), k, F.col("score").desc(), F.col("id")), "block-hits")
    positive = F.count_if(F.col("score") > 0)
    short = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(positive.alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    short = written(short, "short-queries")
    if short.isEmpty():
        return best
    lowest = written((index.documents if allowed is None else allowed).select("id").orderBy("id").limit(2 * k), "lowest")
    some = weights.join(short, "query_id", "left_semi")
    near = short.crossJoin(F.broadcast(index.documents.join(F.broadcast(lowest), "id", "left_semi").select("slice").distinct()))  # at most 2k rows
    low = scores(_read(index, some), some, near, lowest).where("score <> 0")
    fill = short.crossJoin(F.broadcast(lowest)).join(low, ["query_id", "id"], "left_anti")
    pool = best.select("query_id", "id", "score").unionByName(fill.select("query_id", "id", F.lit(0.0).alias("score")))
    return top(pool, k, F.col("score").desc(), F.col("id"))
