"""Retrieval for many queries at once: tokens, BM25, dense vectors, filters, fusion, reranking.

A list of hits is a table (query_id, id, score, rank); order is never left to rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.fixed import BM25_B, BM25_EPSILON, BM25_K1, CANDIDATES, EXCLUSION_RULES, RRF_K, STOPWORDS
from lodestone.operators.blocks import nearest, nearest_in_lists
from lodestone.sources.scratch import written

#: Of an approximate index: vectors that it's fitted on at most, lists at most, and the share of true neighbours that its probes must find there.
SAMPLE_VECTORS, MOST_LISTS, PROBED = 20_000, 256, 0.97


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more, without stop words, repeats included."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def postings(corpus: DataFrame, text: str = "content") -> DataFrame:
    """(id, dl, term, tf). Token counts of a document meet on the map side, before the shuffle."""
    t = corpus.select("id", tokens(F.col(text)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).alias("tf"))


def document_frequencies(corpus: DataFrame, text: str = "content") -> DataFrame:
    """(term, df): in how many documents each term is; a document's own repeats are dropped before anything is shuffled. Ids are distinct."""
    return corpus.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class Bm25Index:
    """The corpus tokenised once, as written tables that all searches read: postings (id, dl, term, tf), frequencies (term,
    df) and stats (n_docs, avgdl; one row)."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def bm25_index(corpus: DataFrame) -> Bm25Index:
    post = written(postings(corpus), "bm25-postings")
    # documents without a token have no posting, but count
    n = corpus.agg(F.count(F.lit(1)).alias("n_docs"))
    stats = post.agg(F.sum("tf").alias("n_tokens")).crossJoin(n).select("n_docs", (F.coalesce("n_tokens", F.lit(0)) / F.nullif("n_docs", F.lit(0))).alias("avgdl"))
    return Bm25Index(post, written(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "bm25-frequencies"), written(stats, "bm25-stats"))


def idf(index: Bm25Index, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, idf), of terms if given: negative values become a share of the mean over the vocabulary, negatives included."""
    return term_weights(index.frequencies, index.stats, terms)


def term_weights(frequencies: DataFrame, stats: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """idf of (term, df) and of stats (n_docs; one row)."""
    raw = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    df = frequencies.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", raw.alias("raw"))
    mean = df.agg(F.avg("raw").alias("mean"))  # one row
    if terms is not None:
        df = df.join(terms, "term", "left_semi")
    return df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def query_weights(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight, avgdl): what a term counts for in a query, by the whole corpus's statistics. A row for
    each word of a query, written once and read by every scoring."""
    terms = query_terms(queries)
    weights = terms.join(idf(index, terms.select("term").distinct()), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))  # one row
    return written(weights.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"), "bm25-weights")


def bm25_scores(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, id, score) of all documents that hold a term of the query."""
    tf = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    scored = postings.join(weights, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * tf).alias("score"))
    # rounded, so that sums in another order rank alike
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


def top(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """hits with their rank in the query's list, up to k; Spark keeps k a query on the map side."""
    by = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None, index: Bm25Index | None = None) -> DataFrame:
    """The k best documents of allowed (rows of the corpus), for every query. Documents that score nothing fill what is
    left, lowest ids first: no more than the 2k lowest ids can be needed, so only those are looked at. index: of the
    corpus, if there is one already."""
    index = index or bm25_index(corpus)
    weights = query_weights(index, queries)
    # words that no query asks for are left out before anything is shuffled
    post = index.postings.join(weights.select("term").distinct(), "term", "left_semi")
    if allowed is not None:
        post = post.join(allowed.select("id"), "id", "left_semi")
    best = top(bm25_scores(post, weights), k, F.col("score").desc(), F.col("id")).drop("rank")
    lowest = written((corpus if allowed is None else allowed).select("id").orderBy("id").limit(2 * k), "bm25-lowest")
    low = bm25_scores(index.postings.join(F.broadcast(lowest), "id", "left_semi"), weights).where("score <> 0")
    fill = queries.select("query_id").crossJoin(F.broadcast(lowest)).join(low, ["query_id", "id"], "left_anti")
    pool = best.where("score <> 0").unionByName(fill.select("query_id", "id", F.lit(0.0).alias("score")))
    return top(pool, k, F.col("score").desc(), F.col("id"))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _crossed(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """All pairs, row by row, by a join that broadcasts neither side."""
    pairs = vectors.hint("shuffle_replicate_nl").crossJoin(queries.select("query_id", F.col("embedding").alias("q")).hint("shuffle_replicate_nl"))
    return pairs.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Exact search: vectors (id, embedding), queries (query_id, embedding), by products of blocks; k hits a query of each
    part of the vectors are shuffled. Vectors that are null, of another length or not finite are compared row by row."""
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    plain = F.coalesce((F.size("embedding") == dim) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < 1e15, F.lit(False))), F.lit(False)) & F.lit(dim > 0)
    odd_vectors, odd_queries = vectors.where(~plain), queries.where(~plain)
    hits = nearest(vectors.where(plain), queries.where(plain), dim, k) if dim > 0 else _crossed(vectors.limit(0), queries)
    for v, q in ((odd_vectors, queries), (vectors.where(plain), odd_queries)):
        if not (odd_vectors if v is odd_vectors else odd_queries).isEmpty():
            hits = hits.unionByName(_crossed(v, q))
    return written(top(hits, k, F.col("score").desc(), F.col("id")), "dense-hits")  # k rows a query, which callers read more than once


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file: every vector stands in the list of its nearest centre. lists (list, id, embedding) is written by list."""

    centres: np.ndarray
    probes: int
    lists: DataFrame


def _nearest(centres: np.ndarray, n: int):
    """A function of a column of unit vectors: the n nearest centres of each, nearest first."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(np.argsort(-(np.vstack(vectors) @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32).tolist())

    return run


def _fit_centres(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def vector_index(vectors: DataFrame, k: int = CANDIDATES) -> VectorIndex:
    """Centres and the number of lists to probe come from a sample of at most SAMPLE_VECTORS, by the smallest hash of their
    ids: the fewest probes that find PROBED of the k true neighbours there. Every vector is put into its list."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_VECTORS).select("embedding").collect()
    if not rows:
        return VectorIndex(np.zeros((1, 1)), 1, written(vectors.select(F.lit(0).alias("list"), "id", "embedding"), "vector-lists"))
    sample = np.array([r.embedding for r in rows], float)
    n = int(min(MOST_LISTS, max(1, np.sqrt(len(sample)))))
    centres = _fit_centres(sample, n)
    own, asked = (sample @ centres.T).argmax(1), sample[:: max(1, len(sample) // 200)]
    true = np.argsort(-(asked @ sample.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list among those that a query probes
    needed = np.sort(np.take_along_axis(place, own[true], 1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(PROBED * len(needed))))])
    lists = vectors.select(F.get(_nearest(centres, 1)("embedding"), F.lit(0)).alias("list"), "id", "embedding")
    return VectorIndex(centres, probes, written(lists, "vector-lists"))


def ann_topk(index: VectorIndex, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Approximate search: each query (query_id, embedding) meets the vectors of its probed lists only, list by list, by products
    of blocks; each list gives k hits a query."""
    probed = F.explode(_nearest(index.centres, index.probes)("embedding")).alias("list")
    asked = written(queries.select("query_id", "embedding", probed), "probed-lists")
    n = index.lists.groupBy("list").agg(F.count(F.lit(1)).alias("v")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list")
    sizes = {r.list: (r.v, r.q) for r in n.collect()}  # a row for each list, MOST_LISTS at most
    return top(nearest_in_lists(index.lists, asked, sizes, k), k, F.col("score").desc(), F.col("id"))


def filtered(corpus: DataFrame, status: str | None = "active", topic: str | None = None, doc: str | None = None, not_topics: tuple[str, ...] = (), not_docs: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a search may return: status "all", "" or None turns that filter off."""
    df = corpus
    if status and status != "all":
        df = df.where(F.col("status") == status)
    if topic:
        df = df.where(F.col("topic") == topic)
    if doc:
        df = df.where(F.col("doc") == doc)
    if not_topics:
        df = df.where(~F.coalesce("topic", F.lit("")).isin(*not_topics))
    if not_docs:
        df = df.where(~F.coalesce("doc", F.lit("")).isin(*not_docs))
    return df


def auto_exclude(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries with not_topics and not_docs: what a query's wording excludes, added to what it excludes already."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = lambda k: F.filter(F.array(*[F.when(F.contains(t, F.lit(r[0])), F.lit(r[k])) for r in EXCLUSION_RULES]), lambda x: x.isNotNull())
    given = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in queries.columns else F.array().cast("array<string>")
    return queries.withColumn("not_topics", F.array_union(given("not_topics"), found(1))).withColumn("not_docs", F.array_union(given("not_docs"), found(2)))


def rrf_hybrid(dense: DataFrame, bm25: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two lists; ties go to the dense list's order, then to BM25's."""
    both = dense.select("query_id", "id", "rank", F.lit(0).alias("list")).unionByName(bm25.select("query_id", "id", "rank", F.lit(1).alias("list")))
    return rrf_lists(both, k, F.col("first"))


def rrf_lists(lists: DataFrame, k: int, *ties: Column) -> DataFrame:
    """lists (query_id, list, id, rank) fused. first is (list, rank) where an id is met first; by default ties go
    to the rank there, then to the list."""
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = ties or (F.col("first.rank"), F.col("first.list"))
    return top(fused, k, F.col("score").desc(), *order).select("query_id", "id", "score", "rank", "first")


def fetch_size(k: int, rerank_top_n: int, reranking: bool) -> int:
    """How many hits are fused: more than are asked for only if they're reranked."""
    return max(k, rerank_top_n) if reranking else k


def rerank(hits: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, scorer) -> DataFrame:
    """The k best hits by an injected scorer(query text, content), a pandas UDF; equal scores keep their order."""
    pairs = hits.join(corpus.select("id", "content"), "id").join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
    scored = pairs.select("query_id", "id", F.col("rank").alias("__was"), F.round(scorer("__q", "content"), 6).alias("score"))
    return top(scored, k, F.col("score").desc(), F.col("__was")).drop("__was")
