"""A turn of the question-answering chain as one plan, for many questions at once.

Model calls (rewriting, hypothetical answers, embedding, generation) happen before and after; everything in
between is joins, windows and expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fixed import COMPLETION_PHRASES, DEFAULT_DOC, TOP_K, TOP_K_BROAD
from lodestone.operators import docblocks, enrich, generation, retrieval
from lodestone.operators.conversation import fallback_route
from lodestone.sources.scratch import fresh_path, written

#: A list's id is its question's, times this, plus its number: every list is searched like a question of its own.
LISTS = 1000


@dataclass
class Turn:
    chunks: DataFrame  # query_id, id, pos, score, is_sibling
    verdicts: DataFrame  # query_id, confidence, passed, multi_frame, n_chunks
    prompts: DataFrame  # query_id, context, hints, route


def search_lists(questions: DataFrame) -> DataFrame:
    """questions (query_id, text, expanded, hyde) -> (query_id, list, text): the rewrites, or the question itself,
    then the hypothetical answer where there is one."""
    rewrites = F.filter(F.coalesce("expanded", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    asked = F.when(F.size(rewrites) > 0, rewrites).otherwise(F.array("text"))
    every = F.concat(asked, F.filter(F.array("hyde"), lambda x: F.coalesce(x, F.lit("")) != ""))
    return questions.select("query_id", F.posexplode(every).alias("list", "text"))


def sizes(questions: DataFrame, lists: DataFrame) -> DataFrame:
    """(query_id, top_k, per_list, n_lists)."""
    blob = F.concat_ws(" | ", F.coalesce("expanded", F.array().cast("array<string>")))
    top_k = enrich.top_k_of(enrich.is_broad(F.coalesce("raw", F.lit("")), F.col("text"), blob))
    n = lists.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_lists"))
    df = questions.select("query_id", top_k.alias("top_k")).join(n, "query_id")
    return df.select("query_id", "top_k", enrich.budget(F.col("top_k"), F.col("n_lists")).alias("per_list"), "n_lists")


def search(corpus: DataFrame, vectors: DataFrame, lists: DataFrame, per_list: DataFrame, phrases: tuple[str, ...] = COMPLETION_PHRASES) -> DataFrame:
    """lists (query_id, list, text, embedding) -> hits with siblings: (query_id, list, id, pos, score, is_sibling). The
    corpus' active rows are searched, statistics are the whole corpus's."""
    as_queries = lists.select((F.col("query_id") * LISTS + F.col("list")).alias("query_id"), "text", "embedding")
    allowed = retrieval.filtered(corpus)
    # the vectors may be made by a model, and the search reads them more than once
    searched = written(vectors.join(allowed.select("id"), "id", "left_semi"), "turn-vectors")
    dense = retrieval.dense_topk(searched, as_queries.select("query_id", "embedding"))
    index = fresh_path(corpus.sparkSession, "turn-index")
    docblocks.write_blocks(corpus.select("id", "content"), index)
    bm25 = docblocks.topk(docblocks.open_blocks(corpus.sparkSession, index), as_queries.select("query_id", "text"), allowed=allowed)
    fused = retrieval.rrf_hybrid(dense, bm25, TOP_K_BROAD + 2)
    fused = fused.withColumn("q", F.floor(F.col("query_id") / LISTS)).join(per_list.select(F.col("query_id").alias("q"), "per_list"), "q").where(F.col("rank") <= F.col("per_list"))
    hits = enrich.with_siblings(fused.select("query_id", "id", F.col("rank").alias("pos"), "score"), corpus, phrases)
    return hits.select(F.floor(F.col("query_id") / LISTS).cast("long").alias("query_id"), (F.col("query_id") % LISTS).cast("int").alias("list"), "id", "pos", "score", "is_sibling")


def fuse(hits: DataFrame, per_question: DataFrame) -> DataFrame:
    """The lists of each question as one, twice its top_k at most. A chunk keeps the score and the flag that it had in
    the first list that held it. A question with one list keeps that list."""
    n = hits.groupBy("query_id").agg(F.count_distinct("list").alias("found"))
    one = hits.join(n.where("found = 1"), "query_id").select("query_id", "id", F.col("pos").cast("int").alias("pos"), "score", "is_sibling")
    many = hits.join(n.where("found > 1"), "query_id").select("query_id", "list", "id", F.col("pos").alias("rank"), "score", "is_sibling")
    fused = retrieval.rrf_lists(many, 10**6).select("query_id", "id", "rank")
    first = many.groupBy("query_id", "id").agg(F.min_by(F.struct("score", "is_sibling"), "list").alias("f"))
    fused = fused.join(per_question.select("query_id", "top_k"), "query_id").where(F.col("rank") <= 2 * F.col("top_k")).join(first, ["query_id", "id"])
    return one.unionByName(fused.select("query_id", "id", F.col("rank").cast("int").alias("pos"), "f.score", "f.is_sibling"))


def legal_turn(corpus: DataFrame, vectors: DataFrame, questions: DataFrame, embed, default_doc: str = DEFAULT_DOC, phrases: tuple[str, ...] = COMPLETION_PHRASES) -> Turn:
    """corpus (id, doc, name, dieu, dieu_title, khoan, diem, level, topic, status, content), vectors (id, embedding),
    questions (query_id, text, raw, intent, vehicle, expanded, hyde). embed puts a column embedding to a DataFrame's
    text. The mixed intent takes no hypothetical answer: several rewrites cover it."""
    questions = questions.withColumn("intent", F.coalesce(F.nullif("intent", F.lit("")), F.lit("penalty"))).withColumn("hyde", F.when(F.col("intent") != "mixed", F.col("hyde")))
    # Every step reads its predecessor's list several times over; written once, none is worked out again.
    lists = written(embed(search_lists(questions)), "turn-lists")
    per_question = written(sizes(questions, lists), "turn-sizes")
    hits = written(search(corpus, vectors, lists, per_question, phrases), "turn-hits")
    chunks = written(fuse(hits, per_question), "turn-fused")
    blob = questions.select("query_id", F.concat_ws(" ", "raw", "text", F.concat_ws(" | ", "expanded")).alias("t"))
    chunks = written(enrich.append_lookups(chunks, enrich.references(blob, "t", ("query_id",), default_doc), corpus), "turn-refs")
    chunks = written(enrich.append_cross_references(chunks, corpus, default_doc), "turn-xrefs")
    kinds = per_question.select("query_id", "top_k", (F.col("n_lists") > 1).alias("several"))
    marked = chunks.join(kinds, "query_id")
    cols = ["query_id", "id", "pos", "score", "is_sibling"]
    spread = marked.where("NOT several").select(*cols)
    for k in (TOP_K, TOP_K_BROAD):
        spread = spread.unionByName(enrich.diversify(marked.where(F.col("several") & (F.col("top_k") == k)).select(*cols), corpus, target=k))
    spread = written(spread, "turn-spread")
    fines = questions.where(F.col("intent").isin("penalty", "mixed")).select("query_id")
    pulled = enrich.pull_parents(spread.join(fines, "query_id", "left_semi"), corpus)
    chunks = written(spread.join(fines, "query_id", "left_anti").unionByName(pulled), "turn-chunks")
    verdicts = enrich.judge(chunks, corpus, questions)
    frames = enrich.multi_frame(chunks, corpus, F.lit("penalty")).join(questions.select("query_id", "intent"), "query_id").select("query_id", (F.col("multi_frame") & F.col("intent").isin("penalty", "mixed")).alias("multi_frame"))
    n = chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    verdicts = verdicts.join(frames, "query_id", "left").join(n, "query_id", "left").fillna(False, ["multi_frame"]).fillna(0, ["n_chunks"])
    shown = chunks.join(corpus.select("id", "doc", "name", "dieu", "dieu_title", "khoan", "diem", "content"), "id")
    prompts = generation.render_context(shown, questions).join(verdicts, "query_id").join(questions.select("query_id", "intent", "vehicle"), "query_id")
    hints = generation.prompt_hints(F.col("intent"), F.col("multi_frame"), F.coalesce("vehicle", F.lit("any")))
    route = F.when(F.col("n_chunks") == 0, fallback_route(F.lit(""), F.lit(False), F.col("n_chunks"))).when(~F.col("passed"), "clarify").otherwise("generate")
    return Turn(chunks, verdicts, prompts.select("query_id", "context", hints.alias("hints"), route.alias("route")))
