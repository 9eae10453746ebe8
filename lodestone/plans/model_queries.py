"""Queries of injected model calls, by their stand-ins, and of the turn's state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.fixed import INTENT_HINTS, NO_HISTORY, PROMPT_CONTEXT, PROMPT_END, PROMPT_HISTORY, PROMPT_LATEST, PROMPT_QUESTION, PROMPT_SKETCH
from lodestone.functions.models import analysis_model, echo_model, embed
from lodestone.operators import conversation as V
from lodestone.operators import generation as G
from lodestone.plans import chain
from lodestone.plans.base import INTENT_SQL, QUESTIONS, law_corpus, queries, query, table, with_intent


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


HINT = "CASE intent " + " ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in INTENT_HINTS.items()) + " END"
PROMPTS = f"prompts AS (SELECT query_id, {_lit(PROMPT_CONTEXT)} || 'ngữ cảnh ' || query_id || chr(10) || chr(10) || {_lit(PROMPT_QUESTION)} || text || chr(10) || chr(10) || {HINT} || chr(10) || chr(10) || {_lit(PROMPT_END)} AS p FROM (SELECT *, {INTENT_SQL} AS intent FROM queries))"


@query("SELECT query_id, CASE WHEN length(p) % 7 <> 0 THEN length(p) || ': ' || p END AS answer FROM prompts", QUESTIONS, PROMPTS)
def llm_answer(spark, d):
    q = with_intent(queries(spark, d)).withColumn("context", F.concat(F.lit("ngữ cảnh "), F.col("query_id").cast("string")))
    return G.answers(q.withColumn("hints", G.prompt_hints(F.col("intent"), F.lit(False), F.lit("any"))), echo_model)


ASKED = f"asked AS (SELECT query_id, text, length({_lit(PROMPT_HISTORY)} || CASE WHEN query_id % 2 = 0 THEN {_lit(NO_HISTORY)} ELSE 'h' || query_id END || chr(10) || chr(10) || {_lit(PROMPT_LATEST)} || text) AS n FROM queries)"


@query(
    """SELECT query_id, CASE WHEN ok THEN CASE n % 4 WHEN 0 THEN 'legal_rag' WHEN 1 THEN 'chit_chat' WHEN 2 THEN 'web_legal_search' ELSE 'out_of_scope' END ELSE 'legal_rag' END AS category, CASE WHEN ok THEN 'list' ELSE 'penalty' END AS intent,
    CASE WHEN ok THEN 'o_to' ELSE 'any' END AS vehicle_type, CASE WHEN ok THEN 'S' || n ELSE text END AS query, CASE WHEN ok AND n % 3 <> 0 THEN 'a' || n || ' | b' ELSE text END AS expanded_query FROM (SELECT *, n % 5 <> 0 AND n % 7 <> 0 AS ok FROM asked)""",
    QUESTIONS,
    ASKED,
)
def analyzer_call(spark, d):
    q = queries(spark, d).withColumn("history", F.expr("CASE WHEN query_id % 2 = 1 THEN concat('h', query_id) END"))
    return V.analyze(q, analysis_model).drop("expanded")


@query(
    f"SELECT query_id, CASE WHEN intent <> 'mixed' THEN CASE WHEN length(p) % 7 <> 0 THEN length(p) || ': ' || p ELSE text END END AS hyde FROM (SELECT *, {_lit(PROMPT_SKETCH)} || text AS p, {INTENT_SQL} AS intent FROM queries)",
    QUESTIONS,
)
def hyde_call(spark, d):
    return V.sketch_answers(with_intent(queries(spark, d)), echo_model)


STATE = "CASE event_id % 5 WHEN 0 THEN 'legal_rag' WHEN 1 THEN 'chit_chat' WHEN 2 THEN 'web_legal_search' WHEN 3 THEN 'legal_rag' ELSE 'other' END"


@query(
    f"""SELECT event_id, 'analyzer>' || first || CASE WHEN legal THEN '>web_search' ELSE '' END || CASE WHEN web AND event_id % 7 <> 0 THEN '>web_finalize' ELSE '' END AS path, web AND event_id % 7 = 0 AS waits FROM (
    SELECT *, legal OR first = 'web_search' AS web FROM (SELECT *, first = 'legal_rag' AND event_type <> 'error' AND (event_id % 3 = 0 OR event_id % 4 = 0) AS legal FROM (
    SELECT event_id, event_type, CASE {STATE} WHEN 'web_legal_search' THEN 'web_search' WHEN 'other' THEN 'out_of_scope' ELSE {STATE} END AS first FROM events)))"""
)
def state_machine(spark, d):
    """The path of a turn through its nodes, and whether it waits for a reviewer."""
    e = table(spark, d, "events")
    made = V.node_path(F.expr(STATE), F.expr("CASE WHEN event_type = 'error' THEN 'E' END"), F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 4 == 0, 0).otherwise(5), F.expr("CASE WHEN event_id % 7 <> 0 THEN true END"))
    return e.select("event_id", *[c.alias(k) for k, c in made.items()])


@query()
def legal_turn(spark, d):
    """A whole turn for every question: searched by its text and a rewrite, and by a hypothetical answer; judged and routed.
    No SQL: its steps are each compared with theirs."""
    c = law_corpus(spark, d).withColumn("name", F.concat(F.lit("Luật "), "doc")).withColumn("dieu_title", F.concat(F.lit("Tiêu đề "), F.col("dieu").cast("string")))
    vectors = embed(c.select("id", "content"), "content").select("id", "embedding")
    asks = with_intent(queries(spark, d))
    asks = asks.join(V.sketch_answers(asks, echo_model), "query_id")
    asks = asks.select("query_id", "text", F.col("text").alias("raw"), "intent", F.lit("o_to").alias("vehicle"), F.when(F.col("query_id") % 2 == 0, F.array("text", F.concat(F.lit("mức phạt "), "text"))).alias("expanded"), "hyde")
    turn = chain.legal_turn(c, vectors, asks, lambda df: embed(df, "text"))
    return turn.prompts.join(turn.verdicts, "query_id").select("query_id", "route", "confidence", "passed", "multi_frame", "n_chunks", "hints", "context")
