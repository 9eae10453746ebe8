"""Rendering of grounded context and prompts, and reconciliation of an answer's citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.fixed import BAD_ANSWER_STARTS, CITATION, CLARIFY, GREETING, INTENT_HINTS, MULTI_FRAME_HINT, NO_CONTEXT, OUT_OF_SCOPE, PROMPT_CONTEXT, PROMPT_END, PROMPT_QUESTION, REFUSAL, SIBLING_TAG, SOURCE_TAG, VEHICLE_HINTS, WEB_FAILED, WEB_NO_SYNTHESIS, WEB_NOTHING, WEB_WARNING
from lodestone.functions.models import ask
from lodestone.operators.text import strip
from lodestone.sources.scratch import written


def _given(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def location(dieu: Column, khoan: Column, diem: Column, separator: str = " · ") -> Column:
    """The parts that are there; empty if none is."""
    part = lambda name, c: F.when(_given(c).isNotNull(), F.concat(F.lit(name + " "), c.cast("string")))
    return F.concat_ws(separator, F.when(_given(dieu) != "0", F.concat(F.lit("Điều "), dieu.cast("string"))), part("Khoản", khoan), part("Điểm", diem))


def render_context(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """chunks (query_id, pos, doc, name, dieu, dieu_title, khoan, diem, is_sibling, content) -> (query_id, context).
    Siblings take a number too, though they don't show it."""
    tag = F.when(F.col("is_sibling"), SIBLING_TAG).otherwise(F.concat(F.lit(SOURCE_TAG + " "), F.col("pos").cast("string")))
    place = location(F.col("dieu"), F.col("khoan"), F.col("diem"))
    head = F.concat(F.lit("["), tag, F.lit("] "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("doc", F.lit("?")), F.lit(")"), F.when(place != "", F.concat(F.lit(" · "), place)).otherwise(""), F.coalesce(F.concat(F.lit("\n"), _given(F.col("dieu_title"))), F.lit("")))
    block = F.concat(head, F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    out = chunks.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n---\n\n").alias("context"))
    return queries.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def prompt_hints(intent: Column, multi_frame: Column, vehicle: Column) -> Column:
    """An unknown intent reads as penalty; a vehicle counts only where fines are asked for."""
    out = F.coalesce(_lookup(INTENT_HINTS)[intent], F.lit(INTENT_HINTS["penalty"]))
    frame = F.when(multi_frame, "\n\n" + MULTI_FRAME_HINT).otherwise("")
    bound = F.when(intent.isin("penalty", "mixed") & (vehicle != "any"), F.concat(F.lit("\n\n"), _lookup(VEHICLE_HINTS)[vehicle]))
    return F.concat(out, frame, F.coalesce(bound, F.lit("")))


def user_prompt(context: Column, question: Column, hints: Column) -> Column:
    return F.concat(F.lit(PROMPT_CONTEXT), context, F.lit("\n\n" + PROMPT_QUESTION), question, F.lit("\n\n"), hints, F.lit("\n\n" + PROMPT_END))


def answers(prompts: DataFrame, model: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """prompts (query_id, text, context, hints) -> (query_id, answer) by an injected model, without a web warning at its
    start; null where the model failed."""
    said = prompts.select("query_id", ask(user_prompt(F.col("context"), F.col("text"), F.col("hints")), model, batch).alias("answer"))
    return written(said, "answers").select("query_id", strip_prefix(strip(F.col("answer"))).alias("answer"))


def strip_prefix(answer: Column) -> Column:
    """Takes off a web-search warning at the start: the first paragraph, or the words and what punctuates them."""
    at = F.instr(answer, "\n\n")
    cut = None
    for bad in BAD_ANSWER_STARTS:
        hit = F.startswith(F.ltrim(F.regexp_replace(answer, r"(?U)^\s+", "")), F.lit(bad))
        new = F.when(at > 1, F.regexp_replace(F.substring(answer, at + 2, F.length(answer)), r"(?U)^\s+", "")).otherwise(F.regexp_replace(F.substring(answer, F.lit(len(bad) + 1), F.length(answer)), r"^[ ,.;:\n]+", ""))
        cut = F.when(hit, new) if cut is None else cut.when(hit, new)
    return cut.otherwise(answer)


def is_refusal(answer: Column) -> Column:
    """The refusal phrase, whatever dots follow it."""
    return F.rtrim(strip(answer), F.lit(".")) == REFUSAL.rstrip(".")


def citations(answers: DataFrame, text: str = "answer", key: str = "query_id") -> DataFrame:
    """key, cite_no, dieu, khoan, diem, tail: the bracketed citations of a text."""
    part = lambda k: F.regexp_extract_all(text, F.lit("(?U)" + CITATION.replace("(?i)", "(?iu)")), F.lit(k))
    zipped = F.arrays_zip(*[part(k).alias(n) for k, n in enumerate(("a", "b", "c", "d"), 1)])
    low = lambda c: F.nullif(F.lower(strip(c)), F.lit(""))
    return answers.select(key, F.posexplode(zipped).alias("cite_no", "x")).select(key, "cite_no", low(F.col("x.a")).alias("dieu"), low(F.col("x.b")).alias("khoan"), low(F.col("x.c")).alias("diem"), F.lower(strip(F.col("x.d"))).alias("tail"))


def names_document(tail: Column, doc: Column, name: Column) -> Column:
    """Whether a citation's tail means the document: no tail, one within the other, the same number and year, or
    a name of eight letters or more without its bracket."""
    t, d = F.lower(tail), F.lower(F.coalesce(doc, F.lit("")))
    slug = F.regexp_extract(t, r"(\d+/\d{4})", 1)
    short = strip(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s*\([^)]*\)\s*$", ""))
    return (t == "") | ((d != "") & (F.contains(t, d) | F.contains(d, t) | ((slug != "") & F.contains(d, slug)))) | ((F.length(short) >= 8) & F.contains(t, short))


def cited_sources(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """The chunks (query_id, pos, id, doc, name, dieu, khoan, diem) that a citation of their answer means, each
    location once, first chunk first. Clauses and points are held against each other only where both are given."""
    low = lambda c: F.nullif(F.lower(strip(c.cast("string"))), F.lit(""))
    c = chunks.select("query_id", "pos", "id", "doc", "name", low(F.col("dieu")).alias("cd"), low(F.col("khoan")).alias("ck"), low(F.col("diem")).alias("cp"))
    p = parsed.select(F.col("query_id").alias("q"), F.col("dieu").alias("pd"), F.col("khoan").alias("pk"), F.col("diem").alias("pp"), "tail")
    agree = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(True))
    on = (F.col("query_id") == F.col("q")) & (F.col("cd") == F.col("pd")) & agree("ck", "pk") & agree("cp", "pp") & names_document(F.col("tail"), F.col("doc"), F.col("name"))
    kept = c.join(p, on, "left_semi")
    once = Window.partitionBy("query_id", "doc", "cd", "ck", "cp").orderBy("pos")
    kept = kept.withColumn("__rn", F.row_number().over(once)).where("__rn = 1")
    return kept.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("n"), "id", "doc", F.col("cd").alias("dieu"), F.col("ck").alias("khoan"), F.col("cp").alias("diem"))


def source_label(name: Column, title: Column, doc: Column, url: Column, dieu: Column, khoan: Column, diem: Column) -> dict[str, Column]:
    place = location(dieu, khoan, diem)
    base = F.coalesce(_given(name), _given(title), _given(doc), F.lit("Nguồn"))
    web = _given(url).isNotNull()
    return {"label": F.when(place != "", F.concat(base, F.lit(" — "), place)).otherwise(base), "org": F.when(web, "Web").otherwise("Văn bản pháp luật"), "type": F.when(web, "Web").otherwise("Pháp luật")}


def inline_refs(text: Column) -> Column:
    """The numbers of [n] marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def web_context(results: Column) -> Column:
    """array<struct<title, url, content>> as numbered blocks."""
    return F.array_join(F.transform(results, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit("(no title)")), F.lit("\n"), F.coalesce(r["url"], F.lit("")), F.lit("\n"), F.coalesce(r["content"], F.lit("")))), "\n\n")


def web_draft(failed: Column, results: Column, synthesis: Column) -> dict[str, Column]:
    """The draft that a reviewer sees: the synthesis of the results, or what stands in for it if the search failed,
    found nothing, or wasn't summed up; sources are the results that have an address."""
    found = F.coalesce(F.size(results), F.lit(-1)) > 0
    say = lambda text: F.lit(f"{WEB_WARNING}\n{text}")
    draft = F.when(failed, say(WEB_FAILED)).when(~found, say(WEB_NOTHING)).when(synthesis.isNull(), say(WEB_NO_SYNTHESIS)).otherwise(strip(synthesis))
    sources = F.filter(results, lambda r: _given(r["url"]).isNotNull())
    return {"draft": draft, "n_sources": F.when(failed | ~found, 0).otherwise(F.size(sources)), "requires_approval": ~failed & found}


def canned_answer(route: Column, answer: Column) -> Column:
    """What a node says without a model, or when its model has failed."""
    said = F.nullif(strip(answer), F.lit(""))
    return F.when(route == "out_of_scope", OUT_OF_SCOPE).when(route == "chit_chat", F.coalesce(said, F.lit(GREETING))).otherwise(F.coalesce(answer, F.lit("")))


def answer_or_clarify(passed: Column, answer: Column) -> Column:
    return F.when(passed, F.coalesce(answer, F.lit(""))).otherwise(CLARIFY)
