"""Conversation and review state as tables of events; evaluation of ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.fixed import ANALYSIS_DEFAULTS, CITED_SOURCES, LEGAL_DOMAINS, NO_HISTORY, PROMPT_HISTORY, PROMPT_LATEST, PROMPT_SKETCH, RECALL_FLOOR, UNTITLED, WEB_PREFIX
from lodestone.functions.models import ask
from lodestone.functions.schemas import CITATION
from lodestone.operators.text import strip
from lodestone.sources.scratch import ranked, written


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("__rn", F.row_number().over(by)).where(F.col("__rn") <= n).drop("__rn")


def history_window(messages: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, history): the last n messages, blank ones left out afterwards, a labelled line each. messages may
    have source_labels (array): an answer's sources follow it in a line of their own."""
    label = F.when(F.col("role") == "user", "user").otherwise("assistant")
    line = F.concat(F.lit("  "), label, F.lit(": "), strip(F.col("text")))
    if "source_labels" in messages.columns:
        numbered = F.array_join(F.transform("source_labels", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), ", ")
        line = F.when((F.col("role") == "assistant") & (F.size("source_labels") > 0), F.concat(line, F.lit("\n    " + CITED_SOURCES), numbered, F.lit(")"))).otherwise(line)
    kept = last_messages(messages, n).withColumn("__line", F.when(strip(F.coalesce("text", F.lit(""))) != "", line))
    rows = F.array_sort(F.collect_list(F.when(F.col("__line").isNotNull(), F.struct("turn", "__line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["__line"]), "\n").alias("h")).select("conv_id", F.coalesce(F.nullif("h", F.lit("")), F.lit(NO_HISTORY)).alias("history"))


def history_cap(messages: DataFrame, cap: int = 20) -> DataFrame:
    return last_messages(messages, cap)


def last_user_message(messages: DataFrame) -> DataFrame:
    last = F.max_by(F.when(F.col("role") == "user", F.coalesce("text", F.lit(""))), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(last, F.lit("")).alias("text"))


def conversation_titles(messages: DataFrame, default: str = UNTITLED) -> DataFrame:
    """A conversation that a user opens is called by the first 60 letters of that message."""
    first = F.min_by(F.struct("role", "text"), "turn")
    return messages.groupBy("conv_id").agg(first.alias("f")).select("conv_id", F.when(F.col("f.role") == "user", F.substring("f.text", 1, 60)).otherwise(default).alias("title"))


def patch_last_assistant(messages: DataFrame, patches: DataFrame) -> DataFrame:
    """messages with patches (conv_id, patch) as the text of each conversation's last answer."""
    last = messages.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("__t"))
    df = messages.join(last, "conv_id", "left").join(patches, "conv_id", "left")
    return df.select("conv_id", "turn", "role", F.when((F.col("turn") == F.col("__t")) & F.col("patch").isNotNull(), F.col("patch")).otherwise(F.col("text")).alias("text"))


def search_titles(titles: DataFrame, needle: str) -> DataFrame:
    return titles.where(F.contains(F.lower("title"), F.lit(needle.strip().lower())))


def route_by_category(category: Column) -> Column:
    """The graph's node for a category."""
    return F.when(category.isin("legal_rag", "chit_chat", "web_legal_search"), F.when(category == "web_legal_search", "web_search").otherwise(category)).otherwise("out_of_scope")


def fallback_route(error: Column, refused: Column, n_chunks: Column) -> Column:
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(failed, "end").when(F.coalesce(refused, F.lit(False)) | (F.coalesce(n_chunks, F.lit(0)) == 0), "web_search").otherwise("end")


def analyzer_fallback(query: Column, standalone: Column, expanded: Column, trimmed: Callable[[Column], Column] = strip) -> dict[str, Column]:
    """What an analysis leaves blank falls back to the query; trimmed takes off the blanks around what it says."""
    alone = F.coalesce(F.nullif(trimmed(standalone), F.lit("")), query)
    kept = F.filter(F.transform(F.coalesce(expanded, F.array().cast("array<string>")), lambda x: trimmed(x)), lambda x: x != "")
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(alone))
    return {"standalone_query": alone, "expanded_query": F.array_join(kept, " | "), "n_queries": F.size(kept)}


ANALYSIS = "category string, intent string, vehicle_type string, standalone_query string, expanded_queries array<string>"


def analyze(questions: DataFrame, model: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """questions (query_id, text, history) -> (query_id, category, intent, vehicle_type, query, expanded, expanded_query)
    by an injected model that answers in JSON. Where it fails, or says no category, all values are the defaults and
    the query stands for itself; rewrites that are all blank are the query."""
    prompt = F.concat(F.lit(PROMPT_HISTORY), F.coalesce("history", F.lit(NO_HISTORY)), F.lit("\n\n" + PROMPT_LATEST), "text")
    said = written(questions.select("query_id", "text", ask(prompt, model, batch).alias("said")), "analyses")
    df = said.withColumn("a", F.from_json("said", ANALYSIS))
    df = df.withColumn("a", F.when(F.col("a.category").isNotNull(), F.col("a")))
    value = lambda k: F.coalesce(F.col(f"a.{k}"), F.lit(ANALYSIS_DEFAULTS[k])).alias(k)
    kept = F.filter(F.transform("a.expanded_queries", lambda x: strip(x)), lambda x: x != "")
    expanded = F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(F.array("text"))
    return df.select("query_id", value("category"), value("intent"), value("vehicle_type"), F.coalesce("a.standalone_query", "text").alias("query"), expanded.alias("expanded"), F.array_join(expanded, " | ").alias("expanded_query"))


def sketch_answers(questions: DataFrame, model: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """questions (query_id, text, intent) -> (query_id, hyde): a hypothetical answer to search by, by an injected model; the
    question itself where the model fails or says nothing, null for the mixed intent, which several rewrites cover."""
    prompt = F.when(F.col("intent") != "mixed", F.concat(F.lit(PROMPT_SKETCH), "text"))
    asked = questions.withColumn("p", prompt)
    said = written(asked.where("p IS NOT NULL").select("query_id", "text", ask(F.col("p"), model, batch).alias("said")), "sketches")
    got = said.select("query_id", F.coalesce(F.nullif(strip(F.col("said")), F.lit("")), "text").alias("hyde"))
    return got.unionByName(asked.where("p IS NULL").select("query_id", F.lit(None).cast("string").alias("hyde")))


def node_path(category: Column, error: Column, refused: Column, n_chunks: Column, approved: Column, interrupt: bool = True) -> dict[str, Column]:
    """The nodes that a turn passes, and whether it waits: a turn that searches the web stops before its last node until
    someone has decided (approved isn't null), unless interrupt is off."""
    first = route_by_category(category)
    legal = (first == "legal_rag") & (fallback_route(error, refused, n_chunks) == "web_search")
    web = (first == "web_search") | legal
    waits = web & approved.isNull() if interrupt else F.lit(False)
    path = F.concat(F.lit("analyzer>"), first, F.when(legal, ">web_search").otherwise(""), F.when(web & ~waits, ">web_finalize").otherwise(""))
    return {"path": path, "waits": waits}


def web_query(expanded: Column, query: Column) -> Column:
    base = strip(F.coalesce(F.nullif(expanded, F.lit("")), F.nullif(query, F.lit("")), F.lit("")))
    return F.when(base == "", WEB_PREFIX).when(F.contains(F.lower(base), F.lit(WEB_PREFIX.lower())), base).otherwise(F.concat(F.lit(WEB_PREFIX + ": "), base))


def finalize(draft: Column, answer: Column) -> Column:
    return F.coalesce(F.nullif(draft, F.lit("")), F.nullif(answer, F.lit("")), F.lit(""))


def allowed_domain(url: Column, domains: tuple[str, ...] = LEGAL_DOMAINS) -> Column:
    """The url's host is an allowed domain or stands under one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def latest_state(events: DataFrame, key: str, order: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Of every field, the last value written for the key; a null writes nothing."""
    o = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), o)).alias(f) for f in fields])


def pending(state: DataFrame) -> DataFrame:
    """Threads that wait for a reviewer, newest first by rank."""
    waiting = state.where("requires_approval")
    return ranked(waiting, [F.col("created").desc(), F.col("thread")]).withColumn("rank", F.col("rank").cast("int"))


def resume(decisions: DataFrame, waiting: DataFrame, rejected: str) -> DataFrame:
    """decisions (thread, approved, override) applied to waiting (thread, draft): 404 if nothing waits, the canned
    answer if rejected, else the override or the draft."""
    df = decisions.join(waiting.select("thread", "draft", F.lit(True).alias("__w")), "thread", "left")
    answer = F.when(F.col("__w").isNull(), F.lit(None)).when(~F.col("approved"), rejected).otherwise(finalize(F.col("override"), F.col("draft")))
    return df.select("thread", F.when(F.col("__w").isNull(), 404).otherwise(200).alias("status"), answer.alias("answer"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """requests (ms, failed, ts) -> one row of counters; the mean is null without requests."""
    return requests.agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("failed").alias("n_errors"), F.round(F.sum("ms") / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("mean_ms"), F.max("ts").alias("last_request"))


def date_bucket(at: Column, now: Column, pinned: Column, names: tuple[str, ...]) -> Column:
    today = F.date_trunc("day", now)
    since = lambda days: today - F.expr(f"INTERVAL {days} DAYS")
    return F.when(pinned, names[0]).when(at >= today, names[1]).when(at >= since(1), names[2]).when(at >= since(7), names[3]).when(at >= since(30), names[4]).otherwise(names[5])


def relative_age(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds)
    unit = lambda per, name: F.concat(F.floor(s / per).cast("string"), F.lit(f"{name} trước"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def token_events(answers: DataFrame, key: str, text: str, size: int = 8) -> DataFrame:
    """key, seq, type, value: an answer as slices of size letters, then the end mark."""
    n = F.ceil(F.length(text) / size).cast("int")
    slices = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.lit("token").alias("type"), F.substring(F.col(text), i * size + 1, F.lit(size)).alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    every = F.concat(slices, F.array(F.struct(F.lit("done").alias("type"), F.lit("[DONE]").alias("value"))))
    return answers.select(key, F.posexplode(every).alias("seq", "e")).select(key, "seq", "e.type", "e.value")


def message_store(messages: DataFrame) -> DataFrame:
    """Messages of the application's table in the order of their conversation, with their citations parsed; what is no
    list of citations reads as none."""
    order = Window.partitionBy("conversationId").orderBy("createdAt", "id")
    parsed = F.coalesce(F.from_json("citations", T.ArrayType(CITATION)), F.array().cast(T.ArrayType(CITATION)))
    return messages.select("conversationId", F.row_number().over(order).alias("n"), "role", "content", parsed.alias("citations"))


def is_admin(email: Column, allowed: str | None) -> Column:
    """allowed: "*" for everyone, else addresses between commas, in any case; nobody if it's empty."""
    listed = [e.strip().lower() for e in (allowed or "").split(",") if e.strip()]
    return F.lit(True) if listed == ["*"] else F.coalesce(F.lower(email).isin(*listed), F.lit(False)) if listed else F.lit(False)


# --- evaluation -------------------------------------------------------------------------------------


def recall_at_k(hits: DataFrame, gold: DataFrame, k: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(query_id, recall): the share of a question's distinct gold keys among its first k hits, siblings (is_sibling, if
    hits say so) left out."""
    if "is_sibling" in hits.columns:
        hits = hits.where(~F.coalesce("is_sibling", F.lit(False)))
    found = hits.where(F.col("rank") <= k).select("query_id", *keys).distinct().withColumn("__f", F.lit(1))
    return gold.select("query_id", *keys).distinct().join(found, ["query_id", *keys], "left").groupBy("query_id").agg((F.count("__f") / F.count(F.lit(1))).alias("recall"))


def recall_gate(hits: DataFrame, gold: DataFrame, k: int, floor: float = RECALL_FLOOR, keys: tuple[str, ...] = ("doc", "dieu", "khoan")) -> DataFrame:
    """One row: n_questions, mean_recall by clause over all questions that have gold, and whether it reaches the floor."""
    each = recall_at_k(hits, gold, k, keys)
    return each.agg(F.count(F.lit(1)).alias("n_questions"), F.avg("recall").alias("mean_recall")).withColumn("passed", F.col("mean_recall") >= floor)


#: Words between blanks that an item and a text are joined by.
GRAM = 4
#: Items without an inner word that are held against all texts at once.
PHRASE_BLOCK = 5_000


def containing(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, id): texts (id, text) that contain an item's (query_id, text), letter by letter; an id that is null isn't
    found. An item's inner words stand between blanks wherever it's contained: the first of them, GRAM at most, are joined by
    their hash with those of the texts, without the texts; pairs that meet are then compared, each text once for its
    items. Items of one or two words have no inner word: they are held against every text, in blocks of bounded size."""
    words = lambda c: F.split(c, " ", -1)
    gram = lambda w, at, n: F.xxhash64(n, F.array_join(F.slice(w, at, n), " "))
    asked = items.where("text IS NOT NULL").select("query_id", F.col("text").alias("__q"), words(F.col("text")).alias("__w"))
    asked = written(asked.select("query_id", "__q", "__w", F.least(F.lit(GRAM), F.size("__w") - 2).alias("__n")), "phrases")
    keyed = asked.where("__n >= 1").select("query_id", gram(F.col("__w"), F.lit(2), F.col("__n")).alias("__k"))
    sizes = sorted(r["__n"] for r in asked.select("__n").distinct().collect())  # at most GRAM + 2
    out = None
    if sizes and sizes[-1] >= 1:
        w = F.col("__w")

        def grams(n: int) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda at: gram(w, at, F.lit(n)))
            return F.when(F.size(w) >= n, every).otherwise(F.array().cast("array<bigint>"))

        rows = texts.where("text IS NOT NULL").select("id", words(F.col("text")).alias("__w")).select("id", F.explode(F.array_distinct(F.concat(*[grams(n) for n in sizes if n >= 1]))).alias("__k"))
        pairs = written(rows.join(keyed, "__k").select("query_id", "id").distinct(), "phrase-pairs")
        meet = pairs.join(asked.select("query_id", "__q").distinct(), "query_id").join(texts.where("text IS NOT NULL").select("id", "text"), "id")
        out = meet.where(F.contains("text", F.col("__q"))).select("query_id", "id")
    if not sizes or sizes[0] < 1:
        short = asked.where("__n < 1").select("query_id", "__q")
        blocks = -(-short.count() // PHRASE_BLOCK) or 1
        for b in range(blocks):
            part = short if blocks == 1 else short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            found = texts.select("id", "text").join(F.broadcast(part), F.contains("text", F.col("__q"))).select("query_id", "id")
            out = found if out is None else out.unionByName(found)
    return out


def hit_at_k(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, hit): whether a hit's doc among the first k is the expected one."""
    first = hits.where(F.col("rank") <= k).select("query_id", "doc")
    return expected.join(first, ["query_id", "doc"], "left_semi").select("query_id", F.lit(True).alias("__h")).distinct().join(expected.select("query_id").distinct(), "query_id", "right").select("query_id", F.coalesce("__h", F.lit(False)).alias("hit"))


def reciprocal_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rr): one over the rank of the first gold hit, 0 if there's none."""
    first = hits.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return gold.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))
