"""Queries of context, prompts, answers and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.fixed import BAD_ANSWER_STARTS, CITATION, CLARIFY, GREETING, INTENT_HINTS, MULTI_FRAME_HINT, OUT_OF_SCOPE, REFUSAL, SIBLING_TAG, SOURCE_TAG, VEHICLE_HINTS, WEB_FAILED, WEB_NO_SYNTHESIS, WEB_NOTHING, WEB_WARNING, re2
from lodestone.operators import generation as G
from lodestone.plans.base import CHUNKS, CORPUS, INTENT_SQL, QUESTIONS, chunks, corpus, queries, query, table, with_intent

NAMED = "named AS (SELECT k.query_id, k.pos, k.id, k.is_sibling, c.doc, CASE WHEN k.id % 4 = 3 THEN '' ELSE 'Luật tên dài ' || c.doc || ' (2024)' END AS name, c.dieu, CASE WHEN k.id % 3 = 0 THEN NULL WHEN k.id % 3 = 1 THEN '' ELSE 'Tiêu đề ' || k.id END AS dieu_title, c.khoan, c.diem, c.content FROM chunks k JOIN corpus c ON c.id = k.id)"


def _named(spark, d):
    df = chunks(spark, d).join(corpus(spark, d), "id")
    return df.selectExpr("query_id", "pos", "id", "is_sibling", "doc", "CASE WHEN id % 4 = 3 THEN '' ELSE concat('Luật tên dài ', doc, ' (2024)') END AS name", "dieu", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE concat('Tiêu đề ', id) END AS dieu_title", "khoan", "diem", "content")


PLACE = "'Điều ' || dieu || ' · Khoản ' || khoan || CASE WHEN diem IS NOT NULL THEN ' · Điểm ' || diem ELSE '' END"


@query(
    f"""SELECT q.query_id, coalesce(t.context, '(Không có ngữ cảnh nào được truy xuất.)') AS context FROM queries q LEFT JOIN (SELECT query_id, string_agg('[' || CASE WHEN is_sibling THEN '{SIBLING_TAG}' ELSE '{SOURCE_TAG} ' || pos END || '] ' || name || ' (' || doc || ') · ' || {PLACE} || CASE WHEN coalesce(dieu_title, '') <> '' THEN chr(10) || dieu_title ELSE '' END || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM named GROUP BY 1) t ON t.query_id = q.query_id""",
    CORPUS,
    QUESTIONS,
    CHUNKS,
    NAMED,
)
def context_render(spark, d):
    return G.render_context(_named(spark, d), queries(spark, d))


VEHICLES = ("any", "o_to", "mo_to", "chuyen_dung", "xe_dap")
VEHICLE_SQL = "CASE query_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(VEHICLES)) + " END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "SELECT query_id, CASE intent " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in INTENT_HINTS.items()) + f" END || CASE WHEN query_id % 2 = 0 THEN chr(10) || chr(10) || {_quoted(MULTI_FRAME_HINT)} ELSE '' END || CASE WHEN intent IN ('penalty', 'mixed') AND vehicle <> 'any' THEN chr(10) || chr(10) || CASE vehicle " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in VEHICLE_HINTS.items()) + f" END ELSE '' END AS hints FROM (SELECT query_id, {INTENT_SQL} AS intent, {VEHICLE_SQL} AS vehicle FROM queries)",
    QUESTIONS,
)
def prompt_hints(spark, d):
    q = with_intent(queries(spark, d)).withColumn("vehicle", F.expr(VEHICLE_SQL))
    return q.select("query_id", G.prompt_hints(F.col("intent"), F.col("query_id") % 2 == 0, F.col("vehicle")).alias("hints"))


WARNED = f"CASE query_id % 5 WHEN 0 THEN concat('{BAD_ANSWER_STARTS[0]}, hãy cẩn trọng.', chr(10), chr(10), '  ', text) WHEN 1 THEN concat('{BAD_ANSWER_STARTS[2]}.;: ', text) WHEN 2 THEN concat(' {BAD_ANSWER_STARTS[1]} ', chr(10), chr(10), text) ELSE text END"


@query(
    f"""SELECT query_id, CASE WHEN bad IS NULL THEN a WHEN instr(a, chr(10) || chr(10)) > 1 THEN regexp_replace(substr(a, instr(a, chr(10) || chr(10)) + 2), '^\\s+', '') ELSE regexp_replace(substr(a, length(bad) + 1), '^[ ,.;:\\n]+', '') END AS answer
    FROM (SELECT query_id, a, CASE {" ".join(f"WHEN starts_with(regexp_replace(a, '^\\s+', ''), '{b}') THEN '{b}'" for b in BAD_ANSWER_STARTS)} END AS bad FROM (SELECT query_id, {WARNED} AS a FROM queries))""",
    QUESTIONS,
)
def strip_prefix(spark, d):
    q = queries(spark, d).withColumn("answer", F.expr(WARNED))
    return q.select("query_id", G.strip_prefix(F.col("answer")).alias("answer"))


REFUSED = f"CASE query_id % 4 WHEN 0 THEN ' {REFUSAL}.. ' WHEN 1 THEN '{REFUSAL[:-1]}' WHEN 2 THEN concat('{REFUSAL}', ' ', text) ELSE text END"


@query(f"SELECT query_id, rtrim(trim({REFUSED}), '.') = '{REFUSAL[:-1]}' AS refused FROM queries", QUESTIONS)
def refusal_flag(spark, d):
    q = queries(spark, d).withColumn("answer", F.expr(REFUSED))
    return q.select("query_id", G.is_refusal(F.col("answer")).alias("refused"))


#: Answers that cite in several forms, one of which can't be parsed (a bracket inside the brackets).
ANSWER = """CASE query_id % 5 WHEN 0 THEN concat('Theo [Điều 1, Khoản ', query_id % 5 + 1, ' — src', query_id % 20, '] và (Điều 2).') WHEN 1 THEN concat('Xem [Điều 1, Khoản 1, Điểm A — Luật tên dài src', query_id % 20, '].')
 WHEN 2 THEN 'Theo [Điều 1 — Luật (36/2024/QH15)]' WHEN 3 THEN concat('[dieu 1 khoan 2] rồi [Điều 2 - NĐ 168/2024/NĐ-CP]') ELSE text END"""
PARSED = f"""parsed AS (SELECT query_id, unnest(range(len(a)))::INTEGER AS cite_no, nullif(lower(trim(unnest(a))), '') AS dieu, nullif(lower(trim(unnest(b))), '') AS khoan, nullif(lower(trim(unnest(c))), '') AS diem, lower(trim(coalesce(unnest(t), ''))) AS tail
  FROM (SELECT query_id, regexp_extract_all(x, {re2(CITATION)}, 1) AS a, regexp_extract_all(x, {re2(CITATION)}, 2) AS b, regexp_extract_all(x, {re2(CITATION)}, 3) AS c, regexp_extract_all(x, {re2(CITATION)}, 4) AS t FROM (SELECT query_id, {ANSWER} AS x FROM queries)))"""


def _answers(spark, d):
    return queries(spark, d).withColumn("answer", F.expr(ANSWER))


@query("SELECT * FROM parsed", QUESTIONS, PARSED)
def citation_parse(spark, d):
    return G.citations(_answers(spark, d))


@query(
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INTEGER AS n, id, doc, dieu, khoan, diem FROM (
      SELECT n.query_id, n.pos, n.id, n.doc, n.dieu::VARCHAR AS dieu, n.khoan, n.diem, row_number() OVER (PARTITION BY n.query_id, n.doc, n.dieu, n.khoan, n.diem ORDER BY n.pos) AS rn FROM named n WHERE EXISTS (SELECT 1 FROM parsed p WHERE p.query_id = n.query_id AND p.dieu = n.dieu::VARCHAR
        AND coalesce(p.khoan = n.khoan, true) AND coalesce(p.diem = n.diem, true) AND (p.tail = '' OR contains(p.tail, n.doc) OR contains(n.doc, p.tail) OR (regexp_extract(p.tail, '(\\d+/\\d{4})', 1) <> '' AND contains(n.doc, regexp_extract(p.tail, '(\\d+/\\d{4})', 1)))
        OR (n.name <> '' AND contains(p.tail, lower(regexp_replace(n.name, '\\s*\\([^)]*\\)\\s*$', '')))))))
    WHERE rn = 1""",
    CORPUS,
    QUESTIONS,
    CHUNKS,
    NAMED,
    PARSED,
)
def citation_match(spark, d):
    return G.cited_sources(_named(spark, d), G.citations(_answers(spark, d)))


@query(
    f"SELECT query_id, pos, coalesce(nullif(name, ''), doc) || ' — ' || {PLACE} AS label, CASE WHEN url <> '' THEN 'Web' ELSE 'Văn bản pháp luật' END AS org, CASE WHEN url <> '' THEN 'Web' ELSE 'Pháp luật' END AS type FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN 'http://x' ELSE '' END AS url FROM named)",
    CORPUS,
    CHUNKS,
    NAMED,
)
def source_label(spark, d):
    n = _named(spark, d).withColumn("url", F.when(F.col("pos") % 3 == 0, "http://x").otherwise(""))
    made = G.source_label(F.col("name"), F.lit(None).cast("string"), F.col("doc"), F.col("url"), F.col("dieu"), F.col("khoan"), F.col("diem"))
    return n.select("query_id", "pos", *[c.alias(k) for k, c in made.items()])


INLINE = "concat('Như [', query_id, '] và [1][2], [a] ', text, ' [', query_id % 3, ']')"


@query(f"SELECT query_id, array_to_string(regexp_extract_all({INLINE}, '\\[(\\d+)\\]', 1), ',') AS refs FROM queries", QUESTIONS)
def inline_refs(spark, d):
    q = queries(spark, d).withColumn("t", F.expr(INLINE))
    return q.select("query_id", F.array_join(F.transform(G.inline_refs(F.col("t")), lambda x: x.cast("string")), ",").alias("refs"))


@query(
    f"""SELECT site, CASE WHEN site % 5 = 0 THEN '{WEB_WARNING}' || chr(10) || '{WEB_FAILED}' WHEN n = 0 THEN '{WEB_WARNING}' || chr(10) || '{WEB_NOTHING}' WHEN site % 5 = 1 THEN '{WEB_WARNING}' || chr(10) || '{WEB_NO_SYNTHESIS}' ELSE 'tóm tắt ' || site END AS draft,
    CASE WHEN site % 5 = 0 THEN 0 ELSE urls END AS n_sources, site % 5 <> 0 AND n > 0 AS requires_approval FROM (SELECT site, (count(*) FILTER (WHERE site <> 7))::INTEGER AS n, (count(*) FILTER (WHERE site <> 7 AND page_id % 3 <> 0))::INTEGER AS urls FROM (SELECT page_id % 17 AS site, page_id, row_number() OVER (PARTITION BY page_id % 17 ORDER BY page_id) AS rn FROM pages) WHERE rn <= 5 GROUP BY 1)"""
)
def web_draft(spark, d):
    p = table(spark, d, "pages").select("page_id", "url").withColumn("rn", F.row_number().over(Window.partitionBy(F.col("page_id") % 17).orderBy("page_id"))).where("rn <= 5")
    p = p.selectExpr("page_id % 17 AS site", "CASE WHEN page_id % 17 <> 7 THEN struct('t' AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS url, 'c' AS content) END AS r")
    g = p.groupBy("site").agg(F.collect_list("r").alias("results"))
    made = G.web_draft(F.col("site") % 5 == 0, F.col("results"), F.when(F.col("site") % 5 != 1, F.concat(F.lit(" tóm tắt "), F.col("site").cast("string"))))
    return g.select("site", *[c.alias(k) for k, c in made.items()])


@query(f"SELECT query_id, CASE query_id % 4 WHEN 0 THEN '{OUT_OF_SCOPE}' WHEN 1 THEN '{GREETING}' WHEN 2 THEN trim(text) ELSE text END AS answer FROM queries", QUESTIONS)
def canned_answer(spark, d):
    q = queries(spark, d)
    route = F.expr("CASE query_id % 4 WHEN 0 THEN 'out_of_scope' WHEN 3 THEN 'legal_rag' ELSE 'chit_chat' END")
    return q.select("query_id", G.canned_answer(route, F.expr("CASE query_id % 4 WHEN 1 THEN ' ' WHEN 2 THEN concat(' ', text) ELSE text END")).alias("answer"))


@query("SELECT query_id, CASE WHEN query_id % 3 = 0 THEN " + _quoted(CLARIFY) + " ELSE text END AS answer FROM queries", QUESTIONS)
def low_confidence(spark, d):
    return queries(spark, d).select("query_id", G.answer_or_clarify(F.col("query_id") % 3 != 0, F.col("text")).alias("answer"))
