"""Queries of the chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.fixed import ARTICLE_START, CLAUSE_LETTERS, FORM_NOISE, GENERAL_TOPIC, INTRO_TITLE, UNKNOWN, re2
from lodestone.operators import chunking as C
from lodestone.plans.base import LAW_LINES, law_lines, query, table

STEM = "CASE WHEN doc_id % 4 = 0 THEN 'tt' || doc_id % 12 ELSE CASE WHEN doc_id % 4 = 1 THEN 'LAW' || doc_id % 3 || '_2024' ELSE 'x' || doc_id END END"
RULES = "('tt0', 0), ('TT4_full_name', 1), ('law1', 2), ('law', 3), ('law2_2024', 4)"
RULE_FIELDS = "key, ordinal, 'D' || ordinal AS doc_id, 'Title ' || key AS title, 'issuer' || ordinal % 2 AS issuer, CASE WHEN ordinal = 3 THEN 'repealed' ELSE 'active' END AS status, '2024-01-0' || (ordinal + 1) AS effective_date, 'topic' || ordinal AS topic"


@query(
    f"""SELECT doc_no, stem, coalesce(m.doc_id, stem) AS doc_id, coalesce(m.title, stem) AS title, coalesce(m.issuer, '{UNKNOWN}') AS issuer, coalesce(m.status, 'active') AS status, coalesce(m.effective_date, '{UNKNOWN}') AS effective_date, coalesce(m.topic, '{GENERAL_TOPIC}') AS topic
    FROM files LEFT JOIN (SELECT s.stem AS stem2, r.*, row_number() OVER (PARTITION BY s.stem ORDER BY CASE WHEN r.key = s.stem THEN 0 ELSE 1 END, r.ordinal) AS rn FROM (SELECT DISTINCT stem FROM files) s JOIN rules r ON contains(lower(s.stem), lower(r.key)) OR contains(lower(r.key), lower(s.stem))) m ON m.stem2 = stem AND m.rn = 1""",
    f"files AS (SELECT doc_id AS doc_no, {STEM} AS stem FROM documents)",
    f"rules AS (SELECT {RULE_FIELDS} FROM (VALUES {RULES}) AS t(key, ordinal))",
)
def meta_fuzzy_join(spark, d):
    files = table(spark, d, "documents").selectExpr("doc_id AS doc_no", f"{STEM} AS stem")
    rules = spark.sql(f"SELECT {RULE_FIELDS} FROM (VALUES {RULES}) AS t(key, ordinal)")
    return C.resolve_metadata(files, rules)


TAIL = ARTICLE_START.removeprefix("(?i)")
ARTICLES = f"""heads AS (SELECT doc_id, pos, line, regexp_matches(line, {re2(ARTICLE_START)}) AS head, (sum(CASE WHEN regexp_matches(line, {re2(ARTICLE_START)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS article_no FROM law_lines),
articles AS (SELECT doc_id, article_no, coalesce(min(CASE WHEN head THEN regexp_extract(line, {re2(ARTICLE_START)}, 1) END), '0') AS dieu, coalesce(min(CASE WHEN head THEN trim(regexp_extract(line, {re2(ARTICLE_START)}, 2)) END), '{INTRO_TITLE}') AS dieu_title, string_agg(line, chr(10) ORDER BY pos) AS body FROM heads GROUP BY 1, 2)"""


@query("SELECT * FROM articles", LAW_LINES, ARTICLES)
def article_split(spark, d):
    return C.split_articles(law_lines(spark, d))


#: Lines that start a clause open an island; the text before the first one is clause 0.
CLAUSES = f"""cl AS (SELECT h.*, regexp_matches(line, '^\\d+\\.\\s+[{CLAUSE_LETTERS}]') AS start FROM heads h),
cg AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, article_no ORDER BY pos) AS g FROM cl),
craw AS (SELECT doc_id, article_no, g, coalesce(min(CASE WHEN start THEN regexp_extract(line, '^(\\d+)\\.', 1) END), '0') AS khoan, string_agg(line, chr(10) ORDER BY pos) || CASE WHEN g < max(g) OVER (PARTITION BY doc_id, article_no) THEN chr(10) ELSE '' END AS text, max(g) OVER (PARTITION BY doc_id, article_no) AS last FROM cg GROUP BY 1, 2, 3),
clauses AS (SELECT doc_id, article_no, khoan, CASE WHEN g = 0 AND last > 0 THEN trim(text, ' \t\n\r') ELSE text END AS text, (row_number() OVER (PARTITION BY doc_id, article_no ORDER BY g) - 1)::INTEGER AS clause_no FROM craw WHERE NOT (g = 0 AND last > 0 AND trim(text, ' \t\n\r') = ''))"""


@query("SELECT doc_id, article_no, clause_no, khoan, text FROM clauses", LAW_LINES, ARTICLES, CLAUSES)
def clause_split(spark, d):
    a = C.split_articles(law_lines(spark, d))
    return a.select("doc_id", "article_no", F.posexplode(C.clauses_of(F.col("body"))).alias("clause_no", "c")).select("doc_id", "article_no", "clause_no", "c.khoan", "c.text")


#: Points start a line here, or follow "; " in it, which is cut off with them.
POINTS = """pl AS (SELECT doc_id, article_no, clause_no, unnest(string_split(regexp_replace(regexp_replace(text, '(;\\s+)([a-zđ]\\)\\s)', chr(1) || '\\2', 'g'), '(?m)^([a-zđ]\\)\\s)', chr(1) || '\\1', 'g'), chr(1))) AS part, unnest(range(len(string_split(regexp_replace(regexp_replace(text, '(;\\s+)([a-zđ]\\)\\s)', chr(1) || '\\2', 'g'), '(?m)^([a-zđ]\\)\\s)', chr(1) || '\\1', 'g'), chr(1))))) AS k, text FROM clauses),
pp AS (SELECT *, max(k) OVER w AS last, trim(first_value(part) OVER (PARTITION BY doc_id, article_no, clause_no ORDER BY k), ' \t\n\r') AS preamble FROM pl WINDOW w AS (PARTITION BY doc_id, article_no, clause_no)),
points AS (SELECT doc_id, article_no, clause_no, CASE WHEN k = 0 THEN '' ELSE substr(part, 1, 1) END AS diem, CASE WHEN last = 0 THEN text WHEN k = 0 THEN preamble ELSE CASE WHEN preamble <> '' THEN preamble || chr(10) ELSE '' END || trim(part, ' \t\n\r') END AS text, (row_number() OVER (PARTITION BY doc_id, article_no, clause_no ORDER BY k) - 1)::INTEGER AS point_no FROM pp WHERE NOT (k = 0 AND last > 0 AND preamble = ''))"""


@query("SELECT doc_id, article_no, clause_no, point_no, diem, text FROM points", LAW_LINES, ARTICLES, CLAUSES, POINTS)
def point_split_preamble(spark, d):
    a = clause_split(spark, d)
    return a.select("doc_id", "article_no", "clause_no", F.posexplode(C.points_of(F.col("text"))).alias("point_no", "p")).select("doc_id", "article_no", "clause_no", "point_no", "p.diem", "p.text")


TOKENS = "CAST(floor(len(regexp_extract_all({0}, '\\S+')) * 1.3::DOUBLE) AS INTEGER)"
TYPE = "CASE doc_id % 3 WHEN 0 THEN 'nghidinh' WHEN 1 THEN 'luat' ELSE 'thongtu' END"
LEVELS = f"""sized AS (SELECT *, {TOKENS.format("body")} AS n, {TYPE} AS doc_type FROM articles),
sc AS (SELECT c.*, s.doc_type, s.dieu, s.dieu_title, {TOKENS.format("c.text")} AS n, len(regexp_extract_all(c.text, '(?m)(?:^|;\\s+)([a-zđ])\\)\\s', 1)) AS np FROM clauses c JOIN sized s USING (doc_id, article_no) WHERE s.n > 600),
sd AS (SELECT *, n > CASE WHEN doc_type = 'nghidinh' THEN 80 ELSE 500 END OR (doc_type = 'nghidinh' AND np >= 2) AS deep FROM sc WHERE n >= 30),
levels AS (SELECT doc_id, article_no, dieu, dieu_title, doc_type, NULL::VARCHAR AS khoan, NULL::VARCHAR AS diem, 1 AS level, body AS text, 0 AS clause_no, 0 AS point_no FROM sized WHERE n >= 30 AND n <= 600
UNION ALL SELECT doc_id, article_no, dieu, dieu_title, doc_type, nullif(khoan, '0'), NULL, 2, text, clause_no, 0 FROM sd WHERE NOT deep
UNION ALL SELECT s.doc_id, s.article_no, s.dieu, s.dieu_title, s.doc_type, nullif(s.khoan, '0'), nullif(p.diem, ''), 3, p.text, s.clause_no, p.point_no FROM sd s JOIN points p USING (doc_id, article_no, clause_no) WHERE deep AND {TOKENS.format("p.text")} >= 5)"""


def _levels(spark, d):
    articles = C.split_articles(law_lines(spark, d)).withColumn("doc_type", F.expr(TYPE))
    return C.chunk_levels(articles)


@query("SELECT doc_id, article_no, khoan, diem, level, text, clause_no, point_no FROM levels", LAW_LINES, ARTICLES, CLAUSES, POINTS, LEVELS)
def chunk_levels(spark, d):
    return _levels(spark, d).select("doc_id", "article_no", "khoan", "diem", "level", "text", "clause_no", "point_no")


NOISY = "CASE WHEN doc_id % 9 = 0 THEN text || ' Sổ theo dõi' WHEN doc_id % 9 = 4 THEN 'NHẬT KÝ ' || text ELSE text END"


@query("SELECT doc_id FROM documents WHERE NOT (" + " OR ".join(f"contains(lower({NOISY}), '{k}')" for k in FORM_NOISE) + ")")
def form_noise_filter(spark, d):
    return table(spark, d, "documents").withColumn("text", F.expr(NOISY)).where(~C.is_form_noise(F.col("text"))).select("doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_md5_first(spark, d):
    return C.dedup_first(table(spark, d, "documents"), ("source",), "text", ("doc_id",)).select("doc_id", "source")


#: The texts here have no tables, and their lines nothing that refining joins but hyphens and small letters.
REFINE_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\\s*-\\s*)\\n\\s*', '\\1', 'g'), '([{1},;])\\n([{1}])', '\\1 \\2', 'g'), '(?m)^[-=_]{{5,}}\\s*$', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _refine_sql(x: str) -> str:
    from lodestone.functions.fixed import FINE_RANGE, REFINE_LETTERS, REVOCATION

    out = REFINE_SQL.format(x, REFINE_LETTERS)
    return f"regexp_replace(regexp_replace(regexp_replace({out}, {re2(FINE_RANGE)}, '**\\1**', 'g'), {re2(REVOCATION)}, '**\\1**', 'g'), '\\*{{4,}}', '**', 'g')"


CHUNKED = f"""styled AS (SELECT *, {_refine_sql("text")} AS body, 'Văn bản: Luật ' || doc_id || ' | Điều ' || dieu || ': ' || dieu_title AS ctx FROM levels),
ctx AS (SELECT *, CASE WHEN dieu <> '0' AND NOT starts_with(body, ctx) THEN ctx || chr(10) || body ELSE body END AS c1 FROM styled),
warned AS (SELECT *, CASE WHEN doc_id % 10 = 0 AND NOT starts_with(c1, '>') THEN '> ⚠️ Hết hiệu lực' || chr(10) || chr(10) || c1 ELSE c1 END AS content FROM ctx),
built AS (SELECT *, 'VB_' || doc_id || '_2024_dieu' || dieu || CASE WHEN coalesce(khoan, '') <> '' THEN '_khoan' || khoan ELSE '' END || CASE WHEN coalesce(diem, '') <> '' THEN '_diem' || diem ELSE '' END AS chunk_id, {TOKENS.format("content")} AS token_estimate, row_number() OVER (PARTITION BY doc_id, md5(content) ORDER BY article_no, clause_no, point_no) AS rn FROM warned WHERE NOT ({" OR ".join(f"contains(lower(content), '{k}')" for k in FORM_NOISE)}))"""


def _built(spark, d):
    parts = _levels(spark, d).withColumns({"no": F.col("doc_id"), "title": F.concat(F.lit("Luật "), F.col("doc_id").cast("string")), "warning": F.when(F.col("doc_id") % 10 == 0, "Hết hiệu lực")})
    return C.build_chunks(parts.withColumn("doc_id", F.concat(F.lit("VB/"), F.col("no").cast("string"), F.lit("-2024"))))


@query("SELECT chunk_id, level, token_estimate, content FROM built WHERE rn = 1", LAW_LINES, ARTICLES, CLAUSES, POINTS, LEVELS, CHUNKED)
def chunk_build(spark, d):
    return _built(spark, d).select("chunk_id", "level", "token_estimate", "content")


@query("SELECT doc_type, level, count(*)::BIGINT AS n_chunks, sum(token_estimate)::BIGINT AS tokens, max(token_estimate) AS most, grouping(doc_type, level)::BIGINT AS \"grouping\" FROM built WHERE rn = 1 GROUP BY GROUPING SETS ((), (doc_type), (level))", LAW_LINES, ARTICLES, CLAUSES, POINTS, LEVELS, CHUNKED)
def chunk_stats_rollup(spark, d):
    return C.chunk_statistics(_built(spark, d))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, d):
    return C.upsert_latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


