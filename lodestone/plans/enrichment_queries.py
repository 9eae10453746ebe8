"""Queries of what happens to hits after retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.fixed import BROAD_PHRASES, JUDGE_STOPWORDS, LEGAL_REF, MONEY, PROCEDURE_WORDS, REF_ARTICLE, REF_CLAUSE, REF_POINT, RULE_WORDS, re2
from lodestone.operators import enrich as N
from lodestone.plans.base import CHUNKS, CORPUS, INTENT_SQL, LAW, QUESTIONS, chunks, corpus, law_corpus, queries, query, table, values, with_intent

HERE = "prim AS (SELECT query_id, id, pos, score FROM chunks WHERE pos <= 5), here AS (SELECT p.query_id, p.pos, c.doc, c.dieu, CAST(c.khoan AS INTEGER) AS k FROM prim p JOIN corpus c ON c.id = p.id)"
COMPLETION = "t0 AS (SELECT a.query_id, l.id, 0 AS tier, a.o1, l.id AS o2 FROM (SELECT query_id, doc, dieu, min(pos) AS o1 FROM here GROUP BY 1, 2, 3) a JOIN law l ON l.doc = a.doc AND l.dieu = a.dieu AND contains(lower(l.content), 'hình thức xử phạt bổ sung'))"
NEAR = "t1 AS (SELECT h.query_id, c.id, 1 AS tier, h.pos AS o1, c.id AS o2 FROM here h JOIN corpus c ON c.doc = h.doc AND c.dieu = h.dieu AND abs(CAST(c.khoan AS INTEGER) - h.k) BETWEEN 1 AND 2)"
BASE = (CORPUS, LAW, CHUNKS, HERE)


def _primaries(spark, d):
    return chunks(spark, d).where("pos <= 5").select("query_id", "id", "pos", "score")


@query("SELECT query_id, id, o1 FROM t0", *BASE, COMPLETION)
def siblings_completion(spark, d):
    return N.completion_siblings(_primaries(spark, d), law_corpus(spark, d)).select("query_id", "id", "o1")


@query("SELECT query_id, id, o1 FROM t1", *BASE, NEAR)
def siblings_neighbors(spark, d):
    return N.neighbour_siblings(_primaries(spark, d), corpus(spark, d)).select("query_id", "id", "o1")


@query(
    """SELECT query_id, id, pos::BIGINT AS pos, score, false AS is_sibling FROM prim UNION ALL SELECT s.query_id, s.id, 5 + row_number() OVER (PARTITION BY s.query_id ORDER BY s.o), 0.0, true
    FROM (SELECT query_id, id, min((tier, o1, o2)) AS o FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1) t WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.query_id = t.query_id AND p.id = t.id) GROUP BY 1, 2) s""",
    *BASE,
    COMPLETION,
    NEAR,
)
def siblings_all(spark, d):
    return N.with_siblings(_primaries(spark, d), law_corpus(spark, d)).withColumn("pos", F.col("pos").cast("long"))


LOOKUPS = "(1, 'src0', '1', NULL, NULL), (2, 'src0', '1', '2', NULL), (3, 'src1', '1', '1', 'A'), (4, 'src2', 'x', NULL, NULL), (5, 'src3', '1', '', ''), (6, 'src4', '2', '3', 'c'), (7, 'none', '1', NULL, NULL)"


@query(f"SELECT r.ref, c.id FROM (VALUES {LOOKUPS}) AS r(ref, doc, dieu, khoan, diem) JOIN corpus c ON c.doc = r.doc AND c.dieu = try_cast(r.dieu AS INTEGER) AND (coalesce(r.khoan, '') = '' OR r.khoan = c.khoan) AND (coalesce(r.diem, '') = '' OR lower(r.diem) = c.diem)", CORPUS)
def location_lookup(spark, d):
    return N.lookup(values(spark, LOOKUPS, "ref, doc, dieu, khoan, diem"), corpus(spark, d)).select("ref", "id")


TEXTS = "CASE id % 6 WHEN 0 THEN 'điểm h khoản 14 Điều 32' WHEN 1 THEN 'Điều 6 Khoản 9 Điều 7 Khoản 7' WHEN 2 THEN concat('theo Điều ', id % 9 + 1, '. Điểm đ khoản ', id % 4 + 1, ' và khoản 2 của Điều 8') WHEN 3 THEN 'khoản 1. Điều 5' WHEN 4 THEN concat('diem b khoan ', id % 5 + 1, ' dieu ', id % 3 + 1, '; điểm c khoản 1') ELSE substring(text, 1, 60) END"
ONE = f"'{REF_POINT}\\s+{REF_CLAUSE}(?:[^.]{{0,40}}?{REF_ARTICLE})?'"
TWO = f"'{REF_CLAUSE}[^.]{{0,40}}?{REF_ARTICLE}'"


def refs_sql(source: str, key: str, doc: str, name: str = "refs") -> str:
    return f"""{name}0 AS (SELECT {key}, lower(t) AS t FROM {source}),
{name}1 AS (SELECT {key}, 0 AS p, unnest(range(len(a))) AS k, unnest(a) AS x, unnest(b) AS y, unnest(c) AS z, nullif(regexp_extract(t, '{REF_ARTICLE}', 1), '') AS f FROM (SELECT {key}, t, regexp_extract_all(t, {ONE}, 1) AS a, regexp_extract_all(t, {ONE}, 2) AS b, regexp_extract_all(t, {ONE}, 3) AS c FROM {name}0)),
{name}2 AS (SELECT {key}, 1 AS p, unnest(range(len(b))) AS k, unnest(b) AS y, unnest(c) AS z FROM (SELECT {key}, regexp_extract_all(t, {TWO}, 1) AS b, regexp_extract_all(t, {TWO}, 2) AS c FROM {name}0)),
{name}3 AS (SELECT {key}, p, k, CAST(coalesce(nullif(z, ''), f) AS INTEGER) AS dieu, y AS khoan, x AS diem FROM {name}1 UNION ALL SELECT {key}, p, k, CAST(z AS INTEGER), y, NULL FROM {name}2),
{name}4 AS (SELECT *, row_number() OVER (PARTITION BY {key}, dieu, khoan, diem ORDER BY p, k) AS rn FROM {name}3 WHERE dieu IS NOT NULL),
{name} AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY p, k) - 1)::INTEGER AS ref_no, '{doc}' AS doc, dieu, khoan, diem FROM {name}4 WHERE rn = 1)"""


@query("SELECT * FROM refs", f"texts AS (SELECT id, {TEXTS} AS t FROM (SELECT doc_id AS id, text FROM documents))", refs_sql("texts", "id", "168/2024/NĐ-CP"))
def legal_refs(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id AS id", "text").withColumn("t", F.expr(TEXTS))
    return N.references(t, "t", ("id",))


ASKING = "CASE query_id % 3 WHEN 0 THEN concat('điểm b khoản ', query_id % 5 + 1, ' Điều 1') WHEN 1 THEN 'khoản 2 Điều 1' ELSE text END"
LOOKED = """found AS (SELECT r.query_id, c.id, min(r.ref_no) AS ref_no FROM {refs} r JOIN corpus c ON c.doc = r.doc AND c.dieu = r.dieu AND r.khoan = c.khoan AND (r.diem IS NULL OR r.diem = c.diem) WHERE NOT EXISTS (SELECT 1 FROM chunks k WHERE k.query_id = r.query_id AND k.id = c.id) GROUP BY 1, 2)"""
ADDED = "SELECT query_id, id, pos::BIGINT AS pos, score, is_sibling FROM chunks UNION ALL SELECT query_id, id, 14 + row_number() OVER (PARTITION BY query_id ORDER BY ref_no, id), 0.0, false FROM found"


@query(ADDED, CORPUS, QUESTIONS, CHUNKS, f"asking AS (SELECT query_id, {ASKING} AS t FROM queries)", refs_sql("asking", "query_id", "src3"), LOOKED.format(refs="refs"))
def ref_pass(spark, d):
    q = queries(spark, d).withColumn("t", F.expr(ASKING))
    return N.append_lookups(chunks(spark, d), N.references(q, "t", ("query_id",), "src3"), corpus(spark, d)).withColumn("pos", F.col("pos").cast("long"))


XREF = """top5 AS (SELECT k.query_id, string_agg(l.content, ' ' ORDER BY k.pos) AS t FROM chunks k JOIN law l ON l.id = k.id WHERE k.pos <= 5 GROUP BY 1)"""
XOPEN = """xrefs AS (SELECT * FROM refs r WHERE ref_no < 15 AND NOT EXISTS (SELECT 1 FROM chunks k JOIN corpus c ON c.id = k.id WHERE k.query_id = r.query_id AND c.doc = r.doc AND c.dieu = r.dieu))"""
XCUT = """opened AS (SELECT query_id, ref_no FROM (SELECT query_id, ref_no, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY ref_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT query_id, ref_no, count(*) AS n FROM found GROUP BY 1, 2)) WHERE before < 30)"""


@query(ADDED + " JOIN opened USING (query_id, ref_no)", CORPUS, LAW, CHUNKS, XREF, refs_sql("top5", "query_id", "src3"), XOPEN, LOOKED.format(refs="xrefs"), XCUT)
def xref_pass(spark, d):
    return N.append_cross_references(chunks(spark, d), law_corpus(spark, d), "src3").withColumn("pos", F.col("pos").cast("long"))


#: More hits, crowded in few clauses.
CROWD = "crowd AS (SELECT query_id, id % (SELECT count(*) FROM documents) AS id, pos, score, is_sibling FROM (SELECT item_id AS query_id, item_id * 7 + pos * 20 + CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END AS id, CAST(pos AS INTEGER) AS pos, round(1.0::DOUBLE / (60 + pos), 6) AS score, pos % 6 = 0 AS is_sibling FROM benchmark, (SELECT unnest(range(1, 31)) AS pos)))"


def _crowd(spark, d):
    size = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("size"))
    df = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("pos")).crossJoin(F.broadcast(size))
    return df.selectExpr("query_id", "(query_id * 7 + pos * 20 + CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END) % size AS id", "pos", "round(1.0D / (60 + pos), 6) AS score", "pos % 6 = 0 AS is_sibling")


@query(
    """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY is_sibling, pos)::INTEGER AS pos, score, is_sibling FROM (
     SELECT query_id, id, pos, score, is_sibling FROM n WHERE n <= 5 UNION ALL
     SELECT x.query_id, x.id, x.pos, x.score, true FROM crowd x LEFT JOIN (SELECT query_id, pos AS end_pos FROM n WHERE n = 5) e ON e.query_id = x.query_id WHERE x.is_sibling AND (e.end_pos IS NULL OR x.pos < e.end_pos))""",
    CORPUS,
    CROWD,
    "c AS (SELECT x.*, row_number() OVER (PARTITION BY x.query_id, doc, dieu, khoan ORDER BY pos) AS c FROM crowd x JOIN corpus USING (id) WHERE NOT is_sibling)",
    "n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM c WHERE c <= 3)",
)
def diversity_cap(spark, d):
    return N.diversify(_crowd(spark, d), corpus(spark, d), target=5).select("query_id", "id", F.col("pos").cast("int").alias("pos"), "score", "is_sibling")


@query(
    """SELECT query_id, id, pos::BIGINT AS pos, score, is_sibling FROM chunks UNION ALL SELECT query_id, id, 14 + row_number() OVER (PARTITION BY query_id ORDER BY o1, id), 0.0, true FROM (
     SELECT a.query_id, p.id, min(a.o1) AS o1 FROM (SELECT k.query_id, c.doc, c.dieu, c.khoan, min(k.pos) AS o1 FROM chunks k JOIN corpus c ON c.id = k.id WHERE c.level = 3 GROUP BY 1, 2, 3, 4) a
     JOIN corpus p ON p.doc = a.doc AND p.dieu = a.dieu AND p.khoan = a.khoan AND p.level = 2 AND length(p.content) <= 1500 WHERE NOT EXISTS (SELECT 1 FROM chunks k WHERE k.query_id = a.query_id AND k.id = p.id) GROUP BY 1, 2)""",
    CORPUS,
    CHUNKS,
)
def parent_pull(spark, d):
    return N.pull_parents(chunks(spark, d), corpus(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT query_id, {INTENT_SQL} IN ('penalty', 'mixed') AND count(DISTINCT (doc, dieu, khoan)) FILTER (WHERE NOT is_sibling) >= 2 AS multi_frame FROM (SELECT * FROM chunks WHERE pos <= 2) JOIN corpus USING (id) GROUP BY query_id", CORPUS, CHUNKS)
def multi_frame(spark, d):
    got = N.multi_frame(chunks(spark, d).where("pos <= 2"), corpus(spark, d), F.lit("penalty"))
    asks = with_intent(queries(spark, d)).select("query_id", "intent")
    return got.join(asks, "query_id").select("query_id", (F.col("multi_frame") & F.col("intent").isin("penalty", "mixed")).alias("multi_frame"))


@query("SELECT query_id, string_agg(c, ',' ORDER BY c) AS clauses FROM (SELECT DISTINCT query_id, 'Đ' || dieu || 'K' || khoan AS c FROM chunks JOIN corpus USING (id)) GROUP BY 1", CORPUS, CHUNKS)
def khoan_set(spark, d):
    return N.clause_sets(chunks(spark, d), corpus(spark, d))


WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in JUDGE_STOPWORDS) + "], w)))"


@query(
    f"""SELECT q.query_id, CASE WHEN t.query_id IS NULL THEN 0.0::DOUBLE ELSE t.s END AS confidence, coalesce(t.s >= 2, false) AS passed FROM queries q LEFT JOIN (
      SELECT q.query_id, 1.0::DOUBLE + CASE WHEN r.first >= 0.010 THEN 1 ELSE 0 END + CASE WHEN r.shared THEN 1 ELSE 0 END + CASE {INTENT_SQL.replace('query_id', 'q.query_id')}
        WHEN 'penalty' THEN CASE WHEN regexp_matches(r.t, {re2(MONEY)}) THEN 2 ELSE -1.5 END + CASE WHEN regexp_matches(r.t, {re2(LEGAL_REF)}) THEN 0.5 ELSE 0 END
        WHEN 'fault' THEN CASE WHEN regexp_matches(r.t, {re2(RULE_WORDS)}) THEN 1.5 ELSE 0 END
        WHEN 'procedure' THEN CASE WHEN regexp_matches(r.t, {re2(PROCEDURE_WORDS)}) THEN 1.5 ELSE 0 END
        WHEN 'mixed' THEN CASE WHEN regexp_matches(r.t, {re2(MONEY)}) OR regexp_matches(r.t, {re2(RULE_WORDS)}) THEN 1.5 ELSE 0 END ELSE 0 END AS s
      FROM queries q JOIN (SELECT p.query_id, min(CASE WHEN n = 1 THEN score END) AS first, string_agg(l.content, ' ' ORDER BY n) AS t, bool_or(len(list_intersect({WORDS.format("qq.text")}, {WORDS.format("l.content")})) > 0) AS shared
        FROM p JOIN law l ON l.id = p.id JOIN queries qq ON qq.query_id = p.query_id WHERE n <= 3 GROUP BY 1) r ON r.query_id = q.query_id) t ON t.query_id = q.query_id""",
    CORPUS,
    LAW,
    QUESTIONS,
    CHUNKS,
    "p AS (SELECT query_id, id, score * CASE WHEN query_id % 4 = 1 THEN 0.1 ELSE 1 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM chunks WHERE NOT is_sibling)",
)
def confidence_judge(spark, d):
    hits = chunks(spark, d).withColumn("score", F.expr("score * CASE WHEN query_id % 4 = 1 THEN 0.1D ELSE 1 END"))
    return N.judge(hits, law_corpus(spark, d), with_intent(queries(spark, d)))


BROAD = "CASE query_id % 5 WHEN 0 THEN 'Các Trường Hợp nào' WHEN 1 THEN 'khi nào thì' WHEN 2 THEN 'xkhi nàox' WHEN 3 THEN 'danh sách' ELSE text END"


@query("SELECT query_id, regexp_matches(lower(t), '(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(BROAD_PHRASES) + f")(?:$|[^\\p{{L}}\\p{{N}}_])') AS broad FROM (SELECT query_id, {BROAD} AS t FROM queries)", QUESTIONS)
def broad_query(spark, d):
    q = queries(spark, d).withColumn("t", F.expr(BROAD))
    return q.select("query_id", N.is_broad(F.col("t"), F.lit("")).alias("broad"))


@query("SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 25 ELSE 15 END AS top_k, greatest(8, (CASE WHEN query_id % 2 = 0 THEN 25 ELSE 15 END) // greatest(query_id % 7, 1) + 2)::INTEGER AS per_query FROM queries", QUESTIONS)
def budget(spark, d):
    k = N.top_k_of(F.col("query_id") % 2 == 0)
    return queries(spark, d).select("query_id", k.alias("top_k"), N.budget(k, F.col("query_id") % 7).cast("int").alias("per_query"))


@query(f"SELECT doc_id, array_to_string(list_sort({WORDS.format('text')}), ' ') AS tokens FROM documents")
def content_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(N.judge_words(F.col("text"))), " ").alias("tokens"))
