"""Queries of retrieval, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.fixed import STOPWORDS
from lodestone.functions.models import embed, overlap_scorer, passage_prefix, query_prefix
from lodestone.operators import docblocks as B
from lodestone.operators import conversation as E
from lodestone.operators import enrich as N
from lodestone.operators import retrieval as R
from lodestone.plans.base import CORPUS, LAW, QUESTIONS, corpus, law_corpus, queries, query, table
from lodestone.sources.scratch import kept
from lodestone.sources.tables import spread

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tok(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


POST = f"""post AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM (SELECT id, {tok("content")} AS t FROM corpus)) GROUP BY 1, 2, 3)"""
IDF = """stats AS MATERIALIZED (SELECT (SELECT count(*) FROM corpus) AS n_docs, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM corpus)::DOUBLE AS avgdl),
rawidf AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n_docs FROM stats) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post GROUP BY 1),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END AS idf FROM rawidf)"""
#: For the weights of terms alone: terms are counted by document, without their places.
DFS = f"""dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tok("text")})) AS term FROM documents) GROUP BY 1),
raws AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs CROSS JOIN (SELECT count(*) AS n FROM documents) c)"""
SCORED = f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok("text")}) AS term FROM queries) GROUP BY 1, 2),
scored AS MATERIALIZED (SELECT q.query_id, p.id, round(sum(q.qtf * i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl))), 6) AS score FROM post p JOIN qt q ON q.term = p.term JOIN idf i ON i.term = p.term, stats s GROUP BY 1, 2)"""


def bm25_sql(allowed: str = "corpus", name: str = "bm25") -> str:
    return f"{name} AS (SELECT query_id, id, score, rank FROM (SELECT q.query_id, c.id, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0) DESC, c.id)::INTEGER AS rank FROM queries q CROSS JOIN {allowed} c LEFT JOIN scored s ON s.query_id = q.query_id AND s.id = c.id) WHERE rank <= 30)"


BM25 = (CORPUS, QUESTIONS, POST, IDF, SCORED, bm25_sql())
DENSE = """dense AS (SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INTEGER AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 30)"""
#: Documents and questions as hashed vectors, so that both lists rank documents.
MD5S = "list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: md5(w))"
SIGNED = "list_transform(list_filter(h, lambda x: (('0x' || substr(x, 15, 2))::INTEGER >= 128) = {0}), lambda x: ('0x' || substr(x, 1, 2))::INTEGER % 64)"
HASHED = f"""md5s AS MATERIALIZED (SELECT 'd' AS kind, id, {MD5S.format("content")} AS h FROM corpus UNION ALL SELECT 'q', query_id, {MD5S.format("text")} FROM queries),
signs AS MATERIALIZED (SELECT kind, id, {SIGNED.format("true")} AS up, {SIGNED.format("false")} AS down FROM md5s),
raw_vec AS MATERIALIZED (SELECT kind, id, list_transform(range(64), lambda i: (len(list_filter(up, lambda x: x = i)) - len(list_filter(down, lambda x: x = i)))::DOUBLE) AS v FROM signs),
vec AS MATERIALIZED (SELECT kind, id, list_transform(v, lambda x: (x / greatest(n, 1e-12::DOUBLE))::FLOAT)::DOUBLE[] AS v FROM (SELECT kind, id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw_vec)),
dense AS MATERIALIZED (SELECT query_id, id, score, rank FROM (SELECT q.id AS query_id, d.id, round(list_dot_product(d.v, q.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(d.v, q.v), 6) DESC, d.id)::INTEGER AS rank FROM vec d, vec q WHERE d.kind = 'd' AND q.kind = 'q') WHERE rank <= 30)"""


@query(f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize(spark, d):
    t = R.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("SELECT id, dl::INTEGER AS dl, term, tf::BIGINT AS tf FROM post", CORPUS, POST)
def bm25_postings(spark, d):
    return R.postings(corpus(spark, d)).select("id", "dl", "term", "tf")


@query("SELECT term, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END, 6) AS idf FROM raws", DFS)
def bm25_idf(spark, d):
    c = table(spark, d, "documents").select("text")
    stats = c.agg(F.count(F.lit(1)).alias("n_docs"))
    return R.term_weights(R.document_frequencies(c, "text"), stats).select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark, d):
    """The index of the documents, whose ids and texts are the corpus's: built by the first query that needs it, opened by
    all others."""
    source = spark.read.parquet(f"{d}/documents.parquet")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return B.open_blocks(spark, kept(spark, "bm25", [source], lambda path: B.write_blocks(docs, path)))


@query("SELECT * FROM bm25", *BM25)
def bm25_topk(spark, d):
    return B.topk(_index(spark, d), queries(spark, d))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("SELECT * FROM dense", DENSE)
def dense_topk(spark, d):
    return R.dense_topk(*_vectors(spark, d))


@query()
def ann_topk(spark, d):
    """No SQL: what an approximate index finds isn't for SQL to say. Its recall is tested against dense_topk."""
    vectors, asked = _vectors(spark, d)
    return R.ann_topk(R.vector_index(vectors), asked)


ALLOWED = "allowed AS (SELECT * FROM corpus WHERE status = 'active' AND topic = 'en' AND doc NOT IN ('src1', 'src2'))"


@query("SELECT * FROM bm25f", CORPUS, QUESTIONS, POST, IDF, SCORED, ALLOWED, bm25_sql("allowed", "bm25f"))
def filtered_search(spark, d):
    return B.topk(_index(spark, d), queries(spark, d), allowed=_allowed(corpus(spark, d)))


def _allowed(c):
    return R.filtered(c, topic="en", not_docs=("src1", "src2"))


ASKED = "CASE query_id % 3 WHEN 0 THEN 'Xe KHÔNG KINH DOANH vận tải: ' WHEN 1 THEN 'xe kinh doanh: ' ELSE '' END || text"


@query(f"SELECT query_id, CASE WHEN contains(lower({ASKED}), 'không kinh doanh') THEN 'given,Kinh doanh vận tải' ELSE 'given' END AS not_topics, CASE WHEN contains(lower({ASKED}), 'không kinh doanh') THEN '10/2020/NĐ-CP' ELSE '' END AS not_docs FROM queries", QUESTIONS)
def auto_exclude(spark, d):
    q = queries(spark, d).withColumn("text", F.expr(ASKED)).withColumn("not_topics", F.array(F.lit("given")))
    return R.auto_exclude(q).select("query_id", F.array_join("not_topics", ",").alias("not_topics"), F.array_join("not_docs", ",").alias("not_docs"))


HYBRID = """both_lists AS (SELECT query_id, id, rank, 0 AS list FROM dense UNION ALL SELECT query_id, id, rank, 1 FROM bm25),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM both_lists GROUP BY 1, 2),
hybrid AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INTEGER AS rank FROM fused)"""


def _dense(spark, d):
    """The documents nearest to each question, by hashed vectors, which are made once."""
    source = spark.read.parquet(f"{d}/documents.parquet")
    path = kept(spark, "vectors", [source], lambda path: embed(corpus(spark, d).select("id", "content"), "content").select("id", "embedding").write.mode("overwrite").parquet(path + "/vectors"))
    docs = spread(spark.read.parquet(path + "/vectors"))
    return R.dense_topk(docs, embed(queries(spark, d), "text").select("query_id", "embedding"))


@query("SELECT query_id, id, score, rank FROM hybrid WHERE rank <= 10", *BM25, HASHED, HYBRID)
def rrf_hybrid(spark, d):
    return R.rrf_hybrid(_dense(spark, d), bm25_topk(spark, d), 10).select("query_id", "id", "score", "rank")


@query(
    "SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first % 1000, first)::INTEGER AS rank FROM multi) WHERE rank <= 30",
    *BM25,
    HASHED,
    ALLOWED,
    bm25_sql("allowed", "bm25f"),
    "lists AS (SELECT query_id, id, rank, 0 AS list FROM bm25 WHERE rank <= 9 UNION ALL SELECT query_id, id, rank, 1 FROM bm25f WHERE rank <= 9 UNION ALL SELECT query_id, id, rank, 2 FROM dense WHERE rank <= 9)",
    "multi AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY 1, 2)",
)
def rrf_multi(spark, d):
    parts = [bm25_topk(spark, d), filtered_search(spark, d), _dense(spark, d)]
    lists = None
    for k, p in enumerate(parts):
        p = p.where("rank <= 9").select("query_id", "id", "rank", F.lit(k).alias("list"))
        lists = p if lists is None else lists.unionByName(p)
    return R.rrf_lists(lists, 30).select("query_id", "id", "score", "rank")


SIBLINGS = """prim AS (SELECT query_id, id, rank AS pos, score FROM hybrid WHERE rank <= 5),
here AS (SELECT p.query_id, p.pos, c.doc, c.dieu, CAST(c.khoan AS INTEGER) AS k FROM prim p JOIN corpus c ON c.id = p.id),
tiers AS (SELECT a.query_id, l.id, 0 AS tier, a.o1, l.id AS o2 FROM (SELECT query_id, doc, dieu, min(pos) AS o1 FROM here GROUP BY 1, 2, 3) a JOIN law l ON l.doc = a.doc AND l.dieu = a.dieu AND contains(lower(l.content), 'hình thức xử phạt bổ sung')
 UNION ALL SELECT h.query_id, c.id, 1, h.pos, c.id FROM here h JOIN corpus c ON c.doc = h.doc AND c.dieu = h.dieu AND abs(CAST(c.khoan AS INTEGER) - h.k) BETWEEN 1 AND 2),
sib AS (SELECT query_id, id, min((tier, o1, o2)) AS o FROM tiers t WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.query_id = t.query_id AND p.id = t.id) GROUP BY 1, 2),
with_sib AS (SELECT query_id, id, pos::BIGINT AS pos, score, false AS is_sibling FROM prim UNION ALL SELECT s.query_id, s.id, n.n + row_number() OVER (PARTITION BY s.query_id ORDER BY s.o), 0.0, true FROM sib s JOIN (SELECT query_id, max(pos) AS n FROM prim GROUP BY 1) n ON n.query_id = s.query_id)"""


@query("SELECT query_id, id, pos, score, is_sibling FROM with_sib", *BM25, HASHED, HYBRID, LAW, SIBLINGS)
def hybrid_search(spark, d):
    """End to end: filters off, dense and BM25 candidates, fusion, the five best, their siblings."""
    fused = R.rrf_hybrid(_dense(spark, d), bm25_topk(spark, d), 5)
    return N.with_siblings(fused.select("query_id", "id", F.col("rank").alias("pos"), "score"), law_corpus(spark, d)).select("query_id", "id", F.col("pos").cast("long").alias("pos"), "score", "is_sibling")


WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(
    f"""SELECT query_id, id, score, rank FROM (SELECT b.query_id, b.id, round(len(list_intersect({WORDS.format("q.text")}, {WORDS.format("c.content")})) / greatest(1, len({WORDS.format("q.text")}))::DOUBLE, 6) AS score,
    row_number() OVER (PARTITION BY b.query_id ORDER BY round(len(list_intersect({WORDS.format("q.text")}, {WORDS.format("c.content")})) / greatest(1, len({WORDS.format("q.text")}))::DOUBLE, 6) DESC, b.rank)::INTEGER AS rank FROM bm25 b JOIN corpus c ON c.id = b.id JOIN queries q ON q.query_id = b.query_id) WHERE rank <= 5""",
    *BM25,
)
def rerank_topk(spark, d):
    return R.rerank(bm25_topk(spark, d), corpus(spark, d), queries(spark, d), 5, overlap_scorer)


OVERLAP = f"round(len(list_intersect({WORDS.format('q.text')}, {WORDS.format('c.content')})) / greatest(1, len({WORDS.format('q.text')}))::DOUBLE, 6)"


@query(
    f"SELECT query_id, id, score, rank FROM (SELECT h.query_id, h.id, {OVERLAP} AS score, row_number() OVER (PARTITION BY h.query_id ORDER BY {OVERLAP} DESC, h.rank)::INTEGER AS rank FROM hybrid h JOIN corpus c ON c.id = h.id JOIN queries q ON q.query_id = h.query_id WHERE h.rank <= 20) WHERE rank <= 5",
    *BM25,
    HASHED,
    HYBRID,
)
def rerank_overfetch(spark, d):
    """Five hits of twenty that are fused because they're reranked."""
    fused = R.rrf_hybrid(_dense(spark, d), bm25_topk(spark, d), R.fetch_size(5, 20, True))
    return R.rerank(fused, corpus(spark, d), queries(spark, d), 5, overlap_scorer)


@query("SELECT query_id, 'query: ' || text AS asked, 'passage: ' || text AS passage, text AS plain FROM queries", QUESTIONS)
def model_prefix(spark, d):
    """What a model of the e5 family is given, and any other one."""
    ask = lambda model: F.concat(F.lit(query_prefix(model)), "text")
    return queries(spark, d).select("query_id", ask("intfloat/multilingual-E5-small").alias("asked"), F.concat(F.lit(passage_prefix("e5-base")), "text").alias("passage"), ask("minilm").alias("plain"))


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, d):
    """Documents that hold a benchmark text."""
    return E.containing(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), queries(spark, d))


@query("SELECT g.query_id, round(count(b.id) / count(*)::DOUBLE, 6) AS recall FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.id = g.id AND b.rank <= 10 GROUP BY 1", *BM25, GOLD)
def recall_at_k(spark, d):
    return E.recall_at_k(bm25_topk(spark, d), _gold(spark, d), 10).select("query_id", F.round("recall", 6).alias("recall"))


CLAUSE_GOLD = "gc AS (SELECT DISTINCT g.query_id, c.doc, c.dieu, c.khoan FROM gold g JOIN corpus c ON c.id = g.id), hc AS (SELECT DISTINCT h.query_id, c.doc, c.dieu, c.khoan FROM with_sib h JOIN corpus c ON c.id = h.id WHERE NOT h.is_sibling AND h.pos <= 10)"


@query(
    "SELECT count(*)::BIGINT AS n_questions, round(avg(recall), 6) AS mean_recall, avg(recall) >= 0.4 AS passed FROM (SELECT gc.query_id, count(hc.doc) / count(*)::DOUBLE AS recall FROM gc LEFT JOIN hc ON hc.query_id = gc.query_id AND hc.doc = gc.doc AND hc.dieu = gc.dieu AND hc.khoan = gc.khoan GROUP BY 1)",
    *BM25,
    HASHED,
    HYBRID,
    LAW,
    SIBLINGS.replace("rank <= 5", "rank <= 10"),
    GOLD,
    CLAUSE_GOLD,
)
def recall_gate(spark, d):
    """The mean recall of the first ten hits by clause, siblings left out, against its floor."""
    c = corpus(spark, d)
    fused = R.rrf_hybrid(_dense(spark, d), bm25_topk(spark, d), 10)
    hits = N.with_siblings(fused.select("query_id", "id", F.col("rank").alias("pos"), "score"), law_corpus(spark, d))
    keys = c.select("id", "doc", "dieu", "khoan")
    gate = E.recall_gate(hits.withColumnRenamed("pos", "rank").join(keys, "id"), _gold(spark, d).join(keys, "id"), 10)
    return gate.withColumn("mean_recall", F.round("mean_recall", 6))


@query("SELECT e.query_id, coalesce(bool_or(b.id IS NOT NULL), false) AS hit FROM (SELECT DISTINCT g.query_id, d.source AS doc FROM gold g JOIN documents d ON d.doc_id = g.id) e LEFT JOIN (SELECT b.*, d.source AS doc FROM bm25 b JOIN documents d ON d.doc_id = b.id WHERE rank <= 5) b ON b.query_id = e.query_id AND b.doc = e.doc GROUP BY 1", *BM25, GOLD)
def hit_at_k(spark, d):
    docs = corpus(spark, d).select("id", "doc")
    return E.hit_at_k(bm25_topk(spark, d).join(docs, "id"), _gold(spark, d).join(docs, "id").select("query_id", "doc").distinct(), 5)


@query("SELECT g.query_id, round(coalesce(1.0::DOUBLE / min(b.rank), 0), 6) AS rr FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.id = g.id GROUP BY 1", *BM25, GOLD)
def mrr(spark, d):
    return E.reciprocal_rank(bm25_topk(spark, d), _gold(spark, d)).select("query_id", F.round("rr", 6).alias("rr"))
