"""Registration of queries, and the proxy tables that queries and their SQL share.

The test tables hold no law text. A proxy corpus gives every document a place (document, article, clause,
point), and some of them the wording of a legal text; it is stated once for Spark and once for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, name: str | None = None):
    """Registers a query by its function's name, with the SQL it is compared with, behind its common tables."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --- corpus -----------------------------------------------------------------------------------------


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id", "source AS doc", "cast(doc_id div 20 div 25 + 1 AS int) AS dieu", "cast((doc_id div 20 % 25) div 5 + 1 AS string) AS khoan",
        "CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END AS level", "CASE WHEN doc_id % 3 <> 0 THEN chr(97 + doc_id div 20 % 5) END AS diem",
        "lang AS topic", "text AS content", "CASE WHEN toxic = 1 THEN 'repealed' ELSE 'active' END AS status",
    )


CORPUS = """corpus AS (SELECT d.doc_id AS id, d.source AS doc, CAST(d.doc_id // 20 // 25 + 1 AS INTEGER) AS dieu, CAST((d.doc_id // 20 % 25) // 5 + 1 AS VARCHAR) AS khoan,
  CASE WHEN d.doc_id % 3 = 0 THEN 2 ELSE 3 END AS level, CASE WHEN d.doc_id % 3 <> 0 THEN chr(CAST(97 + d.doc_id // 20 % 5 AS INTEGER)) END AS diem,
  d.lang AS topic, d.text AS content, CASE WHEN l.toxic = 1 THEN 'repealed' ELSE 'active' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)"""

#: Legal wording in front of some documents, by id.
WORDING = """CASE {id} % 7 WHEN 0 THEN 'Hình thức xử phạt bổ sung. ' WHEN 1 THEN concat('Hành vi tại điểm ', chr(CAST(97 + {id} % 5 AS INT)), ' khoản ', {id} % 5 + 1, ' Điều ', {id} % 2 + 1, '. ') WHEN 2 THEN 'Phạt tiền từ 400.000 đồng đến 600.000 đồng. ' WHEN 3 THEN 'Phải nhường đường. ' ELSE '' END"""


def law_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).withColumn("content", F.concat(F.expr(WORDING.format(id="id")), "content"))


LAW = f"law AS (SELECT * REPLACE (concat({WORDING.format(id='id')}, content) AS content) FROM corpus)"


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUESTIONS = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
INTENTS = ("penalty", "fault", "procedure", "definition", "list", "mixed")


def with_intent(df: DataFrame) -> DataFrame:
    return df.withColumn("intent", F.element_at(F.array(*[F.lit(x) for x in INTENTS]), (F.col("query_id") % len(INTENTS) + 1).cast("int")))


INTENT_SQL = "CASE query_id % 6 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(INTENTS)) + " END"


def chunks(spark: SparkSession, d: str, n: int = 14) -> DataFrame:
    """Twelve-odd hits a question, spread over the corpus; every sixth is a sibling."""
    size = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("size"))
    df = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pos")).crossJoin(F.broadcast(size))
    return df.selectExpr("query_id", "(query_id * 37 + pos * 20 + pos div 3) % size AS id", "cast(pos AS int) AS pos", "round(1.0D / (60 + pos), 6) AS score", "pos % 6 = 0 AS is_sibling")


def chunk_sql(n: int = 14) -> str:
    return f"chunks AS (SELECT item_id AS query_id, (item_id * 37 + pos * 20 + pos // 3) % (SELECT count(*) FROM documents) AS id, CAST(pos AS INTEGER) AS pos, round(1.0::DOUBLE / (60 + pos), 6) AS score, pos % 6 = 0 AS is_sibling FROM benchmark, (SELECT unnest(range(1, {n + 1})) AS pos))"


CHUNKS = chunk_sql()

# --- lines ------------------------------------------------------------------------------------------

#: What DuckDB's trim takes off: spaces of any width, but no tab and no end of line.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: The wording that makes a document's lines read like a legal text, by position.
LINE = """CASE pos % 8 WHEN 0 THEN concat('Điều ', pos {div} 8 + 1, '. ', line) WHEN 1 THEN concat('1. N', line) WHEN 2 THEN concat('a) ', line) WHEN 3 THEN concat('b) ', lower(line), ' ngày 5 tháng 6 năm 2024')
 WHEN 4 THEN concat('2. ', line) WHEN 5 THEN lower(line) WHEN 6 THEN concat('phạt tiền từ 400.000 đồng đến 600.000 đồng CO2 ', line, '.......') ELSE CASE WHEN pos % 16 = 7 THEN concat('Trang ', pos, '/9') ELSE concat('Chương IV ', line) END END"""


def law_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, line). Lines get their wording before they're told apart, so that filters on it don't make it anew."""
    worded = F.expr(f"transform(split(text, '\\n'), (line, pos) -> btrim({LINE.format(div='div')}, '{SPACES}'))")
    return table(spark, d, "documents").select("doc_id", F.posexplode(worded).alias("pos", "line"))


RAW_LINES = "raw_lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
LAW_LINES = f"{RAW_LINES}, law_lines AS (SELECT doc_id, pos, trim({LINE.format(div='//')}) AS line FROM raw_lines)"


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")
