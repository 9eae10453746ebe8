"""Queries of readers and writers: what is written to the shared folder comes back as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.plans.base import CORPUS, corpus, query, table
from lodestone.sources import chunks as S
from lodestone.sources.collection import Collection
from lodestone.sources.scratch import fresh_path


def _page_files(spark, d):
    folder = fresh_path(spark, "pdf")
    S.write_files(table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("body")), folder)
    return folder


def page_texts(content: bytes) -> list[tuple[int, str]]:
    """A stand-in for a PDF reader: a page ends with each closed paragraph."""
    return [(n, t) for n, t in enumerate(content.decode().split("</p>"))]


def page_tables(content: bytes) -> list[tuple[int, list[list[str | None]]]]:
    """A stand-in for a table reader: one table of paragraphs by their tags."""
    return [(1, [line.split(">") for line in content.decode().split("</p>")])]


@query("SELECT page_id || '.pdf' AS file, unnest(range(len(t)))::INTEGER AS page_no, unnest(t) AS text FROM (SELECT page_id, string_split(html, '</p>') AS t FROM pages)")
def pdf_scan(spark, d):
    return S.read_pdfs(spark, _page_files(spark, d), page_texts)


@query("SELECT page_id || '.pdf#1#0' AS tbl, r::INTEGER AS \"row\", unnest(range(len(c)))::INTEGER AS col, unnest(c) AS cell FROM (SELECT page_id, r, string_split(l, '>') AS c FROM (SELECT page_id, unnest(range(len(t))) AS r, unnest(t) AS l FROM (SELECT page_id, string_split(html, '</p>') AS t FROM pages)))")
def pdf_tables(spark, d):
    return S.read_pdf_tables(spark, _page_files(spark, d), page_tables)


@query("SELECT topic AS doc_type, 'c' || id AS stem, '---' || chr(10) || 'chunk_id: \"c' || id || '\"' || chr(10) || 'level: ' || level || chr(10) || '---' || chr(10) || chr(10) || content AS text FROM corpus", CORPUS)
def markdown_round_trip(spark, d):
    """Chunks as Markdown files in folders by topic, written and read back."""
    folder = fresh_path(spark, "markdown")
    c = corpus(spark, d).withColumn("chunk_id", F.concat(F.lit("c"), F.col("id").cast("string")))
    files = S.markdown_files(c.select("chunk_id", "level", "topic", "content"), "topic")
    S.write_files(files.select(F.concat_ws("/", "topic", "file_name").alias("name"), "body"), folder)
    return S.read_markdown(spark, folder)


@query("SELECT 'c' || id AS chunk_id, doc AS doc_id, dieu, khoan, diem, level::INTEGER AS level, status, topic, content FROM corpus", CORPUS)
def chunk_round_trip(spark, d):
    """Chunks as JSON lines, written and read back with ids from 0 on."""
    path = fresh_path(spark, "chunks")
    c = corpus(spark, d)
    S.write_chunks(c.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.col("doc").alias("doc_id"), "dieu", "khoan", "diem", "level", "status", "topic", "content"), path)
    return S.read_chunks(spark, path).select("chunk_id", "doc_id", "dieu", "khoan", "diem", "level", "status", "topic", "content")


@query("SELECT min(id) AS first_id, max(id) AS last_id, count(*)::BIGINT AS n FROM corpus", CORPUS)
def chunk_ids(spark, d):
    """The ids that a reader gives are 0 to the number of chunks less one, each once."""
    path = fresh_path(spark, "chunks")
    S.write_chunks(corpus(spark, d).select(F.col("doc").alias("doc_id"), "content"), path)
    return S.read_chunks(spark, path).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("n"))


@query("SELECT id, doc, level, (SELECT count(*) FROM corpus)::BIGINT AS n FROM corpus", CORPUS)
def points_table(spark, d):
    """A collection that is made once, left alone by a second making, and loaded anew."""
    name, c = f"points_{uuid.uuid4().hex}", corpus(spark, d).select("id", "doc", "level")
    path = fresh_path(spark, "points")
    S.create_points(c.withColumn("level", F.col("level") + 1), name, path=path)
    S.create_points(c.where("false"), name, path=path)
    made = spark.table(name).count()
    index = fresh_path(spark, "index")
    loaded = S.load_index(c, f"{name}_index", index)
    schema = spark.table(f"{name}_index").schema
    for table in (name, f"{name}_index"):  # files stay where they are
        spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(schema).parquet(index).select("id", "doc", "level", F.lit(min(made, loaded)).cast("long").alias("n"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'repealed' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'changed: ' || content ELSE content END AS content FROM corpus UNION ALL SELECT id + 1000000000000, status, content FROM corpus WHERE id % 7 = 0", CORPUS)
def collection_merge(spark, d):
    """A collection by key, then changed and new chunks merged into the buckets that they fall in."""
    c = corpus(spark, d).select("id", "status", "content")
    made = Collection(spark, fresh_path(spark, "collection"))
    made.create(c, "id", spark.sparkContext.defaultParallelism)
    changed = c.where("id % 5 = 0").select("id", F.lit("repealed").alias("status"), F.concat(F.lit("changed: "), "content").alias("content"))
    made.merge(changed.unionByName(c.where("id % 7 = 0").withColumn("id", F.col("id") + 1_000_000_000_000)))
    return made.read()
