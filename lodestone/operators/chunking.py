"""Hierarchical chunking: articles, clauses, points, and the rules that say how deep to go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.fixed import ARTICLE_MOST, ARTICLE_START, CHUNK_LEAST, CLAUSE_MOST, CLAUSE_MOST_DECREE, CLAUSE_START, FORM_NOISE, GENERAL_TOPIC, INTRO_TITLE, POINT_LEAST, POINT_START, UNKNOWN, java
from lodestone.operators.text import refine, strip, style_penalties, token_estimate

#: Stands before every start before the text is cut there; it occurs in no text.
MARK = "\ue000"


def holding(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs (a, b) of names, a of outer and b of inner (single columns, distinct) where a holds b. The parts of a that are as
    long as any b are joined by equality, so that no name is held against all others; they are as many as a has letters,
    for each length that occurs (names, not texts)."""
    a, b = outer.toDF("a").where("a IS NOT NULL"), inner.toDF("b").where("b IS NOT NULL")
    sizes = sorted(r.n for r in b.select(F.length("b").alias("n")).distinct().collect())
    parts = F.transform(F.array(*[F.lit(n) for n in sizes if n]).cast("array<int>"), lambda n: F.when(F.length("a") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("a") - n + 1, F.lit(1))), lambda i: F.substring("a", i, n))).otherwise(F.array().cast("array<string>")))
    pairs = a.select("a", F.explode(F.array_distinct(F.flatten(parts))).alias("b")).join(b, "b").select("a", "b")
    return pairs.unionByName(a.withColumn("b", F.lit(""))) if sizes and not sizes[0] else pairs


def resolve_metadata(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (stem); rules (key, ordinal, doc_id, title, issuer, status, effective_date, topic). The rule of that
    name, else the first one whose name holds the stem or is held by it, else a default record."""
    fields = ["doc_id", "title", "issuer", "status", "effective_date", "topic"]
    stems, keys = files.select("stem").distinct().withColumn("__s", F.lower("stem")), rules.withColumn("__k", F.lower("key"))
    s, k = stems.select("__s").distinct(), keys.select("__k").distinct()
    met = holding(s, k).toDF("__s", "__k").unionByName(holding(k, s).toDF("__k", "__s")).distinct()
    found = stems.join(met, "__s").join(keys, "__k").select("stem", "key", "ordinal", *fields)
    best = found.groupBy("stem").agg(F.min_by(F.struct(*fields), F.struct(F.when(F.col("key") == F.col("stem"), 0).otherwise(1), "ordinal")).alias("m"))
    default = {"doc_id": F.col("stem"), "title": F.col("stem"), "issuer": F.lit(UNKNOWN), "status": F.lit("active"), "effective_date": F.lit(UNKNOWN), "topic": F.lit(GENERAL_TOPIC)}
    return files.join(best, "stem", "left").select(files["*"], *[F.when(F.col("m").isNotNull(), F.col(f"m.{f}")).otherwise(default[f]).alias(f) for f in fields])


def split_articles(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lines (keys, pos, line) -> keys, article_no (order), dieu, dieu_title, body. Lines before the first
    heading are article 0; a heading belongs to its body."""
    by = Window.partitionBy(*keys).orderBy("pos")
    head = strip(F.col("line")).rlike(java(ARTICLE_START))
    part = lambda k: F.regexp_extract(strip(F.col("line")), java(ARTICLE_START), k)
    df = lines.withColumn("__head", head).withColumn("article_no", F.sum(F.col("__head").cast("int")).over(by))
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return df.groupBy(*keys, "article_no").agg(
        F.coalesce(F.min(F.when(F.col("__head"), part(1))), F.lit("0")).alias("dieu"),
        F.coalesce(F.min(F.when(F.col("__head"), strip(part(2)))), F.lit(INTRO_TITLE)).alias("dieu_title"),
        F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"),
    )


def clauses_of(body: Column) -> Column:
    """array<struct<khoan, text>> in order: what stands before the first clause is clause 0 unless blank; a body
    without clauses is clause 0 as a whole."""
    parts = F.split(F.regexp_replace(body, CLAUSE_START, MARK + "$1."), MARK)
    cut = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)\.", 1).alias("khoan"), x.alias("text")))
    intro = F.filter(F.array(F.struct(F.lit("0").alias("khoan"), strip(F.get(parts, F.lit(0))).alias("text"))), lambda x: x["text"] != "")
    return F.when(F.size(parts) <= 1, F.array(F.struct(F.lit("0").alias("khoan"), body.alias("text")))).otherwise(F.concat(intro, cut))


def count_points(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(POINT_START), F.lit(1)))


def points_of(text: Column) -> Column:
    """array<struct<diem, text>> in order: the preamble is a row of its own and stands before every point."""
    parts = F.split(F.regexp_replace(text, POINT_START, MARK + "$1)"), MARK)
    preamble = strip(F.get(parts, F.lit(0)))
    point = lambda x: F.struct(F.substring(x, 1, 1).alias("diem"), F.concat(F.when(preamble != "", F.concat(preamble, F.lit("\n"))).otherwise(""), strip(x)).alias("text"))
    cut = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), point)
    intro = F.filter(F.array(F.struct(F.lit("").alias("diem"), preamble.alias("text"))), lambda x: x["text"] != "")
    return F.when(F.size(parts) <= 1, F.array(F.struct(F.lit("").alias("diem"), text.alias("text")))).otherwise(F.concat(intro, cut))


def chunk_levels(articles: DataFrame, doc_type: str = "doc_type") -> DataFrame:
    """articles' rows as chunks of level 1, 2 or 3, by size: with khoan, diem, level, text, and clause_no and
    point_no that give their order. All but the source row's own columns are made in one projection chain."""
    own = [F.col(f"`{c}`") for c in articles.columns if c != "body"]
    sized = articles.withColumn("__n", token_estimate(F.col("body"))).where(F.col("__n") >= CHUNK_LEAST)
    whole = sized.where(F.col("__n") <= ARTICLE_MOST).select(*own, F.lit(None).cast("string").alias("khoan"), F.lit(None).cast("string").alias("diem"), F.lit(1).alias("level"), F.col("body").alias("text"), F.lit(0).alias("clause_no"), F.lit(0).alias("point_no"))
    clauses = sized.where(F.col("__n") > ARTICLE_MOST).select(*own, F.posexplode(clauses_of(F.col("body"))).alias("clause_no", "c"))
    clauses = clauses.select(*own, "clause_no", F.nullif(F.col("c.khoan"), F.lit("0")).alias("khoan"), F.col("c.text").alias("text")).withColumn("__n", token_estimate(F.col("text"))).where(F.col("__n") >= CHUNK_LEAST)
    decree = F.col(doc_type) == "nghidinh"
    deep = (F.col("__n") > F.when(decree, CLAUSE_MOST_DECREE).otherwise(CLAUSE_MOST)) | (decree & (count_points(F.col("text")) >= 2))
    second = clauses.where(~deep).select(*own, "khoan", F.lit(None).cast("string").alias("diem"), F.lit(2).alias("level"), "text", "clause_no", F.lit(0).alias("point_no"))
    points = clauses.where(deep).select(*own, "khoan", "clause_no", F.posexplode(points_of(F.col("text"))).alias("point_no", "p"))
    third = points.select(*own, "khoan", F.nullif(F.col("p.diem"), F.lit("")).alias("diem"), F.lit(3).alias("level"), F.col("p.text").alias("text"), "clause_no", "point_no").where(token_estimate(F.col("text")) >= POINT_LEAST)
    return whole.unionByName(second).unionByName(third)


def is_form_noise(content: Column) -> Column:
    t = F.lower(content)
    return F.exists(F.array(*[F.lit(k) for k in FORM_NOISE]), lambda k: F.contains(t, k))


def dedup_first(df: DataFrame, keys: tuple[str, ...], content: str, order: tuple[str, ...]) -> DataFrame:
    """The first row of each content within its document."""
    by = Window.partitionBy(*keys, F.md5(F.col(content).cast("binary"))).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def chunk_id(doc_id: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    slug = F.translate(doc_id, "/-", "__")
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name), c)).otherwise("")
    return F.concat(slug, F.lit("_dieu"), dieu, part("_khoan", khoan), part("_diem", diem))


def with_content(parts: DataFrame) -> DataFrame:
    """parts (text, title, dieu, dieu_title, warning) with content: repaired and styled text behind its context
    line and its document's warning. Every step is a column, so none is evaluated twice."""
    df = parts.withColumn("__r", refine(F.col("text"))).withColumn("__b", style_penalties(F.col("__r")))
    df = df.withColumn("__x", F.concat(F.lit("Văn bản: "), "title", F.lit(" | Điều "), "dieu", F.lit(": "), "dieu_title"))
    df = df.withColumn("__c", F.when((F.col("dieu") != "0") & ~F.startswith("__b", "__x"), F.concat("__x", F.lit("\n"), "__b")).otherwise(F.col("__b")))
    warned = (F.coalesce("warning", F.lit("")) != "") & ~F.startswith("__c", F.lit(">"))
    return df.withColumn("content", F.when(warned, F.concat(F.lit("> ⚠️ "), "warning", F.lit("\n\n"), "__c")).otherwise(F.col("__c"))).drop("__r", "__b", "__x", "__c")


def build_chunks(parts: DataFrame) -> DataFrame:
    """Parts of chunk_levels, with doc_id, title and warning, as chunks: without form noise, each content once
    a document, in order."""
    df = with_content(parts)
    df = df.withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), F.col("dieu"), F.col("khoan"), F.col("diem")))
    # noise depends on the content alone, so it may go after the copies; before, the filter would be pushed below
    # the steps that make the content, and make it once more
    df = dedup_first(df, ("doc_id",), "content", ("article_no", "clause_no", "point_no"))
    return df.where(~is_form_noise(F.col("content"))).withColumn("token_estimate", token_estimate(F.col("content")))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Counts and sizes in all, by document type, and by level."""
    out = chunks.groupingSets([[], [F.col("doc_type")], [F.col("level")]], "doc_type", "level").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_estimate").alias("tokens"), F.max("token_estimate").alias("most"), F.grouping_id().alias("grouping"))
    return out


def upsert_latest(points: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key, the row of the highest version: what an upsert leaves."""
    by = Window.partitionBy(key).orderBy(F.col(version).desc())
    return points.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")
