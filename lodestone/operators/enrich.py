"""What happens to hits after retrieval: siblings, lookups, references, diversity, parents, confidence.

A location is (doc, dieu, khoan, diem). A list of chunks is (query_id, id, pos, score, is_sibling) with pos from
1; the corpus has id, doc, dieu, khoan, diem, level and content. Reads of the corpus are equi-joins on id or on (doc,
dieu); clauses and points are compared inside an article. A corpus that is laid out by both (sources.places) isn't shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.fixed import (
    BROAD_PHRASES,
    COMPLETION_PHRASES,
    DEFAULT_DOC,
    JUDGE_STOPWORDS,
    LEGAL_REF,
    MIN_TOP_SCORE,
    MONEY,
    NEIGHBOURS,
    PARENT_CHARS,
    PASS_SCORE,
    PER_CLAUSE,
    PER_QUERY_MIN,
    PROCEDURE_WORDS,
    REF_ARTICLE,
    REF_CLAUSE,
    REF_POINT,
    RULE_WORDS,
    TOP_K,
    TOP_K_BROAD,
    XREF_ADDED,
    XREF_REFS,
    XREF_ROWS,
    java,
)
from lodestone.sources.places import Located, by_id, by_place


def completes(content: Column, phrases: tuple[str, ...] = COMPLETION_PHRASES) -> Column:
    t = F.lower(content)
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in phrases])


def completion_siblings(primaries: DataFrame, corpus: DataFrame | Located, phrases: tuple[str, ...] = COMPLETION_PHRASES) -> DataFrame:
    """(query_id, id, tier, o1, o2): the completing chunks of every article that a primary stands in. Articles
    come in the order of their first primary."""
    here = primaries.join(by_id(corpus).select("id", "doc", "dieu"), "id").where("doc <> '' AND dieu <> 0")
    articles = here.groupBy("query_id", "doc", "dieu").agg(F.min("pos").alias("o1"))
    own = by_place(corpus).where(completes(F.col("content"), phrases)).select("doc", "dieu", F.col("id"))
    return articles.join(own, ["doc", "dieu"]).select("query_id", "id", F.lit(0).alias("tier"), "o1", F.col("id").alias("o2"))


def neighbour_siblings(primaries: DataFrame, corpus: DataFrame | Located, reach: int = NEIGHBOURS) -> DataFrame:
    """(query_id, id, tier, o1, o2): the chunks of clauses 1 to reach away in the same article."""
    k = F.expr("try_cast(khoan AS int)")
    here = primaries.join(by_id(corpus).select("id", "doc", "dieu", k.alias("k")), "id").where("doc <> '' AND dieu <> 0 AND k <> 0").select("query_id", "pos", "doc", "dieu", "k")
    own = by_place(corpus).select("doc", "dieu", k.alias("__k"), "id").where("__k <> 0")
    near = F.abs(F.col("__k") - F.col("k")).between(1, reach)
    return here.join(own, ["doc", "dieu"]).where(near).select("query_id", "id", F.lit(1).alias("tier"), F.col("pos").alias("o1"), F.col("id").alias("o2"))


def with_siblings(primaries: DataFrame, corpus: DataFrame | Located, phrases: tuple[str, ...] = COMPLETION_PHRASES) -> DataFrame:
    """primaries (query_id, id, pos, score), then their siblings: score 0, each once, first emission first."""
    found = completion_siblings(primaries, corpus, phrases).unionByName(neighbour_siblings(primaries, corpus))
    once = found.groupBy("query_id", "id").agg(F.min(F.struct("tier", "o1", "o2")).alias("o")).join(primaries.select("query_id", "id"), ["query_id", "id"], "left_anti")
    n = primaries.groupBy("query_id").agg(F.max("pos").alias("n"))
    by = Window.partitionBy("query_id").orderBy("o")
    extra = once.join(n, "query_id").select("query_id", "id", (F.col("n") + F.row_number().over(by)).alias("pos"), F.lit(0.0).alias("score"), F.lit(True).alias("is_sibling"))
    return primaries.select("query_id", "id", "pos", "score", F.lit(False).alias("is_sibling")).unionByName(extra)


def lookup(refs: DataFrame, corpus: DataFrame | Located) -> DataFrame:
    """refs (with doc, dieu, khoan, diem) joined with the chunks there: a null or empty clause or point asks for any,
    an article that is no number finds nothing."""
    r = refs.withColumn("__dieu", F.expr("try_cast(dieu AS int)")).drop("dieu")
    c = by_place(corpus).select("id", F.col("doc").alias("__doc"), F.col("dieu").alias("__d"), F.col("khoan").alias("__k"), F.lower(F.col("diem")).alias("__p"))
    any_clause = F.coalesce(F.col("khoan").cast("string"), F.lit("")) == ""
    any_point = F.coalesce("diem", F.lit("")) == ""
    on = (F.col("doc") == F.col("__doc")) & (F.col("__dieu") == F.col("__d")) & (any_clause | (F.col("khoan").cast("string") == F.col("__k").cast("string"))) & (any_point | (F.lower("diem") == F.col("__p")))
    return r.join(c, on).drop("__doc", "__d", "__k", "__p").withColumnRenamed("__dieu", "dieu")


def references(df: DataFrame, text: str, keys: tuple[str, ...], default_doc: str = DEFAULT_DOC) -> DataFrame:
    """keys, ref_no, doc, dieu, khoan, diem: the explicit references of a text in order, each once. Points with a
    clause come first (their article may stand close behind, else it's the first of the text), then clauses
    with an article."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    near = r"[^.]{0,40}?"
    one = rf"(?U){REF_POINT}\s+{REF_CLAUSE}(?:{near}{REF_ARTICLE})?"
    two = rf"(?U){REF_CLAUSE}{near}{REF_ARTICLE}"
    hit = lambda p, k: F.regexp_extract_all(t, F.lit(p), F.lit(k))
    anywhere = F.nullif(F.regexp_extract(t, "(?U)" + REF_ARTICLE, 1), F.lit(""))
    first = F.transform(F.arrays_zip(hit(one, 1).alias("a"), hit(one, 2).alias("b"), hit(one, 3).alias("c")), lambda x: F.struct(F.coalesce(F.nullif(x["c"], F.lit("")), anywhere).cast("int").alias("dieu"), x["b"].alias("khoan"), x["a"].alias("diem")))
    second = F.transform(F.arrays_zip(hit(two, 1).alias("a"), hit(two, 2).alias("b")), lambda x: F.struct(x["b"].cast("int").alias("dieu"), x["a"].alias("khoan"), F.lit(None).cast("string").alias("diem")))
    every = F.array_distinct(F.filter(F.concat(first, second), lambda x: x["dieu"].isNotNull()))
    return df.select(*keys, F.posexplode(every).alias("ref_no", "r")).select(*keys, F.col("ref_no"), F.lit(default_doc).alias("doc"), "r.dieu", "r.khoan", "r.diem")


def append_lookups(chunks: DataFrame, refs: DataFrame, corpus: DataFrame | Located) -> DataFrame:
    """chunks, then the chunks that refs (query_id, ref_no, location) point at and that aren't there yet."""
    found = lookup(refs, corpus).groupBy("query_id", "id").agg(F.min("ref_no").alias("ref_no")).join(chunks.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _append(chunks, found, F.col("ref_no"), F.col("id"), sibling=False)


def _append(chunks: DataFrame, found: DataFrame, *order: Column, sibling: bool) -> DataFrame:
    n = chunks.groupBy("query_id").agg(F.max("pos").alias("n"))
    by = Window.partitionBy("query_id").orderBy(*order)
    extra = found.join(n, "query_id", "left").select("query_id", "id", (F.coalesce("n", F.lit(0)) + F.row_number().over(by)).alias("pos"), F.lit(0.0).alias("score"), F.lit(sibling).alias("is_sibling"))
    return chunks.select("query_id", "id", "pos", "score", "is_sibling").unionByName(extra)


def append_cross_references(chunks: DataFrame, corpus: DataFrame | Located, default_doc: str = DEFAULT_DOC) -> DataFrame:
    """References inside the first rows' texts: the first ones are followed, unless their article is there already;
    no further one is followed once enough chunks have been added."""
    top = chunks.where(F.col("pos") <= XREF_ROWS).join(by_id(corpus).select("id", "content"), "id")
    text = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " ").alias("text"))
    refs = references(text, "text", ("query_id",), default_doc).where(F.col("ref_no") < XREF_REFS)
    present = chunks.join(by_id(corpus).select("id", "doc", "dieu"), "id").select("query_id", "doc", "dieu").distinct()
    refs = refs.join(present, ["query_id", "doc", "dieu"], "left_anti")
    found = lookup(refs, corpus).groupBy("query_id", "id").agg(F.min("ref_no").alias("ref_no")).join(chunks.select("query_id", "id"), ["query_id", "id"], "left_anti")
    # what the references before this one have added
    sizes = found.groupBy("query_id", "ref_no").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("query_id").orderBy("ref_no").rowsBetween(Window.unboundedPreceding, -1)
    open_refs = sizes.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).where(F.col("before") < XREF_ADDED).select("query_id", "ref_no")
    return _append(chunks, found.join(open_refs, ["query_id", "ref_no"]), F.col("ref_no"), F.col("id"), sibling=False)


def diversify(chunks: DataFrame, corpus: DataFrame | Located, target: int = TOP_K, per_clause: int = PER_CLAUSE) -> DataFrame:
    """At most per_clause primaries of a clause and target in all, then the siblings; a sibling behind the primary
    that meets the target is lost."""
    df = chunks.join(by_id(corpus).select("id", "doc", "dieu", "khoan"), "id")
    first = df.where("NOT is_sibling").withColumn("__c", F.row_number().over(Window.partitionBy("query_id", "doc", "dieu", "khoan").orderBy("pos"))).where(F.col("__c") <= per_clause)
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("__n") <= target)
    end = first.groupBy("query_id").agg(F.max(F.when(F.col("__n") == target, F.col("pos"))).alias("end"))
    rest = df.where("is_sibling").join(end, "query_id", "left").where("end IS NULL OR pos < end")
    both = first.select("query_id", "id", "pos", "score", "is_sibling").unionByName(rest.select("query_id", "id", "pos", "score", "is_sibling"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("is_sibling", "pos")))


def pull_parents(chunks: DataFrame, corpus: DataFrame | Located, most_chars: int = PARENT_CHARS) -> DataFrame:
    """chunks, then the short level-2 chunks of the clauses whose level-3 chunks are there, as siblings."""
    at = chunks.join(by_id(corpus).select("id", "doc", "dieu", "khoan", "level"), "id").where("level = 3 AND doc <> '' AND dieu <> 0 AND khoan IS NOT NULL")
    clauses = at.groupBy("query_id", "doc", "dieu", F.col("khoan").cast("string").alias("__k")).agg(F.min("pos").alias("o1"))
    # an article's clauses in one row, so that articles alone are joined
    wanted = clauses.groupBy("query_id", "doc", "dieu").agg(F.map_from_entries(F.collect_list(F.struct("__k", "o1"))).alias("wanted"))
    parents = by_place(corpus).where((F.col("level") == 2) & (F.length("content") <= most_chars)).select("id", "doc", "dieu", F.col("khoan").cast("string").alias("khoan"))
    met = wanted.join(parents, ["doc", "dieu"]).select("query_id", "id", F.try_element_at("wanted", F.col("khoan")).alias("o1")).where("o1 IS NOT NULL")
    found = met.groupBy("query_id", "id").agg(F.min("o1").alias("o1")).join(chunks.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _append(chunks, found, F.col("o1"), F.col("id"), sibling=True)


def clause_sets(chunks: DataFrame, corpus: DataFrame | Located) -> DataFrame:
    """(query_id, clauses): the sorted distinct "ĐxKy"."""
    df = chunks.join(by_id(corpus).select("id", "dieu", "khoan"), "id").where("dieu <> 0 AND khoan IS NOT NULL")
    return df.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Đ"), F.col("dieu").cast("string"), F.lit("K"), F.col("khoan").cast("string")))), ",").alias("clauses"))


def multi_frame(chunks: DataFrame, corpus: DataFrame | Located, intent: Column) -> DataFrame:
    """(query_id, multi_frame): two clauses or more among the primaries, for the intents that may have several cases."""
    df = chunks.join(by_id(corpus).select("id", "doc", "dieu", "khoan"), "id")
    place = F.when(~F.col("is_sibling") & (F.col("doc") != "") & (F.col("dieu") != 0) & F.col("khoan").isNotNull(), F.struct("doc", "dieu", "khoan"))
    return df.groupBy("query_id").agg(F.count_distinct(place).alias("n")).select("query_id", (intent.isin("penalty", "mixed") & (F.col("n") >= 2)).alias("multi_frame"))


def is_broad(*texts: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts]))
    return blob.rlike(r"(?U)\b(?:" + "|".join(BROAD_PHRASES) + r")\b")


def top_k_of(broad: Column) -> Column:
    return F.when(broad, TOP_K_BROAD).otherwise(TOP_K)


def budget(top_k: Column, n: Column) -> Column:
    """Hits that each of n retrievals of a question may bring."""
    return F.greatest(F.lit(PER_QUERY_MIN), F.floor(top_k / F.greatest(n, F.lit(1))).cast("int") + 2)


def judge_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*JUDGE_STOPWORDS)))


def judge(chunks: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, text, intent) -> query_id, confidence, passed: points for having primaries, for the
    score of the first, for words that the first three share with the query, and by intent for what their texts
    hold."""
    by = Window.partitionBy("query_id").orderBy("pos")
    first = chunks.where("NOT is_sibling").withColumn("n", F.row_number().over(by)).where("n <= 3").join(corpus.select("id", "content"), "id")
    rows = F.array_sort(F.collect_list(F.struct("n", "score", "content")))
    top = first.groupBy("query_id").agg(rows.alias("rows"))
    df = queries.join(top, "query_id", "left")
    text = F.array_join(F.transform("rows", lambda x: x["content"]), " ")
    has = lambda p: F.coalesce(text.rlike(java(p)), F.lit(False))
    points = lambda c, v: F.when(c, v).otherwise(0.0)
    words = judge_words(F.col("text"))
    shared = F.exists("rows", lambda x: F.arrays_overlap(words, judge_words(x["content"])))
    intent = F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("penalty"))
    by_intent = (
        F.when(intent == "penalty", F.when(has(MONEY), 2.0).otherwise(-1.5) + points(has(LEGAL_REF), 0.5))
        .when(intent == "fault", points(has(RULE_WORDS), 1.5))
        .when(intent == "procedure", points(has(PROCEDURE_WORDS), 1.5))
        .when(intent == "mixed", points(has(MONEY) | has(RULE_WORDS), 1.5))
        .otherwise(0.0)
    )
    score = 1.0 + points(F.col("rows")[0]["score"] >= MIN_TOP_SCORE, 1.0) + points(shared, 1.0) + by_intent
    score = F.when(F.col("rows").isNull(), F.lit(0.0)).otherwise(score)
    return df.select("query_id", score.alias("confidence"), (F.col("rows").isNotNull() & (score >= PASS_SCORE)).alias("passed"))
