"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

A document's key is exponential with its quality weight as the rate; within a source the smallest keys
come first. A target over a source's size is met by complete epochs first; the rest is a prefix of the
key order whose sizes sum to it. No source is ever sorted as a whole: keys are cut into buckets, and these
into buckets again, by their distribution function; sums show in which one the prefix ends, and only that
one is ordered, rows with equal keys as one. Of these a count is taken, by row numbers that are counted up
part by part. What remains is one cut per source, which every row compares itself with.

Defined results: a null text has size 0; a null source is a source, the last one; repeated rows are
documents each, taken by their places; an empty table gives no rows. But for such places everything
follows from ids and texts, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, plain_names, taken, written

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
#: Buckets of a source, and of a bucket.
BUCKETS = 4096
#: Sources up to which their cuts are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000
LEAST_WEIGHT = 0.05


def quality_weight(text: Column) -> Column:
    """The share of letters in the text, at least LEAST_WEIGHT."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(letters / F.greatest(F.length(text), F.lit(1)), F.lit(LEAST_WEIGHT))


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1): 52 bits of an MD5 of the id and the text, so that rows that share an id, or have none, differ."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary")))
    return (F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def keyed(documents: DataFrame) -> DataFrame:
    """documents' rows as __m_id, __m_source, __m_size, __m_key, __m_bucket and __m_row, besides their own columns. To be written, as __m_row counts places."""
    t = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(f"`{c}`") for c in documents.columns]
    key = -F.ln(uniform(F.col("doc_id"), t)) / quality_weight(t)
    df = documents.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("__m_id"), F.col("source").alias("__m_source"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("__m_size"), key.alias("__m_key"))
    bucket = F.least(F.lit(BUCKETS * BUCKETS - 1), F.floor(BUCKETS * BUCKETS * (1 - F.exp(-0.8 * F.col("__m_key")))))
    return df.withColumn("__m_bucket", bucket.cast("int")).withColumn("__m_row", F.monotonically_increasing_id())


def targets(sizes: DataFrame) -> DataFrame:
    """(__m_source, source_size) -> with target. Sources are filled by weight; those that would pass
    MOST_EPOCHS times their size stop there, in the order in which they do."""
    rank = F.row_number().over(Window.orderBy(F.col("__m_source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), rank % len(WEIGHTS) + 1)
    df = sizes.select("__m_source", "source_size", w.alias("w"))
    df = df.withColumn("full", F.lit(float(MOST_EPOCHS)) * F.col("source_size")).withColumn("fills_at", F.col("full") / F.col("w"))
    by = Window.orderBy("fills_at", F.col("__m_source").asc_nulls_last())
    before = F.coalesce(F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    df = df.withColumn("level", (SHARE * total - before) / left)
    # the level of the first source that doesn't fill up is everyone's; later levels are lower, earlier ones were passed
    reached = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(Window.partitionBy())
    return df.select("__m_source", "source_size", F.least("full", F.coalesce(reached, F.lit(float("inf"))) * F.col("w")).alias("target"))


def _few(rows: DataFrame) -> DataFrame:
    """rows, one a source, to be broadcast if they're few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def _cut_bucket(sums: DataFrame, tag: str) -> DataFrame:
    """Of sums (s, rest, base, bucket, n), base being what lies before all buckets: the one that a prefix of rest ends in, and what lies before it."""
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
    at = sums.withColumn("upto", upto).where("rest > upto - n AND rest <= upto")
    return _few(written(at.select("s", "rest", (F.col("upto") - F.col("n")).alias("base"), "bucket"), tag))


def _inside(keys: DataFrame, ends: DataFrame, bucket: Column) -> DataFrame:
    return keys.join(ends, F.col("__m_source").eqNullSafe(F.col("s")) & (bucket == F.col("bucket")))


def cuts(keys: DataFrame) -> DataFrame:
    """A row per source: target, full epochs, and the last row that the fractional epoch takes."""
    coarse, fine = F.shiftright("__m_bucket", (BUCKETS - 1).bit_length()), F.col("__m_bucket")
    sums = keys.groupBy("__m_source", coarse.alias("bucket")).agg(F.sum("__m_size").alias("n"))
    goals = targets(sums.groupBy("__m_source").agg(F.sum("n").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(MOST_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    goals = written(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    first = sums.join(_few(goals.select(F.col("__m_source").alias("s"), "rest")), F.col("__m_source").eqNullSafe(F.col("s")))
    ends = _cut_bucket(first.select("s", "rest", F.lit(0).cast("long").alias("base"), "bucket", "n"), "mix-coarse")
    second = _inside(keys, ends, coarse).groupBy("s", "rest", "base", fine.alias("bucket")).agg(F.sum("__m_size").alias("n"))
    ends = _cut_bucket(second, "mix-fine")
    # of the bucket's rows those of equal keys are one; documents are taken while at least half of them fits
    same = _inside(keys, ends, fine).groupBy("s", "rest", "base", "__m_key", "__m_id", "__m_size").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("s").orderBy("__m_key", "__m_id", "__m_size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum(F.col("m") * F.col("__m_size")).over(order), F.lit(0))
    fits = F.floor((2 * F.col("rest") - 2 * F.col("before") + F.col("__m_size")) / (2 * F.col("__m_size")))
    same = same.withColumn("before", before).withColumn("take", F.when(F.col("__m_size") > 0, F.least("m", fits)).otherwise(F.col("m"))).where("take > 0")
    last = same.groupBy("s").agg(F.max(F.struct("__m_key", "__m_id", "__m_size", "m", "take")).alias("x"))
    last = written(last.select("s", "x.*"), "mix-last")
    last = last.select("s", F.struct("__m_key", "__m_id", "__m_size").alias("last"), F.col("m").alias("m"), F.col("take").alias("take"))
    last = _with_last_row(keys, last)
    ends = ends.select(F.col("s").alias("e"), "bucket").join(last, F.col("e").eqNullSafe(F.col("s")), "left")
    return goals.join(ends.select("e", "bucket", "last", "last_row"), F.col("__m_source").eqNullSafe(F.col("e")), "left").select(F.col("__m_source").alias("__c_source"), F.col("source_size").alias("__c_size"), F.col("target").alias("__c_target"), F.col("epochs").alias("__c_epochs"), F.col("bucket").alias("__c_bucket"), F.col("last").alias("__c_last"), F.col("last_row").alias("__c_row"))


def _with_last_row(keys: DataFrame, last: DataFrame) -> DataFrame:
    """last (s, last, m, take) with last_row: of m equal rows the place of the take-th, null if all are taken. Places are
    counted by the part of the table that they stand in, so equal rows never meet in one task."""
    part = last.where("take < m")
    if part.isEmpty():
        return last.withColumn("last_row", F.lit(None).cast("long"))
    part = _few(part)
    rows = keys.join(part, F.col("__m_source").eqNullSafe(F.col("s")) & (F.struct("__m_key", "__m_id", "__m_size") == F.col("last"))).select("s", "take", "__m_row", F.shiftright("__m_row", 33).alias("p"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("p"))
    at = rows.groupBy("s", "take", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto).where("take > upto - n AND take <= upto")
    at = _few(written(at.select(F.col("s").alias("as"), F.col("p").alias("ap"), (F.col("take") - F.col("upto") + F.col("n")).alias("nth")), "mix-part"))
    inside = rows.join(at, F.col("s").eqNullSafe(F.col("as")) & (F.col("p") == F.col("ap")))
    nth = inside.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("__m_row"))).where("k = nth").select(F.col("s").alias("ls"), F.col("__m_row").alias("last_row"))
    return last.join(nth, F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls")


def with_copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    df = rows.join(_few(cut), F.col("__m_source").eqNullSafe(F.col("__c_source")))
    own = F.struct("__m_key", "__m_id", "__m_size")
    upto = (own < F.col("__c_last")) | ((own == F.col("__c_last")) & (F.col("__c_row").isNull() | (F.col("__m_row") <= F.col("__c_row"))))
    inside = (F.col("__m_bucket") < F.col("__c_bucket")) | ((F.col("__m_bucket") == F.col("__c_bucket")) & upto)
    return df.withColumn("__m_copies", F.col("__c_epochs") + F.coalesce(inside, F.lit(False)).cast("long"))


def mix_plan(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row."""
    keys = written(keyed(documents.select("doc_id", "text", "source")).drop("doc_id", "text", "source"), "mix-keys")
    df = with_copies(keys, written(cuts(keys), "mix-cuts"))
    doc_id = F.when(F.col("__m_id") != -(1 << 63), F.col("__m_id"))
    return df.select(doc_id.alias("doc_id"), F.col("__m_size").alias("size"), F.col("__c_size").alias("source_size"), F.round("__c_target", 6).alias("target"), (F.col("__m_copies") * F.col("__m_size")).alias("taken"))


def mix(documents: DataFrame) -> DataFrame:
    """The rows that the mix takes, with size, copies and taken words beside documents' own columns; where documents have a
    column of such a name (in any case, unless the session tells cases apart) theirs stays. Texts are keyed and written once,
    and read again without a shuffle."""
    plain, named = plain_names(documents, "doc_id", "text", "source")
    whole = written(keyed(plain), "mix-keyed")
    cut = written(cuts(whole.select("__m_id", "__m_source", "__m_size", "__m_key", "__m_bucket", "__m_row")), "mix-cuts")
    df = with_copies(whole, cut).where("__m_copies > 0")
    new = {"size": F.col("__m_size"), "source_size": F.col("__c_size"), "target": F.round("__c_target", 6), "copies": F.col("__m_copies"), "taken": F.col("__m_copies") * F.col("__m_size")}
    return named(df, *[c.alias(n) for n, c in new.items() if not taken(documents, n)])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    greatest(length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)::DOUBLE, {LEAST_WEIGHT}) AS w,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS fills_at FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= fills_at) * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, e.target - e.epochs * e.source_size AS rest
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
