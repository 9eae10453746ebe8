"""Importance resampling towards a target's distribution of hashed word features, by an external sort-count.

A feature is a word or two consecutive words; its bucket is its crc32 modulo BUCKETS. One pass over the texts writes
the buckets of all features as packed uint16 streams, a row for each batch of documents, with where each document's
part ends. Tasks sort the streams and run-length encode them for the counts; from the counts of documents and target
each bucket gets a gain, and a second pass, over the streams alone, gathers gains and sums them by document with
np.add.reduceat. A document's weight is the mean gain of its features; a Gumbel number by a hash of its id is added,
and the highest scores are drawn without replacement.

Ranks come from two passes as well: rows are dealt into ranges of the order and put in order inside; counts by range
say where each range's ranks begin. Neither a score that many rows share nor a repeated id makes a range long, as a
row's place is the last part of the order.

Defined results: a null or empty text has no feature and weight 0, and is never drawn, as documents of fewer than
LEAST_WORDS words are; a null id hashes like the text "null" and comes last among ties; repeated rows are a document
each, ties among them go by place; an empty target or an empty table gives gains that follow from counts of 0.
Only doc_id and text are read; draw keeps all columns, whatever their names.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, crc32_sql, map_arrow, plain_names, ranked, written

BUCKETS, LEAST_WORDS, PERCENT, SALT = 10_000, 20, 25, 7
#: Bytes of a text that are taken apart in one go.
PART = 1 << 20
#: Lower-cases A-Z; whatever is neither a digit, a letter nor beyond ASCII is a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def buckets(text: bytes) -> np.ndarray:
    """The buckets of a UTF-8 text's features, in no order that matters."""
    text, out, at, last = text.translate(FOLD), [], 0, None
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        at = end
        if not words:
            continue
        ones = list(map(crc32, words))
        # a pair's checksum goes on from that of its first word
        before = ones[:-1] if last is None else [last, *ones[:-1]]
        twos = list(map(crc32, [b" " + w for w in (words[1:] if last is None else words)], before))
        last = ones[-1]
        out.append((np.array(ones + twos, np.uint32) % BUCKETS).astype(np.uint16))
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def streams(documents: DataFrame, id_column: str = "doc_id", row: Column | None = None) -> DataFrame:
    """The packed streams, written: ids, rows (numbers of their own) and ends (of each document's part) as lists, and the buckets as bytes."""

    def run(batches):
        for b in batches:
            each = [buckets(t or b"") for t in b.column(2).to_pylist()]
            ends = np.cumsum([len(x) for x in each], dtype=np.int64)
            lists = [pa.array([c], pa.list_(pa.int64())) for c in (b.column(0).to_pylist(), b.column(1).to_pylist(), ends)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([b"".join(x.tobytes() for x in each)], pa.binary())], names=["ids", "rows", "ends", "buckets"])

    row = F.monotonically_increasing_id() if row is None else row
    texts = documents.select(column(id_column).cast("long").alias("i"), row.alias("r"), F.col("text").cast("string").cast("binary").alias("t"))
    return written(map_arrow(texts, run, "ids array<long>, rows array<long>, ends array<long>, buckets binary"), "bucket-streams")


def counts(packed: DataFrame) -> DataFrame:
    """(bucket, n) of all streams: each is sorted and its runs are counted; a task says what it has once."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0):
                stream = np.sort(np.frombuffer(x.as_buffer(), np.uint16))
                heads = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]]) if len(stream) else np.zeros(0, np.int64)
                total[stream[heads]] += np.diff(np.r_[heads, len(stream)])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return map_arrow(packed.select("buckets"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """By bucket, what a feature in it gains a document; from (bucket, n) of the documents and of the target. BUCKETS numbers."""
    every = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    df = every.join(documents.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = lambda c: F.sum(c).over(Window.partitionBy())  # over BUCKETS rows
    d = lambda c: c.cast("double")
    ratio = (d(F.col("t") + 1) * d(whole("s") + BUCKETS)) / (d(F.col("s") + 1) * d(whole("t") + BUCKETS))
    out = np.zeros(BUCKETS, np.int64)
    for r in df.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, row, n_features, weight) of every document."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ends = b.column(2)[k].values.to_numpy(zero_copy_only=False)
                stream = np.frombuffer(b.column(3)[k].as_buffer(), np.uint16)
                sizes = np.diff(ends, prepend=0)
                some = sizes > 0
                weight = np.zeros(len(ends), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gain[stream], (ends - sizes)[some]) // sizes[some]
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, b.column(1)[k].values, pa.array(sizes), pa.array(weight)], names=["doc_id", "row", "n_features", "weight"])

    return map_arrow(packed.select("ids", "rows", "ends", "buckets"), run, "doc_id long, row long, n_features long, weight long")


def scored(documents: DataFrame, target: DataFrame, target_id: str = "item_id", row: Column | None = None) -> DataFrame:
    """doc_id, row, n_features, weight and score of every document, written."""
    packed, goal = streams(documents, row=row), streams(target, target_id)
    df = weights(packed, gains(counts(packed), counts(goal)))
    hashed = F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return written(df.withColumn("score", F.col("weight") + gumbel), "resampling-scores")


def importance(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, target_id: str = "item_id", row: Column | None = None) -> DataFrame:
    """scored, with rank: the place of those that are drawn, percent of the documents of least_words words or more; null for all others."""
    df = scored(documents, target, target_id, row)
    enough = F.col("n_features") >= max(1, 2 * least_words - 1)
    drawn = percent * df.where(enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    some = ranked(df.where(enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return some.unionByName(df.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def draw(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, target_id: str = "item_id") -> DataFrame:
    """The rows of documents that are drawn, with all their columns. Texts are written once with a number, and not shuffled unless the join deals them out."""
    plain, named = plain_names(documents, "doc_id", "text")
    whole = written(plain.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    drawn = importance(whole, target, percent, least_words, target_id, F.col("__row")).where("rank IS NOT NULL").select(F.col("row").alias("__drawn"))
    return named(whole.join(drawn, F.col("__row") == F.col("__drawn"), "left_semi"))


FEATURES = "SELECT {0} AS i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM (SELECT {0}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {1})"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT i, f, count(*) AS n FROM ({FEATURES.format("doc_id", "documents")}) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT f, count(*) AS n FROM ({FEATURES.format("item_id", "benchmark")}) GROUP BY 1),
b AS MATERIALIZED (SELECT f, {crc32_sql("f")} % {BUCKETS} AS b FROM (SELECT f FROM d UNION SELECT f FROM g)),
s AS (SELECT b, sum(n) AS s FROM d JOIN b USING (f) GROUP BY 1),
t AS (SELECT b, sum(n) AS t FROM g JOIN b USING (f) GROUP BY 1),
totals AS (SELECT (SELECT sum(s) FROM s)::DOUBLE AS ss, (SELECT sum(t) FROM t)::DOUBLE AS tt),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (b) CROSS JOIN totals),
w AS (SELECT i, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM d JOIN b USING (f) JOIN gain USING (b) GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SALT}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w ON i = doc_id),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT *, CASE WHEN n_features >= {2 * LEAST_WORDS - 1} THEN row_number() OVER (PARTITION BY n_features >= {2 * LEAST_WORDS - 1} ORDER BY score DESC, doc_id) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(place) // 100 FROM r) THEN place END AS rank FROM r
"""
