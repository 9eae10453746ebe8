"""Spelling variants: words at one edit, found by an even-partition pigeonhole join.

A word is cut into two segments of even length. One edit leaves at least one of them as it is: the first stands at
the same place in the other word, the second is shifted by as much as that word is longer. The edit is in what remains,
which is one edit from what remains of the other word, so the same holds for its own two segments. Every word is
therefore indexed under both segments, each with both segments of the remainder, and probed with its own substrings where
words of its length, and of one less, would be cut. Index and probes are joined by length, segment numbers and segments,
one edit is verified in the join, pairs of equal length count where the smaller word probes, and what several keys found
is made one. (With the outer segments alone the same pairs come out of fifteen times as many candidates: 679 million
for 0.8 million words, 45 million with the inner ones.) Each word's form is its commonest near word, if that is at least
RATIO times as common; forms are followed to the last by doubling the steps, and there can be no more of these than
powers of RATIO up to the commonest word's count.

Counts are aggregated before they're shuffled, however common a word; the joins deal out both sides, and adaptive
execution splits a segment that many words share. Everything is DataFrame functions.

Defined results: null and empty texts have no words; a null id stands as "null" in the hash that injects typing
errors; repeated rows count each; ties between near words go to the smallest in code-point order; an empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc32_sql, written

RUN = "[A-Za-zÀ-ÿ]"
ERRORS, LEAST_CHARS, LEAST_COUNT, RATIO = 97, 5, 3, 2
#: Doublings of the steps to a root; 2^7 steps would take a word that occurs 2^128 times.
MOST_DOUBLINGS = 7


def runs(text: Column) -> Column:
    """The maximal runs of letters of a text, of those of LEAST_CHARS letters or more, as they are written."""
    return F.regexp_extract_all(text.cast("string"), F.lit(f"{RUN}{{{LEAST_CHARS},}}"), 0)


def with_errors(run: Column, doc_id: Column) -> Column:
    """run, less one code point where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % ERRORS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): the words of at least LEAST_CHARS code points that occur LEAST_COUNT times or more, written."""
    each = documents.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    each = each.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    words = each.select(with_errors(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT), "vocabulary")


def _halves(word: Column, size: Column) -> list[tuple[Column, Column]]:
    """(segment, remainder) for both segments of a word of that size; of a longer word, what stands where they would be: the first at the same place, the second as far from the end."""
    half = F.floor(size / 2).cast("int")
    rest = F.length(word) - half
    cut = F.length(word) - (size - half)
    return [(F.substring(word, F.lit(1), half), F.substring(word, half + 1, rest)), (F.substring(word, cut + 1, size - half), F.substring(word, F.lit(1), cut))]


def _keys(word: Column, size: Column) -> list[Column]:
    """What a pair at one edit shares at least one of: a segment, and a segment of the remainder, cut in the same way."""
    sizes = [size - F.floor(size / 2).cast("int"), F.floor(size / 2).cast("int")]  # of the remainders, in a word of that size
    return [F.concat_ws("|", segment, inner) for (segment, rest), m in zip(_halves(word, size), sizes, strict=True) for inner, _ in _halves(rest, m)]


def _under(words: DataFrame, sizes: Column, name: str) -> DataFrame:
    """(key, side, name, name_n): words under all their keys, hashed, for each of the sizes."""
    df = words.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.explode(sizes).alias("size"))
    keys = F.array(*[F.xxhash64("size", F.lit(k), s) for k, s in enumerate(_keys(F.col(name), F.col("size")))])
    return df.select(F.posexplode(keys).alias("side", "key"), name, f"{name}_n")


def pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of words (word, n; distinct) at exactly one edit, each pair once."""
    size = F.length("word")
    index, probes = _under(words, F.array(size), "a"), _under(words, F.array(size, size - 1), "b")
    a, b = F.col("a"), F.col("b")
    apart = (F.length(b) > F.length(a)) | ((F.length(b) == F.length(a)) & (a > b))
    # never broadcast: sizes are guessed before words are multiplied
    found = index.hint("merge").join(probes.withColumnRenamed("side", "probed"), "key").where((F.col("side") == F.col("probed")) & apart & (F.levenshtein(a, b, 1) == 1))
    # a pair may share several keys
    return found.select("a", "a_n", "b", "b_n").distinct()


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near one: how many, and the commonest of them."""
    found = written(pairs(words), "near-words")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), "b")).alias("x"))
    return best.select("word", "n_near", F.col("x.b").alias("form"), (-F.col("x.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where the forms of forms end."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(MOST_DOUBLINGS):
        now = written(now, "roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            break
        now = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every one of words (word, n; distinct)."""
    df = words.join(near(words), "word", "left")
    keeps = F.col("form_n") >= RATIO * F.col("n")
    df = written(df.select("word", F.when(keeps, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(keeps, F.col("form_n")).alias("form_n")), "forms")
    last = roots(df.where("form IS NOT NULL"))
    return df.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(documents: DataFrame) -> DataFrame:
    return variants(vocabulary(documents))


#: Independent of the join above: words are near if they are the same without the code point at one place, or if one is the other without a code point.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {LEAST_CHARS} GROUP BY 1, 2),
h AS (SELECT run, n, {crc32_sql("(doc_id || ':' || run)")} AS h FROM c),
e AS (SELECT n, CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= {LEAST_CHARS} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
l AS (SELECT DISTINCT v.word AS short, v.n AS short_n, k.word AS long, k.n AS long_n FROM v JOIN k ON k.key = v.word),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT short, long, long_n FROM l UNION ALL SELECT long, short, short_n FROM l),
m AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS x FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -x[1] >= {RATIO} * v.n THEN x[2] END AS form, CASE WHEN -x[1] >= {RATIO} * v.n THEN -x[1] END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
w AS (SELECT word, word AS goal, 0 AS steps FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM w JOIN f ON f.word = w.goal WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(goal, steps) AS root FROM w GROUP BY 1) z ON z.word = f.word
"""
