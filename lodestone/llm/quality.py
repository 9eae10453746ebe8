"""Quality rules: text statistics, fixed base rules and a learned decision list.

Everything over the corpus is DataFrame expressions: no shuffle, no Python. The decision list is
learned by sequential covering on a bounded sample of labelled statistics: conjunctions of thresholds
are grown by information gain on two thirds of the sample and pruned on the last third; a rule is taken
if it stays precise there. The list is emitted as one ordered CASE expression.

Defined results: a null or blank text has zero words, so the base rule fails it; repeated rows are each
judged on their own; without labelled rows of both classes the list is empty and keeps everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, hash_sample, plain_names

BLANK = r"[\x20\x09-\x0D]+"
#: Bound of the training sample: labelled documents of a class.
SAMPLE_DOCS = 3000
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: What the learned rules may look at.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "lone_share")
#: A rule must be this precise on the pruning third, and meet this many rejected rows in the growing part.
MIN_PRECISION, MIN_SUPPORT, MAX_RULES, MAX_CONDITIONS, CUTS = 0.9, 5, 12, 3, 40


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, at_least, value) holds: feature >= value, or feature < value."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, value in self.conditions:
            out = out & (F.col(f"__q_{name}") >= value if at_least else F.col(f"__q_{name}") < value)
        return out

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, at_least, value in self.conditions:
            v = x[:, FEATURES.index(name)]
            out &= v >= value if at_least else v < value
        return out


def with_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with __q_ columns: the counts of the base rules and the features of the learned ones."""
    keep = [F.col(f"`{c}`") for c in documents.columns]
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step is its own projection: an array that a lambda looks into must be a column, else it is built anew for each element.
    df = documents.select(*keep, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("__q_w"), F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)).alias("__q_l"))
    df = df.withColumn("__q_h", F.expr(f"IF(size(__q_w) >= {WINDOW}, transform(sequence(0, size(__q_w) - {WINDOW}), i -> xxhash64({', '.join(f'__q_w[i + {k}]' for k in range(WINDOW))})), array())"))
    df = df.withColumn("__q_s", F.expr("IF(size(array_distinct(__q_h)) < size(__q_h), sort_array(transform(__q_h, (h, i) -> struct(h AS h, i AS i))), array())"))
    # windows that have an equal neighbour once sorted: found twice or more
    df = df.withColumn("__q_p", F.expr("sort_array(filter(transform(__q_s, (x, k) -> IF((k > 0 AND __q_s[IF(k > 0, k - 1, 0)].h = x.h) OR (k < size(__q_s) - 1 AND __q_s[IF(k < size(__q_s) - 1, k + 1, k)].h = x.h), x.i, NULL)), i -> i IS NOT NULL))"))
    n_words = F.size("__q_w").cast("long")
    df = df.select(
        *keep,
        n_words.alias("__q_n_words"),
        F.length(F.regexp_replace(t, BLANK, "")).cast("long").alias("__q_word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("__q_n_symbols"),
        (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long").alias("__q_n_dup_lines"),
        F.expr(f"aggregate(transform(__q_p, (p, k) -> IF(k = size(__q_p) - 1, {WINDOW}, least({WINDOW}, __q_p[IF(k < size(__q_p) - 1, k + 1, k)] - p))), 0L, (a, x) -> a + x)").alias("__q_n_repeat_words"),
        F.greatest(F.size("__q_l"), F.lit(1)).alias("__q_lines"),
        F.size(F.array_distinct("__q_w")).alias("__q_distinct"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("__q_upper"),
        F.size(F.filter("__q_w", lambda w: F.length(w) == 1)).alias("__q_lone"),
    )
    words, chars = F.greatest("__q_n_words", F.lit(1)), F.greatest("__q_word_chars", F.lit(1))
    return df.select(
        *keep,
        *[F.col(f"__q_{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (F.col("__q_word_chars") / words).alias("__q_mean_word"),
        (F.col("__q_n_symbols") / chars).alias("__q_symbol_share"),
        (F.col("__q_n_dup_lines") / F.col("__q_lines")).alias("__q_dup_line_share"),
        (F.col("__q_n_repeat_words") / words).alias("__q_repeat_share"),
        (F.col("__q_upper") / chars).alias("__q_upper_share"),
        (F.col("__q_distinct") / words).alias("__q_distinct_share"),
        (F.col("__q_lone") / words).alias("__q_lone_share"),
        F.monotonically_increasing_id().alias("__q_row"),
    )


def base_failed() -> Column:
    return (F.col("__q_n_words") < MIN_WORDS) | (100 * F.col("__q_n_repeat_words") > MAX_REPEATED_PERCENT * F.col("__q_n_words"))


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Sequential covering. x: a row for each labelled document, by FEATURES; bad: what to reject."""
    rules: list[Rule] = []
    if not len(x) or bad.all() or not bad.any():
        return rules
    prune = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~prune], bad[~prune], x[prune], bad[prune]
    while len(rules) < MAX_RULES and gy.sum() >= MIN_SUPPORT:
        rule = _pruned(_grown(gx, gy), px, py)
        g, p = rule.covers(gx), rule.covers(px)
        precise = gy[g].sum() >= max(MIN_SUPPORT, MIN_PRECISION * g.sum()) and py[p].sum() >= MIN_PRECISION * p.sum()
        if not rule.conditions or not precise:
            break
        rule = _settled(rule, np.vstack([gx, px]), np.r_[gy, py])
        rules.append(rule)
        g, p = rule.covers(gx), rule.covers(px)
        gx, gy, px, py = gx[~g], gy[~g], px[~p], py[~p]
    return rules


def _grown(x: np.ndarray, y: np.ndarray) -> Rule:
    inside, conditions = np.ones(len(x), bool), []
    while len(conditions) < MAX_CONDITIONS and not y[inside].all():
        p0, n0 = y[inside].sum(), inside.sum()
        best = (1e-9, None, None)
        for k, name in enumerate(FEATURES):
            v = x[inside, k]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1))[1:]):
                above = v >= cut
                for at_least, side in ((True, above), (False, ~above)):
                    n, p = side.sum(), y[inside][side].sum()
                    if p >= MIN_SUPPORT and n < n0 and (gain := p * (math.log2(p / n) - math.log2(p0 / n0))) > best[0]:
                        best = (gain, (name, at_least, float(cut)), side)
        if best[1] is None:
            break
        conditions.append(best[1])
        inside[np.flatnonzero(inside)[~best[2]]] = False
    return Rule(tuple(conditions))


def _pruned(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drops the last conditions while that lifts (accepted - wrong) / covered on the pruning rows."""

    def worth(r: Rule) -> float:
        c = r.covers(x)
        return (2 * y[c].sum() - c.sum()) / max(1, c.sum())

    options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    return max(reversed(options), key=worth) if options else rule


def _settled(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Moves every cut to the middle of the gap between the last row to keep outside it and the rows to reject."""
    out = list(rule.conditions)
    for k, (name, at_least, cut) in enumerate(out):
        sign = 1.0 if at_least else -1.0
        others = Rule(tuple(c for j, c in enumerate(out) if j != k)).covers(x)
        v, bad = sign * x[others, FEATURES.index(name)], y[others]
        inside = v >= cut if at_least else v > -cut
        good = v[~bad & ~inside]
        edge = good.max() if len(good) else -np.inf
        reject = v[bad & (v > edge)]
        if len(reject):
            out[k] = (name, at_least, float(sign * ((edge + reject.min()) / 2 if np.isfinite(edge) else reject.min() - 1e-9)))
    return Rule(tuple(out))


def fit(documents: DataFrame, labels: DataFrame) -> list[Rule]:
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = hash_sample(known.where("quality = 1"), "doc_id", SAMPLE_DOCS).unionByName(hash_sample(known.where("quality = 0"), "doc_id", SAMPLE_DOCS))
    some = documents.select(F.col("doc_id").alias("__q_id"), F.col("text").alias("__q_text")).join(F.broadcast(sample), F.col("__q_id") == F.col("doc_id"))  # at most 2 x SAMPLE_DOCS ids
    rows = with_statistics(some.select("__q_id", "__q_text", "quality"), "__q_text").select("__q_id", "quality", *[F.col(f"__q_{f}").cast("double").alias(f) for f in FEATURES], base_failed().alias("failed"))
    # an id may have many rows; of all at most 2 x SAMPLE_DOCS rows of numbers come to the driver
    rows = rows.orderBy(F.xxhash64("__q_id", *FEATURES), "__q_id", *FEATURES).limit(2 * SAMPLE_DOCS).collect()
    # what the base rules reject already is not left to be learned
    rows = sorted((r for r in rows if not r.failed), key=lambda r: (hash((r["__q_id"] * 0x9E3779B97F4A7C15) % (1 << 61)), *[r[f] for f in FEATURES]))
    return learn(np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.quality == 0 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """True to keep: an ordered CASE over the rules."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    got = with_statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return got.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """documents without the rejected rows; columns and values are kept."""
    # The row number keeps the filter above the statistics: pushed below, it would work out each of them anew wherever it is named.
    good = ~base_failed() & verdict(rules) & (F.col("__q_row") >= 0)
    plain, named = plain_names(documents, "text")
    return named(with_statistics(plain).where(good))
