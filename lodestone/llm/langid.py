"""Language identification as inference in a mixture.

Character trigrams of a bounded sample of each language's documents give smoothed trigram distributions. A
document is a run of windows of WINDOW trigrams, each written in one of the languages; expectation-
maximisation estimates the languages' shares from the windows' likelihoods. Languages enter the set one by
one, while the likelihood gains more than the penalty for a further share; the largest share is predicted.

Defined results: null texts and texts without a letter are "und" with score 0; so is everything if no
document can be learned from; repeated rows are predicted each on its own. A null lang is not learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, map_arrow, spread, trainable

#: Bounds of the training sample: documents of a language, characters taken of each (in pieces spread over a longer one).
SAMPLE_DOCS, SAMPLE_CHARS = 400, 16_000
#: The sample of a language is drawn slice by slice of the ids' hashes.
SLICES = 40
BITS = 16
WINDOW = 32
SMOOTHING = 0.1
#: Neighbouring trigrams share letters, so a window's log likelihood counts by this part.
TEMPER = 0.4
ROUNDS = 15
#: Characters that are looked at in one go.
PIECE = 1 << 19
UNKNOWN = "und"


def letters_table() -> np.ndarray:
    """Whether a code point is a letter, by its Unicode category."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _letters(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, bool]:
    """Lower-case letters, each run of other characters being one blank; and whether there is a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = is_letter[c]
    c = np.where(known, c, 32).astype(np.uint32)
    return c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]] if len(c) else c, bool(known.any())


def _hashed(c: np.ndarray) -> np.ndarray:
    if len(c) < 3:
        return np.zeros(0, np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def pieces(text: str, is_letter: np.ndarray):
    """(hashed trigrams, whether there is a letter), piece by piece; trigrams over a seam belong to the later piece."""
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        c, found = _letters(text[at : at + PIECE], is_letter)
        c = np.concatenate([tail, c[1:] if len(c) and tail[-1] == c[0] == 32 else c])
        if at + PIECE >= len(text) and c[-1] != 32:
            c = np.append(c, np.uint32(32))
        yield _hashed(c), found
        tail = c[-2:]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # trigram x language


def fit(documents: DataFrame) -> Model:
    keys = documents.where(F.col("lang").isNotNull() & trainable()).select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.xxhash64("doc_id").alias("h"))
    # first within slices of each language, so that no task gathers what every task of a long scan keeps of one language
    first = lambda df, *by: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("h", "i"))).where(F.col("rn") <= SAMPLE_DOCS)
    sample = first(first(keys.distinct().withColumn("slice", F.pmod("h", F.lit(SLICES))), "l", "slice"), "l").select("i", "l")
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), "lang").join(F.broadcast(sample), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")))
    # an id may have many rows; of a language at most SAMPLE_DOCS texts come to the driver, of SAMPLE_CHARS each
    rows = rows.select("doc_id", "lang", spread(F.coalesce("text", F.lit("")), SAMPLE_CHARS).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= SAMPLE_DOCS).collect()
    return fit_rows([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text))])


def fit_rows(rows: list[tuple[str, str]]) -> Model:
    languages, is_letter = sorted({lang for lang, _ in rows}), letters_table()
    counts = np.zeros((len(languages), 1 << BITS))
    for lang, text in rows:
        for t, _ in pieces(text, is_letter):
            counts[languages.index(lang)] += np.bincount(t, minlength=1 << BITS)
    # what is seen in any language has mass in all
    p = counts + SMOOTHING + 0.5 * counts.sum(0) / max(1.0, counts.sum()) * 1000
    return Model(languages, np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32).copy())


def window_likelihoods(text: str, model: Model, is_letter: np.ndarray) -> tuple[np.ndarray, bool]:
    """Window x language; and whether there is a letter."""
    out, any_letter, rest = [], False, np.zeros(0, np.uint32)
    for t, found in pieces(text, is_letter):
        any_letter |= found
        t = np.concatenate([rest, t])
        full = len(t) // WINDOW * WINDOW
        if full:
            out.append(np.add.reduceat(model.log_p[t[:full]], np.arange(0, full, WINDOW), axis=0))
        rest = t[full:]
    if len(rest):
        out.append(model.log_p[rest].sum(0, keepdims=True))
    return (np.vstack(out) if out else np.zeros((0, len(model.languages)))), any_letter


def mixture(ll: np.ndarray) -> np.ndarray:
    """The languages' shares. ll: window x language, untempered."""
    n, k = ll.shape
    ll = TEMPER * (ll - ll.max(1, keepdims=True)).astype(float)
    total = ll.sum(0)
    chosen = [int(total.argmax())]
    shares = np.ones(1)
    best = total[chosen[0]]
    penalty = 3 * np.log(n + 1) + 2
    # where the leader leads in every window, no further language can gain anything
    while len(chosen) < k and best < -penalty:
        found = None
        for other in (x for x in range(k) if x not in chosen):
            p, value = _em(ll[:, [*chosen, other]])
            if found is None or value > found[1]:
                found = (p, value, other)
        if found[1] - best <= penalty:
            break
        shares, best = found[0], found[1]
        chosen.append(found[2])
    out = np.zeros(k)
    out[chosen] = shares
    return out


def _em(ll: np.ndarray) -> tuple[np.ndarray, float]:
    like = np.exp(ll)
    p = np.full(ll.shape[1], 1 / ll.shape[1])
    for _ in range(ROUNDS):
        r = like * p
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        p = r.mean(0)
    return p, float(np.log(np.maximum(like @ p, 1e-300)).sum())


def identify(text: str | None, model: Model, is_letter: np.ndarray) -> tuple[str, float]:
    if not text or not model.languages:
        return UNKNOWN, 0.0
    ll, any_letter = window_likelihoods(text, model, is_letter)
    if not any_letter:
        return UNKNOWN, 0.0
    shares = mixture(ll)
    k = int(shares.argmax())
    return model.languages[k], float(min(1.0, shares[k]))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row. Map only."""

    def run(batches):
        is_letter = letters_table()
        for b in batches:
            got = [identify(t, model, is_letter) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")


def classify(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
