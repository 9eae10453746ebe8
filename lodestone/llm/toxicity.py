"""Toxicity by compression distance.

Two zstandard dictionaries are made of labelled text: one holds the commonest ordinary words, the other goes on
with words that toxic text holds significantly more often (zstandard's own training does worse; the README has
figures). Every window of a document (a word with the blanks around it) is compressed with both; the bytes that the toxic
dictionary saves are the window's gain. Gains at calibrated thresholds are counted over the whole
text and a logistic curve, fitted on the labelled rows, turns the counts into a probability.

Windows are written as UTF-16: two bytes a letter double the distance between a literal and a
dictionary match, which a byte-aligned compressor would otherwise lose in rounding.

Defined results: null and empty texts score like a text without any window; without a labelled row
of both classes every score is the share of toxic rows (0 with no labels); repeated documents are
scored each on its own; repeated labels count once, as toxic if any says so.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_sample, held_out, map_arrow, spread, trainable

TOKEN = re.compile(r"\w+")
ENCODING = "utf-16-le"
#: Bytes saved at which a window counts.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3
#: Bounds of the training sample: labelled documents of a class, and characters taken of each (in pieces spread over a longer one).
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 16_000
ORDINARY_BYTES, TOXIC_SEGMENTS = 160_000, 800
CACHE = 200_000
#: Training texts whose sketches of so many min-hashes agree in at least this share are copies.
SKETCH, COPY = 64, 0.5
MULTIPLIERS = np.random.default_rng(1).integers(1 << 62, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float


class Gains:
    """Bytes saved by the toxic dictionary, window by window. Windows recur, so a bounded cache serves most."""

    def __init__(self, model: Model):
        # The match finder is set to search all of the dictionary; the stock levels index it too thinly for short windows.
        p = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_BTOPT, window_log=18, hash_log=17, chain_log=17, search_log=8, min_match=3, target_length=256, write_content_size=False)
        self.pair = []
        for content in (model.ordinary, model.toxic):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.pair.append(zs.ZstdCompressor(compression_params=p, dict_data=d))
        self.known: dict[str, int] = {}

    def window(self, word: str) -> int:
        x = f" {word} ".encode(ENCODING, "replace")
        return max(0, len(self.pair[0].compress(x)) - len(self.pair[1].compress(x)))

    def counts(self, text: str | None) -> np.ndarray:
        """Windows at or over each threshold, then all windows."""
        known, got = self.known, Counter()
        for word, n in Counter(TOKEN.findall((text or "").lower())).items():
            g = known.get(word)
            if g is None:
                if len(known) >= CACHE:
                    known.clear()
                g = known[word] = self.window(word)
            got[g] += n
        return np.array([sum(n for g, n in got.items() if g >= t) for t in THRESHOLDS] + [sum(got.values())], float)


def features(counts: np.ndarray) -> np.ndarray:
    """Hits in all and to a hundred windows. Length by itself is no evidence, and clean texts of any length look alike."""
    hits, n = counts[:, :-1], np.maximum(counts[:, -1:], 1)
    return np.hstack([np.log1p(hits), np.log1p(100 * hits / n)])


def outline(text: str) -> tuple[np.ndarray, set[str]]:
    """Min-hashes of the text's word triples, which estimate how many two texts share, and its words."""
    words = TOKEN.findall(text.lower())
    triples = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))}
    mixed = np.fromiter(triples, np.uint64, len(triples))[:, None] * MULTIPLIERS
    return ((mixed ^ (mixed >> np.uint64(29))) * MULTIPLIERS >> np.uint64(32)).min(0), set(words)


def leaders(sketches: list[np.ndarray]) -> list[int]:
    """For each sketch the first one that leads and is estimated to share at least COPY of the triples; else itself."""
    out: list[int] = []
    heads, rows = [], np.zeros((len(sketches), SKETCH), np.uint64)
    for i, sketch in enumerate(sketches):
        like = np.flatnonzero((rows[: len(heads)] == sketch).mean(1) >= COPY)
        if len(like):
            out.append(heads[like[0]])
        else:
            rows[len(heads)] = sketch
            heads.append(i)
            out.append(i)
    return out


def train_dictionaries(outlines: list[tuple[int, set[str]]], toxic: list[int]) -> tuple[bytes, bytes]:
    """The ordinary dictionary holds the commonest ordinary words, commonest last. The toxic one goes
    on with the words that toxic documents hold significantly more often, most significant last.
    outlines: the kind and the words of each text. Those of a kind are copies and count once in each class: what a copied document says is no more toxic for it."""
    seen, kinds = [Counter(), Counter()], [set(), set()]
    for (kind, words), y in zip(outlines, toxic, strict=True):
        if kind not in kinds[y]:
            kinds[y].add(kind)
            seen[y].update(words)
    n0, n1 = max(1, len(kinds[0])), max(1, len(kinds[1]))

    def z(w: str) -> float:
        p = (seen[0][w] + seen[1][w]) / (n0 + n1)
        return (seen[1][w] / n1 - seen[0][w] / n0) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))

    def chosen(least: float) -> list[str]:
        found = [(z(w), w) for w, n in seen[1].items() if n > 2 and n / n1 > 3 * seen[0][w] / n0]
        return [w for s, w in sorted(found) if s > least][-TOXIC_SEGMENTS:]

    bad = chosen(5) or chosen(3)
    skip = set(bad)
    good = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[: ORDINARY_BYTES // 8] if w not in skip]
    ordinary = (" " + " ".join(reversed(good)) + " ").encode(ENCODING, "replace")[-ORDINARY_BYTES:]
    return ordinary, ordinary + (" " + " ".join(bad) + " ").encode(ENCODING, "replace")


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - w)
    return mean, scale, w


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & trainable()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = hash_sample(known.where("toxic = 1"), "doc_id", SAMPLE_DOCS).unionByName(hash_sample(known.where("toxic = 0"), "doc_id", SAMPLE_DOCS))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", spread(F.col("text"), SAMPLE_CHARS).alias("text"), "toxic")
    # an id may have many rows; at most 2 x SAMPLE_DOCS texts come to the driver, of SAMPLE_CHARS each
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit_rows([r.text for r in rows], [int(r.toxic) for r in rows], share)


def fit_rows(texts: list[str], toxic: list[int], share: float) -> Model:
    if len(set(toxic)) < 2:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), share)
    # The dictionaries and the curve come from different halves, else the curve would trust what the dictionaries know by heart.
    sketched = [outline(t) for t in texts]
    kinds = leaders([o[0] for o in sketched])
    outlines = [(k, o[1]) for k, o in zip(kinds, sketched, strict=True)]
    half = [int(sketched[k][0][0]) % 2 for k in kinds]  # copies on one side
    parts = []
    for side in (0, 1):
        pick = [i for i, h in enumerate(half) if h == side]
        o, t = train_dictionaries([outlines[i] for i in pick], [toxic[i] for i in pick])
        gains = Gains(Model(o, t, *[np.zeros(0)] * 3, share))
        parts.append((np.array([gains.counts(texts[i]) for i, h in enumerate(half) if h != side]), [toxic[i] for i, h in enumerate(half) if h != side]))
    x, y = features(np.vstack([p[0] for p in parts])), np.array(sum((p[1] for p in parts), []), float)
    mean, scale, w = fit_logistic(x, y)
    # The sample holds the classes in other shares than the labels do; the intercept is set back to the labels' share.
    got = min(max(y.mean(), 1e-6), 1 - 1e-6)
    real = min(max(share, 1e-6), 1 - 1e-6)
    w[-1] += logit(real) - logit(got)
    w[-1] += logit(THRESHOLD) - logit(best_threshold(scores(np.vstack([p[0] for p in parts]), Model(b"", b"", mean, scale, w, share)), y, real / got, (1 - real) / (1 - got)))
    o, t = train_dictionaries(outlines, toxic)
    return Model(o, t, mean, scale, w, share)


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def best_threshold(p: np.ndarray, y: np.ndarray, toxic_weight: float, ordinary_weight: float) -> float:
    """The probability that splits the classes best (F1, with the classes weighted to their real shares)."""
    order = np.argsort(-p, kind="stable")
    hit, miss = np.cumsum(y[order] * toxic_weight), np.cumsum((1 - y[order]) * ordinary_weight)
    f1 = 2 * hit / (hit + miss + (y * toxic_weight).sum())
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else p[order][k]
    return float(min(max((p[order][k] + below) / 2, 0.02), 0.9))


def scores(counts: np.ndarray, model: Model) -> np.ndarray:
    if not len(model.weight):
        return np.full(len(counts), model.prior)
    z = np.hstack([(features(counts) - model.mean) / model.scale, np.ones((len(counts), 1))]) @ model.weight
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the windows that counted, one row for each row of documents. Map only: no shuffle."""

    def run(batches):
        gains = Gains(model) if len(model.weight) else None
        for b in batches:
            c = np.array([gains.counts(t) if gains else np.zeros(len(THRESHOLDS) + 1) for t in b.column(1).to_pylist()]).reshape(-1, len(THRESHOLDS) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(c, model)), pa.array(c[:, 1].astype(np.int64)), pa.array(c[:, -1].astype(np.int64))], names=["doc_id", "score", "n_hits", "n_windows"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, n_hits long, n_windows long")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(documents, fit(documents, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "n_windows")
