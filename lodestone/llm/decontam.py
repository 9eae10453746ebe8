"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are read as lower-case words. Runs of MIN_MATCH words are seeds. What of a
document lies under seeds that any item has is kept as its runs; distinct runs are joined with the items by
shared seeds. Of each such pair the longest common run of words is marked first, found by running
Karp-Rabin over falling lengths, then the next longest whose words are unmarked on both sides, and so on:
tiles. The share of an item's words under tiles is its coverage, whatever the order in which its parts stand;
a document that covers an item to COVERAGE or more is contaminated.

The corpus is passed once, whatever the size of the benchmark: tasks hold a bitmap of the seeds' hashes, of
bounded size, which lets through what may be a seed; the join decides. A pair's tiling takes memory in
proportion to its words, however often they repeat. Equal texts are judged once.

A covered item has at least a fifth of its covered words as seed positions in the document (every tile of n
words has n - 4). So an item's commonest seeds, as long as they are fewer than that, need not bring about
pairs: a passage that many items share doesn't pair all documents that hold it with all of these items.

Defined results: null and blank texts are clean; an item or a text under MIN_MATCH words is one seed as a
whole, so a short item contaminates the documents that say just that, and no others; repeated documents
are judged alike; repeated items count once; with an empty benchmark all documents are clean.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, plain_names, written

TOKEN = re.compile(r"\w+")
MIN_MATCH, COVERAGE = 5, 0.8
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the seed filter: 64 for each seed, within these powers of two (16 MB at most); bits of a hash that a probe is cut from.
LEAST_BITS, MOST_BITS = 20, 27
#: Items that a task tiles a document with at once, on average.
GROUP = 64
#: Contaminated texts up to which their keys are broadcast; beyond, documents are shuffled to them.
BROADCAST_TEXTS = 1_000_000
WORDS_KNOWN = 400_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Hashes(dict):
    """Word to hash, never zero. Words recur, so a bounded cache serves most."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7) or 1
        return h

    def ids(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seeds_of(ids: np.ndarray) -> np.ndarray:
    """The hash of every MIN_MATCH words, modulo 2^64; of fewer words the hash of all, which no longer text has."""
    size = min(len(ids), MIN_MATCH)
    n = len(ids) - size + 1 if size else 0
    h = np.full(n, MIN_MATCH - size, np.uint64)
    for k in range(size):
        h = h * BASE + ids[k : k + n]
    return h ^ (h >> np.uint64(31))


def runs_of(ids: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The words under the seeds that hit, neighbouring ones together, with a zero between what isn't."""
    size = min(len(ids), MIN_MATCH)
    reach = np.zeros(len(ids) + 1, np.int64)
    np.add.at(reach, hit, 1)
    np.add.at(reach, hit + size, -1)
    inside = np.cumsum(reach[:-1]) > 0
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    return np.insert(ids[inside], np.cumsum(inside)[start][1:] - 1, 0)


class Windows:
    """Karp-Rabin hashes of all windows of any length, from prefix sums modulo 2^64."""

    def __init__(self, ids: np.ndarray, most: int):
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(most, BASE)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(ids * self.power[: len(ids)], dtype=np.uint64)]
        self.n, self.most = len(ids), most

    def of(self, length: int) -> np.ndarray:
        """hash of ids[j : j + length] by j, brought to the same power."""
        n = self.n - length + 1
        return (self.sums[length:] - self.sums[:n]) * self.power[self.most - np.arange(n)]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where windows of that length hold no mark."""
    upto = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(upto[length:] == upto[: len(marked) - length + 1])


def tile(item: np.ndarray, runs: np.ndarray) -> int:
    """Words of item under tiles. Of equally long matches those first in the item, then in the document, are laid first."""
    least = min(len(item), MIN_MATCH)
    most = max(len(item), len(runs))
    a, b = Windows(item, most), Windows(runs, most)
    on_item, on_runs = np.zeros(len(item), bool), runs == 0

    def matches(length: int):
        i, j = _free(on_item, length), _free(on_runs, length)
        hi, hj = a.of(length)[i], b.of(length)[j]
        j = j[np.isin(hj, hi)]
        return i, hi, j, b.of(length)[j]

    upper = min(len(item), len(runs))
    while upper >= least and len(matches(least)[2]):
        low, high = least, upper  # a match of low words there is; the longest is sought
        if len(matches(high)[2]):
            low = high
        while low < high:
            mid = (low + high + 1) // 2
            if len(matches(mid)[2]):
                low = mid
            else:
                high = mid - 1
        i, hi, j, hj = matches(low)
        order = np.lexsort((j, hj))
        j, hj = j[order], hj[order]
        first, last = np.searchsorted(hj, hi, "left").tolist(), np.searchsorted(hj, hi, "right").tolist()
        at = {}  # where the next try of a hash begins: marks only grow
        end = 0
        for x, lo, up in zip(i.tolist(), first, last, strict=True):
            if x < end or lo == up:
                continue
            k = at.get(lo, lo)
            while k < up:
                y = int(j[k])
                taken = np.flatnonzero(on_runs[y : y + low])
                if len(taken):
                    k = lo + int(np.searchsorted(j[lo:up], y + int(taken[-1]) + 1))
                elif np.array_equal(item[x : x + low], runs[y : y + low]):
                    on_item[x : x + low] = on_runs[y : y + low] = True
                    end = x + low
                    break
                else:  # equal hashes of different words
                    k += 1
            at[lo] = k
        upper = low - 1
    return int(on_item.sum())


def coverage(item: np.ndarray, runs: np.ndarray) -> float:
    """The share of item's words under tiles, or 0 if all seeds together cover less than COVERAGE."""
    mine = seeds_of(item)
    pieces = np.split(runs, np.flatnonzero(runs == 0))
    theirs = np.unique(np.concatenate([seeds_of(p[p != 0]) for p in pieces]))
    if len(runs_of(item, np.flatnonzero(np.isin(mine, theirs))).nonzero()[0]) < COVERAGE * len(item):
        return 0.0
    return tile(item, runs) / len(item)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, seeds, times): distinct items as hashed words, their distinct seeds, and how often each occurs in the item."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            ids = [hashes.ids(t) for t in b.column(1).to_pylist()]
            found = [np.unique(seeds_of(x), return_counts=True) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.view(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([s.view(np.int64) for s, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))],
                names=["item_id", "words", "seeds", "times"],
            )

    df = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return map_arrow(df, run, "item_id long, words array<long>, seeds array<long>, times array<long>").where("size(words) > 0").dropDuplicates(["item_id", "words"])


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap that holds the places of all seeds; and how many bits. Its size follows the number of seeds up to a bound."""
    n = seeds.count()
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(64 * n + 1)))))
    mixed = F.col("seed")
    for shift, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        mixed = mixed.bitwiseXOR(shift(mixed, by))
    places = [F.shiftrightunsigned(F.shiftleft(h, left), 64 - bits) for h in (F.col("seed"), mixed) for left in (0, MOST_BITS)]
    at = seeds.select(F.explode(F.array(*places)).alias("v"))
    parts = at.groupBy(F.shiftright("v", 15).alias("part")).agg(F.bitmap_construct_agg(F.expr("v & 32767")).alias("set"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, found in parts.collect():  # 4 KB each, at most 2 ^ (MOST_BITS - 15)
        out[part << 12 : (part + 1) << 12] = np.frombuffer(found, np.uint8)
    return out, bits


def may_be_seeds(h: np.ndarray, maybe: np.ndarray, bits: int) -> np.ndarray:
    """Where hashes have all four places (two cuts of the hash, and of a xorshift of it) in the filter: all seeds, and about one other hash in 70,000 while seeds are few enough for it."""
    at = np.arange(len(h))
    for shift in range(2):
        for left in (0, MOST_BITS):
            v = ((h[at] << np.uint64(left)) >> np.uint64(64 - bits)).astype(np.int64)
            at = at[(maybe[v >> 3] >> (v & 7).astype(np.uint8) & 1).astype(bool)]
        if shift or not len(at):
            return at
        h = h ^ (h << np.uint64(13))
        h = h ^ (h >> np.uint64(7))
        h = h ^ (h << np.uint64(17))


def seeded(documents: DataFrame, maybe: np.ndarray, bits: int) -> DataFrame:
    """doc_id, key (of the text), runs and their distinct seeds, for the rows that may have any. Map only."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            ids, keys, runs, seeds = [], [], [], []
            for doc_id, text, key in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True):
                words = hashes.ids(text)
                h = seeds_of(words)
                hit = may_be_seeds(h, maybe, bits)
                if len(hit):
                    ids.append(doc_id)
                    keys.append(key)
                    runs.append(runs_of(words, hit).view(np.int64))
                    seeds.append(np.unique(h[hit]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(runs, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["doc_id", "key", "runs", "seeds"])

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("key")).where("text IS NOT NULL")
    return map_arrow(rows, run, "doc_id long, key string, runs array<long>, seeds array<long>")


def pairing_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, item): the seeds that bring about pairs: an item's commonest ones, by the number of items that have
    them, are left out while they are fewer than the least number of seed positions that a covered item has."""
    each = items.select("item_id", "item", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item_id", "item", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    common = each.groupBy("seed").agg(F.count(F.lit(1)).alias("df"))
    before = Window.partitionBy("item").orderBy(F.col("df").desc(), "seed").rowsBetween(Window.unboundedPreceding, 0)
    least = F.when(F.col("n") < MIN_MATCH, 1).otherwise(F.ceil(F.ceil(COVERAGE * F.col("n")) / MIN_MATCH))
    ranked = each.join(common, "seed").withColumn("upto", F.sum("times").over(before))
    return ranked.where(F.col("upto") >= least).select("seed", "item_id", "item")


def judged(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may hold a seed (doc_id, key); and by key, for contaminated texts, item_id, coverage and n_items."""
    items = items_of(benchmark).withColumn("item", F.md5(F.concat_ws(",", "item_id", F.col("words").cast("array<string>"))))
    items = written(items, "benchmark-items")
    maybe, bits = seed_filter(items.select(F.explode("seeds").alias("seed")).distinct())
    rows = written(seeded(documents, maybe, bits), "seeded")
    texts = written(rows.groupBy("key").agg(F.first("runs").alias("runs"), F.first("seeds").alias("seeds")), "runs")
    pairs = texts.select("key", F.explode("seeds").alias("seed")).join(pairing_seeds(items), "seed").select("key", "item_id", "item").distinct()
    pairs = written(pairs, "tiling-pairs")
    # a document's runs are sent once for each GROUP of its items
    groups = pairs.join(pairs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")), "key").withColumn("g", F.pmod(F.xxhash64("item"), F.col("groups")))
    grouped = groups.join(items.select("item", "words"), "item").groupBy("key", "g").agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    work = texts.select("key", "runs").join(grouped.select("key", "items"), "key")

    def run(batches):
        for b in batches:
            out = []
            for key, runs, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                runs = runs.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for one in found:
                    item = one["words"].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    share = coverage(item, runs)
                    if share >= COVERAGE:
                        out.append((key, one["item_id"].as_py(), share))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "item_id", "coverage"])

    covered = map_arrow(work, run, "key string, item_id long, coverage double")
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "item_id")).alias("best")
    found = covered.groupBy("key").agg(best, F.countDistinct("item_id").alias("n_items"))
    return rows.select("doc_id", "key"), written(found.select("key", F.col("best.item_id").alias("item_id"), (-F.col("best.c")).alias("coverage"), "n_items"), "contaminated")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated rows: doc_id, the item covered best, its coverage, and the number of items covered."""
    rows, found = judged(documents, benchmark)
    return rows.join(found, "key").select("doc_id", F.lit(True).alias("contaminated"), "item_id", "coverage", "n_items")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated rows; columns and values are kept. Texts aren't shuffled unless contaminated ones are too many to broadcast."""
    _, found = judged(documents, benchmark)
    bad = found.select(F.col("key").alias("__dc_key"))
    few = bad.count() <= BROADCAST_TEXTS
    # a row without a text gets a key of its own kind and place, so that they don't meet in one task
    key = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    plain, named = plain_names(documents, "text")
    df = plain.withColumn("__dc_own", key)
    return df.join(F.broadcast(bad) if few else bad, F.col("__dc_own") == F.col("__dc_key"), "left_anti").transform(named)
