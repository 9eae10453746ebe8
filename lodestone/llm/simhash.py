"""Near-duplicates by SimHash, found with deletion-variant signatures.

64-bit fingerprints at 4 or fewer differing bits are linked. Cut into three segments, at least one
segment of such a pair differs by at most one bit (4 bits over 3 segments). Every fingerprint is
therefore indexed under each segment as it is, and under each segment with one bit wiped out; the
index sides that hold a 0 and a 1 in the wiped bit are equality-joined and verified by the whole
distance. A pair is emitted by the first segment that allows it, so once.

Only distinct fingerprints take part, however many documents share one: copies are never paired.
Components come from rounds of large-star and small-star contraction, cut by written tables. All joins are
merge joins: fingerprints, links and components grow with the input, so none of them is broadcast, which
would take each through the driver's memory, round by round.

Defined results: null and blank texts have fingerprint zero and are linked like any other; rows with
the same id are one document each and share the link of their own fingerprint; a null doc_id gets the
smallest id of its component, null if there is none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.common import map_arrow, plain_names, written

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (offset, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_ROUNDS = 60


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: only A-Z fold, only ASCII blanks split
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = len(words) - SHINGLE + 1
    s, e = start[:n].tolist(), (start[SHINGLE - 1 :] + size[SHINGLE - 1 :]).tolist()
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * set_bits > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long), a row for each row of documents."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def _mask(of: int) -> int:
    at, width = SEGMENTS[of]
    m = ((1 << width) - 1) << at
    return m - (1 << 64) if m >= 1 << 63 else m


def _by_segment(idx: Column, values: list[int]) -> Column:
    """values[s] of the segment s that the variant idx belongs to: 0..63 wipe that bit, 64.. are whole segments."""
    out = F.lit(values[-1])
    for s in reversed(range(len(SEGMENTS) - 1)):
        out = F.when((idx < SEGMENTS[s][0] + SEGMENTS[s][1]) | (idx == 64 + s), F.lit(values[s])).otherwise(out)
    return out


def _variants(fps: DataFrame, bit: int) -> DataFrame:
    """(k, fp): whole segments, and the wiped variants of those bits whose value is bit."""
    idx = F.col("__v")
    own = F.when(idx >= 64, F.lit(bit)).otherwise(F.expr("cast(shiftrightunsigned(fp, __v) & 1 as int)"))
    kept = F.expr("CASE WHEN __v >= 64 THEN fp ELSE fp & ~shiftleft(1L, __v) END")
    fps = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63 + len(SEGMENTS)))).alias("__v")).where(own == bit)
    masked = kept.bitwiseAND(_by_segment(idx, [_mask(s) for s in range(len(SEGMENTS))]).cast("long"))
    fps = fps.select("fp", "__v", masked.alias("__m"), _by_segment(idx, [at for at, _ in SEGMENTS]).cast("int").alias("__at"))
    return fps.select(F.expr("shiftrightunsigned(__m, __at) | shiftleft(cast(__v as bigint), 24)").alias("k"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at DISTANCE or less, each once. fps: distinct (fp)."""
    left = _variants(fps, 0).withColumnRenamed("fp", "a")
    right = _variants(fps, 1).withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    seg = lambda s: F.bit_count(x.bitwiseAND(F.lit(_mask(s)).cast("long")))
    idx = F.shiftrightunsigned("k", 24)
    # a whole-segment match counts from one side only, and only the first segment that allows the pair emits it
    earlier = [F.when(_by_segment(idx, list(range(len(SEGMENTS)))) > s, seg(s) > 1).otherwise(True) for s in range(len(SEGMENTS) - 1)]
    once = F.when(idx >= 64, F.col("a") < F.col("b")).otherwise(True)
    near = reduce(lambda p, q: p & q, earlier, F.bit_count(x) <= DISTANCE)
    return left.join(right.hint("merge"), "k").where(near & once).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == mark:
            break
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(prints: DataFrame, rep: Column) -> DataFrame:
    """fp, rep (aggregated over the rows that have it) and root (that of its component) for every fingerprint of prints."""
    fps = written(prints.groupBy("fp").agg(rep.alias("rep")), "distinct-fingerprints")
    cc = components(links(fps.select("fp")))
    return written(fps.join(cc.hint("merge"), fps["fp"] == cc["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")


def dedup_components(documents: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every row of documents."""
    docs = written(fingerprints(documents), "fingerprints")
    rooted = _rooted(docs, F.min("doc_id"))
    # written, so that the join deals out both sides for itself and may split the fingerprints of a large component
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = written(rooted.join(least.hint("merge"), "root").select("fp", "component_id"), "components")
    return docs.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    return dedup_components(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_fingerprints(documents: DataFrame) -> DataFrame:
    """documents with __ls_fp, the fingerprint of their text."""
    at = documents.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "__ls_fp"])

    return map_arrow(documents, run, StructType([*documents.schema.fields, StructField("__ls_fp", LongType())]))


def keep_one(documents: DataFrame) -> DataFrame:
    """Documents without the copies: of each component one row stays, one with the smallest id, or any where none
    has an id; of rows that share it the first by a hash of the text, then by place. So rows that share an id, or have
    none, replace each other only if they are linked. Columns and their values are kept. Rows are written once with
    their fingerprints and a number of their own; which rows stay is decided on those alone, and texts are shuffled
    once, by number, so evenly whatever ids and copies there are."""
    plain, named = plain_names(documents, "doc_id", "text")
    numbered = _with_fingerprints(plain).withColumn("__ls_row", F.monotonically_increasing_id())
    whole = written(numbered, "with-fingerprints")
    own = whole.select("doc_id", F.col("__ls_fp").alias("fp"), F.xxhash64("text").alias("h"), F.col("__ls_row").alias("row"))
    rooted = _rooted(own, F.min(F.struct(F.isnull("doc_id"), "doc_id", "h", "row")))
    kept = written(rooted.groupBy("root").agg(F.min("rep").alias("s")).select(F.col("s.row").alias("__ls_kept")), "kept")
    return whole.join(kept.hint("merge"), F.col("__ls_row") == F.col("__ls_kept"), "left_semi").transform(named)
