"""Exact top-k by blocks: rows are packed into blocks, each block of queries meets each block of the searched rows in one
task, and tasks keep k hits a query. Nothing passes through the driver; work is shuffled as blocks, results as k rows. A task
holds one block of searched rows at a time, beside the queries of its part and their hits."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import BLOCK_ROWS, map_arrow, written

#: Rows and bytes of a block of searched rows and of queries, at most; blocks of a part, about.
ROWS, QUERY_ROWS, BYTES, PART_BLOCKS = 8192, 1024, 2 << 20, 32
#: Parts that the blocks of queries are dealt into, at most, as long as a part has PART_BLOCKS or less.
QUERY_PARTS = 64
#: Vectors and queries of a list that meet in one group, about.
PART_ROWS, GROUP_ROWS = 4 * 8192, 16 * 1024
PLACES = 6


def rounded(x: np.ndarray) -> np.ndarray:
    """x as Spark's round(x, 6) has it: halves of the shortest decimal form go away from zero."""
    y = x * 10.0**PLACES
    out = np.floor(y + 0.5) / 10.0**PLACES + 0.0
    for i in np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-4) | (np.abs(y) > 1e12)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP))
    return out


def packed(rows: DataFrame, key: str, most: int, tag: str) -> DataFrame:
    """rows (key, embedding), all embeddings of one length, as written blocks (ids, data)."""
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    id_type = rows.schema[key].dataType.simpleString()

    def run(batches):
        ids, data, n, size = [], [], 0, 0

        def block():
            got = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), got), pa.array([b"".join(data)], pa.binary())], names=["ids", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0))
            data.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
            n, size = n + b.num_rows, size + len(data[-1])
            if n + b.num_rows > most or size > BYTES:
                yield block()
                ids, data, n, size = [], [], 0, 0
        if n:
            yield block()

    return written(map_arrow(rows.select(key, "embedding"), run, f"ids array<{id_type}>, data binary"), tag, BLOCK_ROWS)


def kept_best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: highest scores, lowest ids; in order of the groups."""
    by_id = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((by_id, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]


class Best:
    """The k best hits so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        if self.ids is not None:
            q, score, ids = np.r_[self.q, q], np.r_[self.score, score], np.concatenate([self.ids, ids])
        stay = kept_best(q, score, ids, self.k)
        self.q, self.score, self.ids = q[stay], score[stay], ids[stay]
        full = np.bincount(self.q, minlength=self.n) >= self.k
        low = np.full(self.n, np.inf)
        np.minimum.at(low, self.q, self.score)
        self.least = np.where(full, low, -np.inf)

    def meet(self, q: np.ndarray, q32: np.ndarray, q_norm: np.ndarray, v: np.ndarray, ids: pa.Array) -> None:
        """Adds the hits of the queries (q: dimensions by queries, in double precision) among a block of vectors (v). Products in
        single precision say which pairs can be among the best; those are summed in double precision, in order."""
        dim = len(q)
        slack = 2 * (dim + 4) * 6e-8 * q_norm * np.linalg.norm(v.astype(float), axis=1).max() + 2 * 10.0**-PLACES
        at_q, at_v = candidates(q32 @ v.astype(np.float32).T, self.least, slack, self.k)
        if len(at_q):
            vd, score = v.astype(float).T.copy(), np.zeros(len(at_q))
            for d in range(dim):
                score += vd[d][at_v] * q[d][at_q]
            self.add(at_q, rounded(score), ids.to_numpy(zero_copy_only=False)[at_v])


def candidates(near: np.ndarray, least: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of near (queries by rows), scores that err by less than half of slack, which may be among the k best."""
    low = least - slack
    mask = near >= np.nextafter(low.astype(near.dtype), near.dtype.type(-np.inf))[:, None]
    if near.shape[1] > k and np.count_nonzero(mask) > 4 * k * len(near):
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        low = np.maximum(low, kth - slack)
        mask = near >= np.nextafter(low.astype(near.dtype), near.dtype.type(-np.inf))[:, None]
    return np.nonzero(mask)


def met(queries: DataFrame, rows: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Every block of rows beside every block of queries (block, ...), dealt so that all cores have work. Spark holds the right
    side of a part and passes the left one row by row, so the left is the one with large blocks. Blocks of rows that are
    scanned in enough parts (scanned: the table, if rows are joined to it) are read where they lie, unshuffled."""
    scanned = rows if scanned is None else scanned
    cores, n_queries, n_rows = rows.sparkSession.sparkContext.defaultParallelism, queries.count(), scanned.count()  # blocks, not rows
    query_parts = max(1, min(QUERY_PARTS, n_queries), -(-n_queries // PART_BLOCKS))
    row_parts = max(1, min(n_rows, -(-2 * cores // query_parts)), -(-n_rows // PART_BLOCKS))
    if scanned._jdf.queryExecution().toRdd().getNumPartitions() < row_parts:
        rows = rows.repartition(row_parts)
    return rows.hint("shuffle_replicate_nl").crossJoin(queries.repartition(query_parts).hint("shuffle_replicate_nl"))


def own(x: pa.Array) -> pa.Array:
    """A copy that doesn't hold the batch that x is a part of."""
    return x.take(pa.array(np.arange(len(x))))


def nearest(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, id, score): for each query the k best of each part of the vectors. All vectors have dim finite values."""
    q_kind, v_kind = ("<f4" if t.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8" for t in (queries, vectors))
    q_type, v_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    asked = packed(queries, "query_id", QUERY_ROWS, "query-blocks").select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("query_ids"), F.col("data").alias("q"))
    pairs = met(asked, packed(vectors, "id", ROWS, "vector-blocks"))

    def run(batches):
        part = {}  # of each block of queries, what is needed of it and its hits so far
        for b in batches:
            for i in range(b.num_rows):
                ids, block = b.column(0)[i].values, b.column(2)[i].as_py()
                arrow_id = ids.type
                if block not in part:
                    q = np.frombuffer(b.column(4)[i].as_py(), q_kind).reshape(-1, dim)
                    part[block] = own(b.column(3)[i].values), q.astype(float).T.copy(), q.astype(np.float32), np.linalg.norm(q.astype(float), axis=1), Best(len(q), k)
                _, q, q32, q_norm, best = part[block]
                best.meet(q, q32, q_norm, np.frombuffer(b.column(1)[i].as_py(), v_kind).reshape(-1, dim), ids)
        for query_ids, *_, best in part.values():
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(best.q)), pa.array(best.ids, arrow_id), pa.array(best.score)], names=["query_id", "id", "score"])

    return map_arrow(pairs, run, f"query_id {q_type}, id {v_type}, score double")


def nearest_in_lists(vectors: DataFrame, queries: DataFrame, sizes: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """(query_id, id, score): for each query (query_id, list, embedding) the k best of each list that it asks for, of vectors
    (list, id, embedding) that stand in one list each. sizes: of each list, its vectors and the queries that ask for it. A long
    list is cut into parts, the queries of one that many ask for into groups, and every group meets every part in a
    group of its own, so what one task holds and does has a bound. All embeddings have one length, or are left to fail."""
    q_type, v_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    parts = {x: (-(-v // PART_ROWS), -(-q // GROUP_ROWS)) for x, (v, q) in sizes.items() if v and q}
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {q_type}, id {v_type}, score double")
    known = F.create_map(*[F.lit(x) for n, (v, q) in parts.items() for x in (n, v * 65536 + q)])  # a number for each list
    cut = lambda df: df.withColumn("__n", known[F.col("list")]).where("__n IS NOT NULL").withColumns({"__v": F.shiftright("__n", 16), "__q": F.col("__n").bitwiseAND(65535)})
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    keys, tasks = ["list", "part", "group"], max(vectors.sparkSession.sparkContext.defaultParallelism * 4, 1)
    v = cut(vectors).select("list", deal("id", "__v").alias("part"), every("__q").alias("group"), "id", "embedding")
    q = cut(queries).select("list", every("__v").alias("part"), deal("query_id", "__q").alias("group"), "query_id", "embedding")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.stack(t.column("embedding").combine_chunks().to_numpy(zero_copy_only=False))
            all_v, all_q, v_ids = matrix(left), matrix(right), left.column("id").combine_chunks()
            for i in range(0, len(all_q), QUERY_ROWS):
                some = all_q[i : i + QUERY_ROWS]
                query_ids, best = right.column("query_id").combine_chunks()[i : i + len(some)], Best(len(some), k)
                q32, q_norm, qd = some.astype(np.float32), np.linalg.norm(some.astype(float), axis=1), some.astype(float).T.copy()
                for j in range(0, len(all_v), ROWS):
                    best.meet(qd, q32, q_norm, all_v[j : j + ROWS], v_ids[j : j + ROWS])
                if best.ids is not None:
                    found.append(pa.table({"query_id": query_ids.take(pa.array(best.q)), "id": pa.array(best.ids, v_ids.type), "score": best.score}))
        return pa.concat_tables(found) if found else pa.table({"query_id": right.column("query_id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})

    return v.repartition(tasks, *keys).groupBy(*keys).cogroup(q.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, f"query_id {q_type}, id {v_type}, score double")
