"""WARC archives of pages, read back and indexed by an external merge.

A record is UTF-8 headers, a payload and a closing CRLF CRLF, compressed as a gzip member of its own, so that
it can be read by its offset. Archives are filled to FILE_BYTES and written by Spark's text writer, a row to a
file, so tasks commit whole files or nothing. (A member ends with its length, whose last byte is zero below
16 MB; that byte is the writer's line end. Longer records take several members.) Equal payloads are stored
once: the record of the largest page_id is a response, the others are revisits. Which is which comes from
digests alone; payloads are shuffled once, by page_id and digest.

Reading parses archives member by member, checks the digest of every stored payload, and leaves a capture run
per archive, sorted by URL key and timestamp. The runs are dealt into ranges of that order and each range is
merged by a loser tree, which gives capture histories in global order.

Defined results: null html has an empty payload; null urls have no target header and sort first; records
with a null page_id are written, are no one's response if another has the same payload, and come back
with a null page_id; rows that repeat both id and payload give one record each, all of the same type, each
with a record id of its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_path, map_arrow, written

CRLF = "\r\n"
#: Bytes at which an archive file is full, bytes of a record that a gzip member takes at most, bytes unpacked at a time.
FILE_BYTES, MEMBER_BYTES, CHUNK = 32 << 20, 8 << 20, 1 << 16
#: Captures that one merging task holds.
RANGE_CAPTURES = 50_000
PAGE, REFERRED = "X-Page-ID", "X-Refers-To-Page-ID"
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, run string, place long"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in upper-case base32: 160 bits are four groups of 40, each eight digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), BASE32_FROM, BASE32_TO)


def captured(page_id: Column) -> Column:
    """The tables hold no capture time; ids stand for seconds."""
    at = F.timestamp_seconds(F.lit(1704067200).cast("long") + F.coalesce(page_id, F.lit(0).cast("long")) % 1_000_000_000)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """A column value: the record as bytes, but for its first line and its id."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    df = df.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    slim = df.select("page_id", "digest", "url")
    first = slim.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"))  # a null id is the least
    # (page_id, digest) is never null: rows without an id are told apart from all ids
    chosen = slim.select("page_id", "digest").distinct().join(first, "digest").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first.page_id").alias("keeper"), F.col("first.url").alias("keeper_url"))
    df = df.join(chosen, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    length = F.octet_length("html")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    address = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7f]+", "%20")
    head = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"{PAGE}: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Date: "), captured(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), address("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.concat(F.lit(f"{REFERRED}: "), F.col("keeper").cast("string"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), address("keeper_url"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), captured(F.col("keeper")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return df.select(F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block, F.lit(CRLF * 2)).cast("binary").alias("value"))


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str) -> None:
    """Archive files under path, a gzip member for each record."""
    archive = uuid.uuid4()

    def pack(batches):
        task, n, size, full = TaskContext.get().partitionId(), 0, 0, []

        def file():
            content = b"".join(full)
            assert content.endswith(b"\0")
            return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], names=["value"])

        for b in batches:
            for value in b.column(0):
                record = f"WARC/1.1{CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid5(archive, f'{task}:{n}')}>{CRLF}".encode() + value.as_py()
                n += 1
                members = [member(record[at : at + MEMBER_BYTES]) for at in range(0, len(record), MEMBER_BYTES)]
                full += members
                size += sum(map(len, members))
                if size >= FILE_BYTES:
                    yield file()
                    size, full = 0, []
        if full:
            yield file()

    files = map_arrow(records(pages), pack, "value binary").select(F.col("value").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def members(data: bytes):
    """(offset, content) of every gzip member. Raises on one that breaks off."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, start, out = zlib.decompressobj(31), at, []
        while not z.eof:
            if at >= len(view):
                raise ValueError(f"the member at byte {start} breaks off")
            out.append(z.decompress(view[at : at + CHUNK]))
            at = min(at + CHUNK, len(view))
        at -= len(z.unused_data)
        yield start, b"".join(out)


def parse(data: bytes):
    """(offset, headers, block) of every record of an archive. Raises on a record that breaks off."""
    begun, parts, missing = 0, [], 0
    for at, content in members(data):
        if not parts:
            end = content.find(b"\r\n\r\n")
            if not content.startswith(b"WARC/") or end < 0:
                raise ValueError(f"no record at byte {at}")
            head = {k.lower(): v for k, _, v in (x.partition(": ") for x in content[:end].decode("utf-8").split(CRLF)[1:])}
            begun, missing = at, end + 4 + int(head["content-length"]) + 4
        parts.append(content)
        missing -= len(content)
        if missing < 0:
            raise ValueError(f"the record at byte {begun} is longer than it says")
        if not missing:
            whole = b"".join(parts)
            if not whole.endswith(b"\r\n\r\n"):
                raise ValueError(f"the record at byte {begun} has no end")
            yield begun, head, whole[end + 4 : -4]
            parts = []
    if parts:
        raise ValueError(f"the record at byte {begun} breaks off")


def _page(said: str | None) -> int | None:
    return None if said is None else int(said)


def capture(run: str, place: int, head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD but for the URL key. A stored payload must have the digest that its header says."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
    said = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
            raise ValueError(f"{run}: the payload at byte {place} is damaged")
    return _page(head.get(PAGE.lower())), head.get("warc-target-uri"), size, said, head["warc-type"], _page(head.get(REFERRED.lower())), head["warc-date"], run, place


def surt(url: str | None) -> str:
    if url is None or "://" not in url:
        return ""
    rest = url.partition("://")[2].partition("#")[0]
    end = next((i for i, c in enumerate(rest) if c in "/?"), len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def _order(row: tuple) -> tuple:
    """URL key, timestamp, then id, run and place for a total order. row: by RECORD."""
    return row[6], row[7], row[0] is not None, row[0] or 0, row[8], row[9]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives; those of one archive are one run, sorted."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "run", "place"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name, rows = file.rpartition("/")[2], []
                for place, head, block in parse(content.as_py()):
                    c = capture(name, place, head, block)
                    rows.append((*c[:6], surt(c[1]), *c[6:]))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_arrow(files, run, RECORD)


class LoserTree:
    """Merges k sorted runs: inner nodes hold the losers of their matches, so each next row costs log k comparisons."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [self._key(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _key(self, i: int):
        """None once the run is empty: it loses to all."""
        return self.key(self.runs[i][self.at[i]]) if i < len(self.runs) and self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(b, a):
            a, b = b, a
        self.tree[node] = b
        return a

    def __iter__(self):
        while self.head[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self._key(w)
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures in global order of URL key and timestamp: partition after partition, row after row."""
    names = runs.columns
    ranges = max(1, -(-runs.count() // RANGE_CAPTURES))

    def merge(batches):
        by: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)], strict=True):
                by.setdefault(row[8], []).append(row)
        types = [f.type for f in schema]
        out: list[tuple] = []
        for row in LoserTree([by[k] for k in sorted(by)], _order):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("run", pa.string()), ("place", pa.int64())])
    # the id in the range key splits the captures of one URL, however many there are
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "place").sortWithinPartitions("run", "url_key", "captured", F.col("page_id").asc_nulls_first(), "place")
    return map_arrow(dealt, merge, RECORD)


def archive_and_index(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return merge_runs(written(read_runs(spark, path), "capture-runs"))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes::BIGINT AS payload_bytes, translate({" || ".join(f"lpad(to_base(('0x' || substr(h, {at}, 10))::BIGINT, 32), 8, '0')" for at in (1, 11, 21, 31))}, '{BASE32_FROM}', '{BASE32_TO}') AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""
