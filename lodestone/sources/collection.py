"""A keyed collection that is merged into by copying the buckets that a merge touches.

Rows lie in buckets by a hash of their key, so evenly, each written by one task: as many as make one fit into it. A list names the folder of each bucket, and what was merged last; a merge writes
the buckets that its rows fall into anew, beside the old ones, and then the next list, whole or not at all. A reader opens
the newest list, so it sees all of a merge or nothing of it. Lists are numbered and never replaced: of two merges at once the
second fails, and can be run again. A merge that is run again writes the same rows; a batch of a stream is merged once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BUCKETS = 64
#: Lists whose buckets tidy leaves, for readers that opened them.
KEPT = 2


@dataclass(frozen=True)
class Listing:
    number: int
    key: str
    schema: StructType
    buckets: int
    places: dict[int, str]  # by bucket, the folder under the collection
    batch: int | None  # of a stream, the last one merged


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        folder = self._file("lists")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n.isdigit())

    def listing(self, number: int | None = None) -> Listing:
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no collection at {self.path}")
        number = numbers[-1] if number is None else number
        said = json.loads(self.spark.read.text(f"{self.path}/lists/{number:012d}", wholetext=True).first()[0])
        return Listing(number, said["key"], StructType.fromJson(said["schema"]), said["buckets"], {int(b): p for b, p in said["places"].items()}, said["batch"])

    def _publish(self, new: Listing) -> None:
        body = json.dumps({"key": new.key, "schema": new.schema.jsonValue(), "buckets": new.buckets, "places": new.places, "batch": new.batch})
        part = self._file(f"lists/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(body.encode()))
        out.close()
        target = self._file(f"lists/{new.number:012d}")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise RuntimeError(f"another merge has written {target}")

    def create(self, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        """The collection of rows; of those that share a key one stays."""
        if self._numbers():
            raise FileExistsError(f"there is a collection at {self.path}")
        self._publish(self._merged(Listing(-1, key, rows.schema, buckets, {}, None), rows, None))

    def read(self, number: int | None = None) -> DataFrame:
        now = self.listing(number)
        return self._read(now, now.places.values())

    def _read(self, now: Listing, places) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in places]
        return self.spark.read.schema(now.schema).parquet(*paths) if paths else self.spark.createDataFrame([], now.schema)

    def merge(self, rows: DataFrame, batch: int | None = None) -> Listing:
        """Puts rows in place of those of the same key; says what the collection then is. batch: a stream's number of it."""
        now = self.listing()
        if batch is not None and now.batch is not None and batch <= now.batch:
            return now
        new = self._merged(now, rows, batch)
        self._publish(new)
        return new

    def _merged(self, now: Listing, rows: DataFrame, batch: int | None) -> Listing:
        names = now.schema.names
        # rows of a bucket meet in one task, where new ones go before old ones and one of each key stays: picked by a hash, the
        # same on every run. They are shuffled once and written once; only what is merged into other rows is written before,
        # to tell which buckets it touches.
        folder, bucket = f"data/{uuid.uuid4().hex}", F.pmod(F.xxhash64(now.key), F.lit(now.buckets)).cast("int").alias("__bucket")
        every, fresh = rows.select(*names, bucket, F.lit(1).alias("__new")), f"{self.path}/{folder}-new"
        if now.places:
            every.drop("__new").write.partitionBy("__bucket").parquet(fresh)
            touched = self._touched(fresh)
            part = lambda places, new: self._read(now, places).select(*names, bucket, F.lit(new).alias("__new"))
            every = part([f"{folder}-new/__bucket={b}" for b in touched], 1).unionByName(part([now.places[b] for b in touched if b in now.places], 0))
        one = every.repartition(now.buckets, "__bucket").groupBy("__bucket", F.col(now.key).alias("__key")).agg(F.max_by(F.struct(*names), F.struct("__new", F.xxhash64(*names))).alias("r"))
        one.select("r.*", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        self._fs.delete(self._hadoop.Path(fresh), True)
        touched = self._touched(f"{self.path}/{folder}")
        return Listing(now.number + 1, now.key, now.schema, now.buckets, now.places | {b: f"{folder}/__bucket={b}" for b in touched}, now.batch if batch is None else batch)

    def _touched(self, folder: str) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(folder)))
        return sorted(int(n.removeprefix("__bucket=")) for n in names if n.startswith("__bucket="))

    def tidy(self, kept: int = KEPT) -> None:
        """Deletes the buckets that none of the last lists names, and older lists."""
        numbers = self._numbers()
        named = {p for n in numbers[-kept:] for p in self.listing(n).places.values()}
        for version in self._fs.listStatus(self._file("data")) if self._fs.exists(self._file("data")) else ():
            for part in self._fs.listStatus(version.getPath()):
                place = f"data/{version.getPath().getName()}/{part.getPath().getName()}"
                if place not in named and part.isDirectory():
                    self._fs.delete(part.getPath(), True)
        for n in numbers[:-kept]:
            self._fs.delete(self._file(f"lists/{n:012d}"), False)

    def merge_stream(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges what has come since the last run, batch by batch, each once."""
        return rows.writeStream.foreachBatch(lambda batch, n: self.merge(batch, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
