"""Intermediate tables in the folder that all executors share, and bounded batches for Python operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker is handed at once, at most; a session that asks for less is left alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: For tables whose rows are blocks of megabytes: every row is a row group. Spark reads a row group's rows at once, 4096 at most, and
#: Parquet's writer looks at sizes after a hundred rows only, so that a file of blocks would be held whole on either side.
BLOCK_ROWS = {"parquet.block.row.count.limit": "1"}

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where that is unset a folder of our own serves, but only
    if all executors are threads of this process (tests); it goes when the process ends."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again, so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, tag)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1; the order must tell all rows apart. Rows are dealt into ranges and put in
    order inside, counts by range say where each one's places begin: nothing is ordered in one task."""
    place = F.monotonically_increasing_id()
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return parts.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def version(df: DataFrame) -> str:
    """Names the files that df is read from, by their paths, sizes and times: another name if one of them changes."""
    each = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = each.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}"


def kept(spark: SparkSession, tag: str, sources: list[DataFrame], build: Callable[[str], None]) -> str:
    """The folder of something that is built once from these tables, whatever number of queries of the application use it,
    and anew if a file of theirs changes. It counts as built when the mark that is written last is there."""
    name = re.sub(r"\W+", "-", "-".join([tag, *[version(t) for t in sources]]))
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_BUILT")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(mark):
        build(path)
        fs.create(mark, True).close()
    return path


def clean_up(spark: SparkSession) -> None:
    """Deletes every intermediate table that this application has written; call it when the results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is handed at once, so that its memory doesn't follow the length of the rows. The bounds are
    settings of the session, read when the result is computed, so they stay; smaller ones are left alone."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        said = re.fullmatch(r"(\d+)b?", str(spark.conf.get(name)).strip().lower())
        if not said or not 0 < int(said[1]) <= most:
            spark.conf.set(name, most)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
