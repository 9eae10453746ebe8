"""Readers and writers of chunks, pages and points. Everything goes through Spark's readers and writers, so any
store that they know will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.text import safe_name
from lodestone.sources.scratch import BATCH_BYTES, BATCH_ROWS, map_arrow, written

#: The payload, with the defaults that stand in for what is missing.
DEFAULTS = {"chunk_id": "", "doc_id": "", "ten_van_ban": "", "issuer": "", "document_type": "", "status": "active", "effective_date": "", "topic": "", "dieu": 0, "dieu_title": "", "khoan": None, "diem": None, "level": 1, "source_file": "", "token_estimate": 0}

#: Tasks a core that files of their own are read in.
FILE_TASKS = 16

#: The article may be a number or a word in the file, so it's read as text and cast leniently.
CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("metadata", T.StructType([T.StructField(k, T.IntegerType() if k in ("level", "token_estimate") else T.StringType()) for k in DEFAULTS])),
        T.StructField("content", T.StringType()),
    ]
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line): lines that aren't blank, with their 0-based numbers in the order of file and line, by prefix sums over
    the splits that files are read in. One pass counts the lines of each split; a second one reads them again, takes the
    line's place in its split and adds what comes before the split. Lines themselves are never shuffled, and a file is
    as many tasks as it has splits. What is broadcast is 40 bytes for each split. If files are split otherwise the second
    time (they have changed, or the cluster has), the query fails rather than number them wrongly."""
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    lines = spark.read.text(path).where(F.trim("value") != "").select(*place, F.col("_metadata.file_path").alias("name"), F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy("file", "split").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("name", "split")) - F.col("n")  # a row for each split
    starts = splits.select("file", "split", "n", "first", before.alias("before"))
    own = F.col("at") - F.col("first")
    same = (own >= 0) & (own < F.col("n"))
    rows = lines.drop("name").join(F.broadcast(starts), ["file", "split"], "left")
    return rows.select(F.when(F.coalesce(same, F.lit(False)), F.col("before") + own).otherwise(F.raise_error("files are split otherwise than when their lines were counted").cast("long")).alias("id"), F.col("value").alias("line"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines with their 0-based ids in the order of file and line. Blank lines don't count."""
    parsed = numbered_lines(spark, path).select("id", F.from_json("line", CHUNK_SCHEMA).alias("j"))
    return parsed.select("id", *[_field(k, v) for k, v in DEFAULTS.items()], F.coalesce("j.content", F.lit("")).alias("content"))


def _field(name: str, default) -> F.Column:
    c = F.col(f"j.metadata.{name}")
    if name == "dieu":
        c = F.expr("try_cast(j.metadata.dieu AS int)")
    if name in ("khoan", "diem"):
        return F.nullif(c, F.lit("")).alias(name)
    return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line, text as it is."""
    meta = F.struct(*[F.col(k) for k in DEFAULTS if k in chunks.columns])
    chunks.select(meta.alias("metadata"), "content").write.mode("overwrite").json(path)


def markdown_files(chunks: DataFrame, *folders: str) -> DataFrame:
    """(folders, file_name, body): a chunk as Markdown behind its front matter, under a name that any store takes, for
    each value of the columns that name folders. Chunks of one id in a folder overwrite each other: the last by content
    stays. Names are counted first, so that only the bodies of repeated ones are shuffled, unless these are too many to
    be broadcast; chunks are read up to three times."""
    keys = [k for k in DEFAULTS if k in chunks.columns and k not in folders]
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(F.to_json(F.struct(F.col(k).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(k).alias("v")))) - 6), F.lit("null"))) for k in keys])
    body = F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), F.col("content"))
    files = chunks.select(*folders, F.concat(safe_name(F.col("chunk_id")), F.lit(".md")).alias("file_name"), body.alias("body"))
    names = [*folders, "file_name"]
    repeated = written(files.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in names]), "repeated")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
    once = files.join(repeated, same, "left_anti")
    return once.unionByName(files.join(repeated, same, "left_semi").groupBy(*names).agg(F.max("body").alias("body")))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files (name, body as bytes), each under its name in a folder that all executors reach (any store that
    Arrow knows); says how many. A file appears whole or not at all, and a task that runs again writes the same."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)  # even if there are no files

    def run(batches):
        import posixpath
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        own = posixpath.join(base, f".{uuid.uuid4().hex}")  # tasks that write into one folder would wait for each other
        store.create_dir(own)
        made = set()
        try:
            for b in batches:
                for name, body in zip(b["name"].to_pylist(), b["body"], strict=True):
                    path, part = posixpath.join(base, name), posixpath.join(own, "part")
                    parent = posixpath.dirname(path)
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    with store.open_output_stream(part) as f:
                        f.write(body.as_buffer())
                    store.move(part, path)
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})
        finally:
            store.delete_dir(own)

    done = map_arrow(files.select("name", F.col("body").cast("binary").alias("body")), run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0


def write_markdown(chunks: DataFrame, folder: str) -> int:
    """A Markdown file behind its front matter for each chunk id; says how many."""
    return write_files(markdown_files(chunks).select(F.col("file_name").alias("name"), "body"), folder)


def read_files(spark: SparkSession, path: str, suffix: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, content as bytes) of the files under a folder, at any depth, whose names end with suffix and, by keep, are
    wanted; what starts with "_" or "." is left out. Tasks list the folder and read the files, so the driver holds no
    names: one lists the folder itself, others what is below each of its folders, and files are dealt out by name over a
    fixed number of tasks a core, however small they are. Where Arrow finds no such folder (a pattern, one file, a store
    that it doesn't know) Spark's own reader serves, which lists in the driver."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(True) if keep is None else keep(name)
    found = _arrow_folder(spark, path)
    if found is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
        return files.select("path", "content").where(wanted)
    uri, base = found

    def entries(store, folder):
        """(path, whether it's a folder); names of a local folder are streamed."""
        import os

        from pyarrow import fs

        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as found:
                yield from ((e.path, e.is_dir()) for e in found)
        else:
            yield from ((i.path, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(folder)))

    def shown(path, is_folder):
        last = path.rsplit("/", 1)[-1]
        return not last.startswith(".") and (not last.startswith("_") or "=" in last) and (is_folder or last.endswith(suffix))

    def listing(deep):
        def run(batches):
            import itertools

            import pyarrow as pa
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(uri)

            def below(path, is_folder):
                if not is_folder:
                    yield path, False
                    return
                for found in entries(store, path):
                    if shown(*found):
                        yield from below(*found) if deep else (found,)

            for b in batches:
                every = itertools.chain.from_iterable(itertools.starmap(below, zip(b["path"].to_pylist(), b["is_folder"].to_pylist(), strict=True)))
                while rows := list(itertools.islice(every, BATCH_ROWS)):
                    paths, kinds = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], ["path", "is_folder"])

        return run

    def contents(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)

        def batch(paths, bodies):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])

        for b in batches:
            paths, bodies, size = [], [], 0
            for path in b["path"].to_pylist():
                with store.open_input_stream(path) as f:
                    body = f.read()
                if paths and size + len(body) > BATCH_BYTES:
                    yield batch(paths, bodies)
                    paths, bodies, size = [], [], 0
                paths.append(path)
                bodies.append(body)
                size += len(body)
            if paths:
                yield batch(paths, bodies)

    cores, kind = spark.sparkContext.defaultParallelism, "path string, is_folder boolean"
    root = spark.range(1, numPartitions=1).select(F.lit(base).alias("path"), F.lit(True).alias("is_folder"))
    top = map_arrow(root, listing(deep=False), kind).repartition(cores, "path")
    names = map_arrow(top, listing(deep=True), kind).where(wanted).select("path").repartition(FILE_TASKS * cores, "path")
    return map_arrow(names, contents, "path string, content binary")


def _arrow_folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The folder's full URI and its path in Arrow's store of it, if Arrow can list it."""
    from pyarrow import fs

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    try:
        store, base = fs.FileSystem.from_uri(uri)
        return (uri, base) if store.get_file_info(base).type == fs.FileType.Directory else None
    except (ValueError, OSError, NotImplementedError):
        return None


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_type, stem, text) of Markdown files in folders by document type; names that start with "_" and blank
    files are left out."""
    files = read_files(spark, path, ".md", lambda name: ~F.startswith(name, F.lit("_")))
    parts = F.split("path", "/")
    df = files.select(F.element_at(parts, -2).alias("doc_type"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("stem"), F.col("content").cast("string").alias("text"))
    return df.where(F.trim("text") != "")


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[int, str]]], excluded: tuple[str, ...] = ()) -> DataFrame:
    """(file, page_no, text) of a folder's PDF files by an injected extractor of page texts; files by the names
    in excluded are left out before they're read."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(f, n, t) for f, c in zip(b["file"], b["content"], strict=True) for n, t in extract(c)]
            yield pd.DataFrame(rows, columns=["file", "page_no", "text"])

    files = read_files(spark, path, ".pdf", (lambda name: ~name.isin(*excluded)) if excluded else None)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInPandas(run, "file string, page_no int, text string")


def read_pdf_tables(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[int, list[list[str | None]]]]]) -> DataFrame:
    """(tbl, row, col, cell) of the tables in a folder's PDF files, by an injected extractor of (page, rows of cells).
    tbl names file, page and place; the rows fit markdown_tables."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(f"{f}#{page}#{n}", i, j, None if cell is None else str(cell)) for f, c in zip(b["file"], b["content"], strict=True) for n, (page, table) in enumerate(extract(c)) for i, line in enumerate(table) for j, cell in enumerate(line)]
            yield pd.DataFrame(rows, columns=["tbl", "row", "col", "cell"])

    files = read_files(spark, path, ".pdf")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInPandas(run, "tbl string, row int, col int, cell string")


def event_lines(events: DataFrame) -> DataFrame:
    """events (key columns, type, value) with line: each as a line of an event stream; the end is a mark of its own."""
    body = F.to_json(F.struct("type", "value"))
    return events.withColumn("line", F.when(F.col("type") == "done", "data: [DONE]").otherwise(F.concat(F.lit("data: "), body)))


def read_event_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with type and value parsed; other lines, marks of the end and what is no JSON are left out."""
    body = F.trim(F.substring(line, 6, 1 << 30))
    parsed = lines.where(F.startswith(line, F.lit("data:"))).withColumn("__e", F.from_json(body, "type string, value string"))
    return parsed.where("__e.type IS NOT NULL").select(*[c for c in lines.columns if c not in ("type", "value")], F.col("__e.type").alias("type"), F.col("__e.value").alias("value"))


def create_points(points: DataFrame, table: str, recreate: bool = False, path: str | None = None) -> None:
    """The collection as a table, in the warehouse or under path: made anew, or left as it is if it exists."""
    writer = points.write.mode("overwrite" if recreate else "ignore")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def load_index(points: DataFrame, table: str, path: str | None = None) -> int:
    """Replaces the table's rows, refreshes its statistics, and says how many there are."""
    spark = points.sparkSession
    writer = points.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    return spark.table(table).count()


def upsert_points(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with new's rows put in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def search_web(queries: DataFrame, search: Callable[[str, tuple[str, ...], int], list[dict]], domains: tuple[str, ...], most: int = 5, retries: int = 2, transient: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError), wait: float = 1.0) -> DataFrame:
    """(query_id, title, url, content) by an injected search; transient errors are tried again, waiting longer each
    time, all others are raised."""

    def run(batches):
        import time

        import pandas as pd

        for b in batches:
            rows = []
            for q, text in zip(b["query_id"], b["text"], strict=True):
                for attempt in range(retries + 1):
                    try:
                        got = search(text, domains, most)
                        break
                    except transient:
                        if attempt == retries:
                            raise
                        time.sleep(wait * (attempt + 1))
                rows += [(q, r.get("title"), r.get("url"), r.get("content")) for r in got[:most]]
            yield pd.DataFrame(rows, columns=["query_id", "title", "url", "content"])

    return queries.select("query_id", "text").mapInPandas(run, "query_id long, title string, url string, content string")
