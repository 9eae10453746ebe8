"""Event streams as a source and a sink of Structured Streaming: format "event_stream".

A folder holds parts, text files of server-sent events, and a list for each batch that has been committed. A batch's parts
count from the moment that its list is there, and a batch that is committed again (after a restart) leaves the first list as
it is, so each event is in the stream once. The reader's offset is the number of lists; a part is a partition. One query
writes to a folder, and goes on with its own checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "key string, seq long, type string, value string"
# Fields of an event, the mark of the end, and the type that it stands for.
ID, DATA, END, DONE = "id: ", "data: ", "[DONE]", "done"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(store, path: str, text: str) -> None:
    """A file that appears whole or not at all."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(text.encode())
    store.move(part, f"{folder}/{name}")


def _lists(folder: str) -> list[list[str]]:
    """The parts of each committed batch, in order."""
    from pyarrow import fs

    store, base = _store(folder)
    found = store.get_file_info(fs.FileSelector(f"{base}/batches", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.is_file and not info.base_name.startswith("."):
            with store.open_input_stream(info.path) as f:
                out.append(json.loads(f.readall()))
    return out


def event_text(key: str, seq: int, kind: str, value: str | None) -> str:
    body = END if kind == DONE else json.dumps({"type": kind, "value": value}, ensure_ascii=False)
    return f"{ID}{json.dumps([key, seq])}\n{DATA}{body}\n\n"


def parse_events(lines: Iterator[str]) -> Iterator[tuple[str | None, int | None, str, str | None]]:
    """Events of lines; an event without an id has no key, what is no JSON is left out."""
    key = seq = None
    for line in lines:
        line = line.rstrip("\n")
        if line.startswith(ID):
            key, seq = json.loads(line[len(ID) :])
        elif line.startswith(DATA):
            body = line[len(DATA) :].strip()
            if body == END:
                yield key, seq, DONE, END
            else:
                try:
                    said = json.loads(body)
                except ValueError:
                    continue
                if isinstance(said, dict) and said.get("type") is not None:
                    yield key, seq, said["type"], said.get("value")
        elif not line:
            key = seq = None


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class _Parts:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")

    def read(self, partition: Part) -> Iterator[tuple]:
        store, base = _store(self.folder)
        with store.open_input_stream(f"{base}/parts/{partition.path}") as f:
            import io

            yield from parse_events(io.TextIOWrapper(f, "utf-8", newline="\n"))


class TableReader(_Parts, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [Part(p) for parts in _lists(self.folder) for p in parts] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        return super().read(partition) if partition.path else iter(())


class StreamReader(_Parts, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": len(_lists(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(p) for parts in _lists(self.folder)[start["batches"] : end["batches"]] for p in parts]

    def commit(self, end: dict) -> None:
        """Events stay for other readers."""


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        """A part for each task; bounded by what the task is given, written event by event."""
        store, base = _store(self.folder)
        name = first = None
        for r in iterator:
            if name is None:
                name = f"{uuid.uuid4().hex}.sse"
                store.create_dir(f"{base}/parts", recursive=True)
                first = store.open_output_stream(f"{base}/parts/{name}")
            first.write(event_text(r.key, r.seq, r.type, r.value).encode())
        if first is not None:
            first.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, base = _store(self.folder)
        path = f"{base}/batches/{batchId:012d}"
        parts = [m.path for m in messages if m is not None and m.path]
        if store.get_file_info(path).is_file:
            self._drop(parts)  # the batch was committed before the restart
        else:
            _put(store, path, json.dumps(parts))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop([m.path for m in messages if m is not None and m.path])

    def _drop(self, parts: list[str]) -> None:
        store, base = _store(self.folder)
        for p in parts:
            store.delete_file(f"{base}/parts/{p}")


class EventStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventStream)
