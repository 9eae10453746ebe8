"""Threads as keyed state: the turn that each thread is in, and the latest value of each of its fields.

Both are stateful processors in Spark's state store (RocksDB, changes only are written), so a batch writes what its
keys changed, a lost executor loses nothing, and a query that starts again goes on where it stood. The store is read
back as a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.functions.fixed import REJECTED
from lodestone.operators.conversation import finalize, node_path

LOG = "thread {key}, seq long, path string, status string, answer string"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: How long a turn waits for a reviewer, and how late an event may come.
WAIT, LATE = timedelta(days=2), timedelta(hours=1)
#: What an event says, and events that are stored as one entry of a thread's state, at most.
EVENT, PACK = ("kind", "path", "waits", "draft", "answer", "approved", "override"), 1000


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Queries that are started inside keep their state in RocksDB, in that many parts for good; the session's settings come back after."""
    new = STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- turns ------------------------------------------------------------------------------------------


def turn_events(events: DataFrame) -> DataFrame:
    """events (thread, seq, at, kind, category, error, refused, n_chunks, draft, answer, approved, override) as the machine
    takes them: an "ask" with the nodes that it passes and whether it then waits, a "decide" as it is. kind is one of the two."""
    way = node_path(F.col("category"), F.col("error"), F.col("refused"), F.col("n_chunks"), F.lit(None).cast("boolean"))
    asks = F.col("kind") == "ask"
    only = lambda c, when: F.when(when, c)
    return events.select("thread", "seq", "at", "kind", only(way["path"], asks).alias("path"), F.coalesce(only(way["waits"], asks), F.lit(False)).alias("waits"), "draft", "answer", F.coalesce("approved", F.lit(False)).alias("approved"), "override")


class TurnMachine(StatefulProcessor):
    """Drives each thread through its turns, in the order of (at, seq), whatever the order in which events come.

    Events are kept (list state) until the watermark has passed them, when no earlier one can come; a timer says when the
    first of them is due. Then they are applied in order, repeated ones once: an ask without review is answered; one that needs it waits
    (value state) until it is decided, replaced by a new ask, or expired by a timer. Later events than LATE are left out.
    """

    def __init__(self, wait: timedelta):
        self.wait = wait // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "at long, seq long, event string")
        self.waiting = handle.getValueState("waiting", "at long, seq long, draft string, answer string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ms, r.seq, r.event) for r in rows]
        packs = [new[i : i + PACK] for i in range(0, len(new), PACK)]
        self.early.appendList([(p[0][0], p[0][1], json.dumps(p)) for p in packs])
        self.handle.registerTimer(min(ms for ms, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        stored = [e for r in self.early.get() for e in json.loads(r[2])] if self.early.exists() else []
        known = sorted({(e[0], e[1]): tuple(e) for e in stored}.values())
        due, left = [r for r in known if r[0] <= now], [r for r in known if r[0] > now]
        if due and left:
            self.early.put([(p[0][0], p[0][1], json.dumps(p)) for p in (left[i : i + PACK] for i in range(0, len(left), PACK))])
            self.handle.registerTimer(left[0][0])
        elif due:
            self.early.clear()
        was = held = tuple(self.waiting.get()) if self.waiting.exists() else None
        for at, seq, event in due:
            body = json.loads(event)  # fields that are null are left out
            kind, path, waits, draft, answer, approved, override = (body.get(c) for c in EVENT)
            if held and at >= held[0] + self.wait:
                yield self._row(key, held[1], None, "expired", None)
                held = None
            if kind == "ask":
                if held:
                    yield self._row(key, held[1], None, "replaced", None)
                held = (at, seq, draft, answer) if waits else None
                yield self._row(key, seq, path, "pending_web_review" if waits else "completed", None if waits else answer or "")
            elif not held:
                yield self._row(key, seq, None, "not_found", None)
            else:
                said = (override or held[2] or held[3] or "") if approved else REJECTED
                yield self._row(key, seq, "web_finalize" if approved else None, "completed" if approved else "rejected", said)
                held = None
        if held and now >= held[0] + self.wait:
            yield self._row(key, held[1], None, "expired", None)
            held = None
        # a timer for the turn that is left waiting only: those decided or replaced since need none
        if held and held != was:
            self.waiting.update(held)
            self.handle.registerTimer(held[0] + self.wait)
        elif was and not held:
            self.waiting.clear()

    def _row(self, key, seq: int, path: str | None, status: str, answer: str | None) -> Row:
        return Row(thread=key[0], seq=seq, path=path, status=status, answer=answer)

    def close(self) -> None:
        pass


def turn_stream(events: DataFrame, wait: timedelta = WAIT, late: timedelta = LATE) -> DataFrame:
    """The log of turns of a stream of events: thread, seq, path, status and answer, a row for each step that is taken.
    Steps appear once the watermark has passed their events. For output mode append."""
    # what the machine keeps of an event is made a text before it gets there
    made = turn_events(events).select("thread", "at", "seq", F.unix_millis("at").alias("ms"), F.to_json(F.struct(*EVENT)).alias("event")).withWatermark("at", f"{late // timedelta(milliseconds=1)} milliseconds")
    kind = events.schema["thread"].dataType.simpleString()
    return made.groupBy("thread").transformWithState(statefulProcessor=TurnMachine(wait), outputStructType=LOG.format(key=kind), outputMode="Append", timeMode="EventTime")


def turn_log(events: DataFrame, wait: timedelta = WAIT) -> DataFrame:
    """The same log of a table of events, as windows: what a step does depends on the one before, and whether a turn
    is left waiting on the one after. All turns that nobody decides count as expired."""
    by = Window.partitionBy("thread").orderBy("at", "seq")
    span = F.expr(f"INTERVAL {wait // timedelta(seconds=1)} SECOND")
    df = turn_events(events).dropDuplicates(["thread", "at", "seq"])
    last = lambda c: F.lag(c).over(by)
    df = df.withColumns({"was": last("waits"), "was_at": last("at"), "was_draft": last("draft"), "was_answer": last("answer"), "next_at": F.lead("at").over(by), "next": F.lead("kind").over(by)})
    asks, open_ = F.col("kind") == "ask", F.coalesce(F.col("was") & (F.col("at") < F.col("was_at") + span), F.lit(False))
    status = F.when(asks, F.when(F.col("waits"), "pending_web_review").otherwise("completed")).when(~open_, "not_found").otherwise(F.when(F.col("approved"), "completed").otherwise("rejected"))
    said = finalize(F.col("override"), finalize(F.col("was_draft"), F.col("was_answer")))
    answer = F.when(asks, F.when(~F.col("waits"), F.coalesce("answer", F.lit("")))).when(open_, F.when(F.col("approved"), said).otherwise(REJECTED))
    path = F.when(asks, F.col("path")).when(open_ & F.col("approved"), "web_finalize")
    steps = df.select("thread", "seq", path.alias("path"), status.alias("status"), answer.alias("answer"))
    gone = F.when(F.col("next_at").isNull() | (F.col("next_at") >= F.col("at") + span), "expired").when(F.col("next") == "ask", "replaced")
    ends = df.where(asks & F.col("waits")).select("thread", "seq", F.lit(None).cast("string").alias("path"), gone.alias("status"), F.lit(None).cast("string").alias("answer"))
    return steps.unionByName(ends.where("status IS NOT NULL"))


def start_turns(events: DataFrame, path: str, checkpoint: str, wait: timedelta = WAIT, late: timedelta = LATE, partitions: int | None = None) -> StreamingQuery:
    """Writes the log of what has come since the last run under path; each step once, also after a restart."""
    with state_store(events.sparkSession, partitions):
        return turn_stream(events, wait, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(thread, seq, draft, at): the turns that wait for a reviewer, read from the state store."""
    df = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return df.select("key.thread", "value.seq", "value.draft", F.timestamp_millis("value.at").alias("at"))


# --- latest values ----------------------------------------------------------------------------------


class LatestFields(StatefulProcessor):
    """Of every field, the value of the event with the greatest place, whatever the order in which events come."""

    def __init__(self, fields: tuple[str, ...]):
        self.names = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "place string, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[str, tuple[str, str]] = {}
        for r in rows:
            for name in self.names:
                value = r[name]
                if value is not None and r.place > new.get(name, ("", ""))[0]:
                    new[name] = (r.place, value)
        for name, (place, value) in new.items():
            if not self.fields.containsKey((name,)) or place > self.fields.getValue((name,))[0]:
                self.fields.updateValue((name,), (place, value))
                yield Row(key=key[0], field=name, value=value)

    def close(self) -> None:
        pass


def place_of(*order: str) -> Column:
    """Whole numbers or moments as one text that sorts as they do."""
    part = lambda c: F.lpad(F.conv((F.col(c).cast("long") + F.lit(1 << 62)).cast("string"), 10, 16), 16, "0")
    return F.concat(*[part(c) for c in order])


def latest_changes(events: DataFrame, key: str, order: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """(key, field, value as text): what a batch of a stream of events changes. order: whole numbers that aren't null. For output mode update."""
    rows = events.select(F.col(key).alias("key"), place_of(*order).alias("place"), *[F.col(f).cast("string").alias(f) for f in fields])
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(statefulProcessor=LatestFields(fields), outputStructType=f"key {kind}, field string, value string", outputMode="Update", timeMode="None")


def keep_latest_state(events: DataFrame, checkpoint: str, key: str, order: tuple[str, ...], fields: tuple[str, ...], partitions: int | None = None) -> StreamingQuery:
    """Merges what has come since the last run into the latest state by key; read_state reads it."""
    with state_store(events.sparkSession, partitions):
        return latest_changes(events, key, order, fields).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, checkpoint: str, key: str, fields: tuple[str, ...], kinds: dict[str, str] | None = None) -> DataFrame:
    """key and the latest value of each field, from the state store as of the last batch; kinds: types of fields that aren't text."""
    df = spark.read.format("statestore").option("stateVarName", "fields").load(checkpoint)
    rows = df.select(F.col("key.key").alias(key), F.col("user_map_key.field").alias("field"), F.col("user_map_value.value").alias("value"))
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).cast((kinds or {}).get(f, "string"))
    return rows.groupBy(key).agg(*[value(f).alias(f) for f in fields])
