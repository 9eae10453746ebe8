"""Token events through the sink and the source, over restarts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators.conversation import token_events
from lodestone.sources import event_stream as E

ANSWERS = [(k, f"Câu trả lời {k}\nxin \"chào\" data: [DONE] " * (k % 4)) for k in range(40)]


def test_lines_there_and_back():
    events = [("a", 0, "token", "x\n\ny"), ("a", 1, "token", None), ("b\n", 2, "token", "đ [DONE]"), ("a", 3, "done", "[DONE]")]
    lines = "".join(E.event_text(*e) for e in events).splitlines(keepends=True)
    assert list(E.parse_events(iter(lines))) == events
    assert list(E.parse_events(iter(["data: x\n", ": remark\n", 'data: {"value": 1}\n', "data: [1]\n", 'data: {"type": "t"}\n']))) == [(None, None, "t", None)]


@pytest.fixture
def folders(spark, tmp_path):
    E.register(spark)
    return [str(tmp_path / x) for x in ("source", "events", "cp-write", "cp-read", "out")]


def pump(spark, folders):
    source, events, cp_write, cp_read, out = folders
    schema = "key string, seq long, type string, value string"
    spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.format("event_stream").option("path", "file://" + events).option("checkpointLocation", cp_write).trigger(availableNow=True).start().awaitTermination()
    spark.readStream.format("event_stream").load("file://" + events).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp_read).trigger(availableNow=True).start().awaitTermination()
    rows = F.array_sort(F.collect_list(F.struct("seq", "value")))
    got = spark.read.schema(schema).parquet(out).groupBy("key").agg(F.count_if(F.col("type") == "done").alias("ends"), F.array_join(F.transform(F.filter(rows, lambda x: x["value"] != "[DONE]"), lambda x: x["value"]), "").alias("text"))
    return {(r.key, r.ends, r.text) for r in got.collect()}


def put(spark, folders, answers):
    df = token_events(spark.createDataFrame(answers, "id long, text string"), "id", "text")
    df.select(F.col("id").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "type", "value").repartition(2).write.mode("append").parquet(folders[0])


def test_every_answer_once_over_restarts(spark, folders):
    """New answers after a restart, a batch whose commit the query forgot, and parts of a batch that was never committed."""
    put(spark, folders, ANSWERS[:15])
    assert pump(spark, folders) == {(str(k), 1, t) for k, t in ANSWERS[:15]}
    parts = set(os.listdir(folders[1] + "/parts"))
    for cp in folders[2:4]:  # as if the last batch had been written, and the query had stopped before it knew
        last = max(int(os.path.basename(f)) for f in glob.glob(f"{cp}/commits/[0-9]*"))
        for f in (f"{cp}/commits/{last}", f"{cp}/commits/.{last}.crc"):
            os.path.exists(f) and os.remove(f)
    with open(folders[1] + "/parts/stray.sse", "w") as f:
        f.write(E.event_text("stray", 0, "token", "x"))
    assert pump(spark, folders) == {(str(k), 1, t) for k, t in ANSWERS[:15]}
    assert set(os.listdir(folders[1] + "/parts")) == parts | {"stray.sse"}
    put(spark, folders, ANSWERS[15:])
    assert pump(spark, folders) == {(str(k), 1, t) for k, t in ANSWERS}
    whole = spark.read.format("event_stream").load("file://" + folders[1])
    assert whole.where("type = 'done'").count() == len(ANSWERS) and whole.where("key = 'stray'").count() == 0


def test_an_empty_folder(spark, tmp_path):
    E.register(spark)
    assert spark.read.format("event_stream").load(f"file://{tmp_path}/none").count() == 0
