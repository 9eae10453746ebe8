import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions.fixed import LEGAL_DOMAINS
from lodestone.sources import chunks as S
from lodestone.streaming import state, threads


def test_chunks_round_trip(spark, tmp_path):
    a = [{"metadata": {"chunk_id": f"c{i}", "dieu": 6 if i else "x", "khoan": "", "level": 2}, "content": f"t{i}"} for i in range(3)]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.jsonl").write_text("\n\n".join(json.dumps(x) for x in a))
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({"content": None}) + "\n")
    got = S.read_chunks(spark, str(tmp_path / "in")).orderBy("id").collect()
    assert [(r.id, r.chunk_id, r.dieu, r.khoan, r.status, r.content) for r in got] == [(0, "c0", 0, None, "active", "t0"), (1, "c1", 6, None, "active", "t1"), (2, "c2", 6, None, "active", "t2"), (3, "", 0, None, "active", "")]
    S.write_chunks(S.read_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert S.read_chunks(spark, str(tmp_path / "out")).count() == 4
    files = {r.file_name: r.body for r in S.markdown_files(S.read_chunks(spark, str(tmp_path / "in"))).collect()}
    assert files["c1.md"].startswith('---\nchunk_id: "c1"') and files["c1.md"].endswith("---\n\nt1")


def test_ids_over_many_splits(spark, tmp_path):
    """Files cut into many splits, with blank lines and an empty file: the numbers that one reader would give; lines aren't shuffled."""
    os.makedirs(tmp_path / "in")
    want = []
    for name in ("b", "a", "c", "empty"):
        lines = [] if name == "empty" else [f"{name}{i} " + "é" * (i % 50) if i % 7 else " " * (i % 3) for i in range(400)]
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines))
        want.append((name, [x for x in lines if x.strip()]))
    want = [x for _, lines in sorted(want) for x in lines]
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = S.numbered_lines(spark, str(tmp_path / "in"))
        assert [(r.id, r.line) for r in df.orderBy("id").collect()] == list(enumerate(want)) and df.rdd.getNumPartitions() > 20
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "Exchange" in x]
        assert exchanges and not any("value" in x for x in exchanges)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_markdown_scan(spark, tmp_path):
    for name, text in (("luat/a.md", "x\ny"), ("luat/_skip.md", "x"), ("nghidinh/b.md", "z"), ("nghidinh/blank.md", " ")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(tuple(r) for r in S.read_markdown(spark, str(tmp_path)).collect()) == [("luat", "a", "x\ny"), ("nghidinh", "b", "z")]


def test_pdf_extractor_is_injected(spark, tmp_path):
    for name in ("a.pdf", "skip.pdf"):
        (tmp_path / name).write_bytes(b"one\ftwo")
    got = S.read_pdfs(spark, str(tmp_path), lambda data: list(enumerate(data.decode().split("\f"))), ("skip.pdf",)).collect()
    assert sorted(tuple(r) for r in got) == [("a.pdf", 0, "one"), ("a.pdf", 1, "two")]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in S.upsert_points(old, new).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_web_search_retries(spark):
    seen = []

    def search(text, domains, most):
        seen.append(text)
        if len(seen) < 3:
            raise TimeoutError
        return [{"title": text, "url": f"http://{domains[0]}/", "content": "c"}] * 9

    q = spark.createDataFrame([(1, "hỏi")], "query_id long, text string").coalesce(1)
    got = S.search_web(q, search, LEGAL_DOMAINS, wait=0.0).collect()
    assert len(got) == 5 and got[0].url == "http://thuvienphapluat.vn/"


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.col("value"))
    src = str(tmp_path / "events")
    events.where("event_id < 500").write.parquet(src)
    events.where("event_id >= 500").write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = state.metrics_stream(stream.selectExpr("event_id % 100 AS ms", "event_type = 'error' AS failed", "ts")).writeStream.outputMode("complete").format("memory").queryName("m").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("m").first().n_requests == events.count()
    q = state.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts").writeStream.outputMode("update").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() > 0


def test_state_over_many_batches(spark, tmp_path):
    """Late events, nulls and keys that some batches don't touch: as if all events were read at once."""
    import random

    r = random.Random(3)
    rows = [(k, r.randrange(30), r.choice([None, "a", "b", "c"]), r.choice([None, float(k)])) for k in range(-200, 200)]
    r.shuffle(rows)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "event_id long, user_id long, kind string, value double"
    fed = []
    for n in range(3):
        now = [x for x in rows[n * 130 : n * 130 + 130] if x[1] % 3 <= n]
        fed += now
        spark.createDataFrame(now + now[:9], schema).coalesce(1).write.mode("append").parquet(source)
        threads.keep_latest_state(spark.readStream.schema(schema).parquet(source), checkpoint, "user_id", ("event_id",), ("kind", "value"), 2).awaitTermination()
    want = {}
    for _, u, kind, value in sorted(fed, key=lambda x: x[0]):
        was = want.get(u, (None, None))
        want[u] = (kind if kind is not None else was[0], value if value is not None else was[1])
    got = {x.user_id: (x.kind, x.value) for x in threads.read_state(spark, checkpoint, "user_id", ("kind", "value"), {"value": "double"}).collect()}
    assert got == {u: w for u, w in want.items() if w != (None, None)}


TURN = "thread string, seq long, at timestamp, kind string, category string, error string, refused boolean, n_chunks int, draft string, answer string, approved boolean, override string"


def turns(spark, rows):
    """rows: (thread, seq, hours, kind[, category or whether it's approved[, override]])."""
    from datetime import UTC, datetime, timedelta

    start = datetime(2024, 1, 1, tzinfo=UTC)
    full = []
    for t, seq, hours, kind, *more in rows:
        ask = kind == "ask"
        full.append((t, seq, start + timedelta(hours=hours), kind, more[0] if ask else None, "", False, 1 if ask else None, f"D{seq}" if ask else None, f"A{seq}" if ask else None, None if ask else more[0], more[1] if len(more) > 1 else None))
    return spark.createDataFrame(full, TURN)


WEB, LEGAL = "web_legal_search", "legal_rag"


def test_turns_wait_resume_and_expire(spark, tmp_path):
    """Steps by hand, and by the log of the table: events out of order, late, repeated, over a restart in the middle of a wait."""
    from datetime import timedelta

    batches = [
        [("a", 2, 2, "decide", True), ("a", 1, 1, "ask", WEB), ("b", 1, 1, "ask", LEGAL), ("c", 1, 1, "ask", WEB), ("d", 1, 1, "decide", True), ("e", 1, 1, "ask", WEB), ("f", 1, 1, "ask", WEB)],
        [("c", 2, 5, "ask", WEB), ("e", 2, 4.5, "decide", False), ("a", 1, 1, "ask", WEB), ("c", 3, 6, "decide", True, "sửa"), ("a", 3, 6.5, "ask", None), ("c", 2, 5, "ask", WEB)],
        [("f", 2, 26, "decide", True), ("a", 4, 26.5, "decide", False), ("z", 9, 400, "ask", LEGAL), ("a", 1, 1, "ask", WEB)],
    ]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k, rows in enumerate(batches):
        turns(spark, rows).coalesce(1).write.mode("append").parquet(source)
        threads.start_turns(spark.readStream.schema(TURN).parquet(source), out, checkpoint, timedelta(hours=24), timedelta(hours=3), 2).awaitTermination()
        if k == 1:
            assert {(r.thread, r.seq) for r in threads.waiting_turns(spark, checkpoint).collect()} == {("f", 1), ("e", 1), ("c", 1)}
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    web, no = "analyzer>web_search", threads.REJECTED
    want = [
        ("a", 1, web, "pending_web_review", None), ("a", 2, "web_finalize", "completed", "D1"), ("a", 3, "analyzer>out_of_scope", "completed", "A3"), ("a", 4, None, "not_found", None), ("b", 1, "analyzer>legal_rag", "completed", "A1"),
        ("c", 1, web, "pending_web_review", None), ("c", 1, None, "replaced", None), ("c", 2, web, "pending_web_review", None), ("c", 3, "web_finalize", "completed", "sửa"), ("d", 1, None, "not_found", None),
        ("e", 1, web, "pending_web_review", None), ("e", 2, None, "rejected", no), ("f", 1, web, "pending_web_review", None), ("f", 1, None, "expired", None), ("f", 2, None, "not_found", None),
    ]
    assert got == sorted(want, key=str)
    every = [x for b in batches for x in b if x[0] != "z"]
    assert sorted(map(str, threads.turn_log(turns(spark, every), timedelta(hours=24)).collect())) == sorted(str(r) for r in spark.read.parquet(out).collect())
    assert threads.waiting_turns(spark, checkpoint).count() == 0


def test_small_tables_are_dealt_out_and_large_ones_left(spark, sf, monkeypatch):
    from lodestone.sources import tables

    cores = spark.sparkContext.defaultParallelism
    assert tables.read_table(spark, sf, "documents").rdd.getNumPartitions() == cores
    monkeypatch.setattr(tables, "SMALL", 1000)
    assert tables.read_table(spark, sf, "documents").rdd.getNumPartitions() < cores


def test_batches_are_bounded_and_smaller_ones_kept(spark, sf):
    from lodestone.sources import scratch

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(3)
    same = lambda batches: batches
    was = spark.conf.get(rows), spark.conf.get(size)
    spark.conf.set(rows, 10)
    spark.conf.set(size, 4096)
    scratch.map_arrow(df, same, df.schema)
    assert int(spark.conf.get(rows)) == 10 and int(spark.conf.get(size)) == 4096
    spark.conf.set(rows, 0)
    spark.conf.set(size, 1 << 30)
    assert scratch.map_arrow(df, same, df.schema).count() == 3
    assert int(spark.conf.get(rows)) == scratch.BATCH_ROWS and int(spark.conf.get(size)) == scratch.BATCH_BYTES
    spark.conf.set(rows, was[0])
    spark.conf.set(size, was[1])


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from lodestone.sources import scratch

    conf = SimpleNamespace(get=lambda name, default=None: default)
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="a", master=master)))
