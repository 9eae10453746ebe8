"""Files of their own: written by tasks, listed and read by tasks."""

import os

import pytest

from lodestone.plans import registry
from lodestone.sources import chunks as S


def put(folder, name, text="x"):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("name", ["markdown_round_trip", "pdf_scan", "pdf_tables"])
def test_the_driver_lists_no_files(spark, sf, name):
    assert registry.queries()[name](spark, sf).inputFiles() == []


def test_names_come_back_as_they_are(spark, tmp_path):
    kept = ["a b/x y.md", "Điều/ô 1%20.md", "a b/deep/q.md", "a b/e.md.md", "_k=1/y.md", "z.md"]
    for name in [*kept, "a b/.h.md", "_s/x.md", ".d/z.md", "a b/n.MD", "a b/_c=1.md", "a b/deep/_s/w.md"]:
        put(tmp_path, name, "t " + name)
    want = sorted((f"{tmp_path.name}/{n}".split("/")[-2], n.split("/")[-1][:-3], "t " + n) for n in kept)
    assert sorted(tuple(r) for r in S.read_markdown(spark, str(tmp_path)).collect()) == want
    below = [x for x in want if x[2].startswith("t a b/")]
    assert sorted(tuple(r) for r in S.read_markdown(spark, f"file://{tmp_path}/a*").collect()) == below  # a pattern: Spark's own reader


def test_bytes_stay_and_large_files_are_batches_of_their_own(spark, tmp_path):
    put(tmp_path, "a/bad.md", b"\xff\xfeok \r\n x\n")
    put(tmp_path, "a/empty.md", "")
    for n in range(3):
        put(tmp_path, f"a/big{n}.md", b"x" * (5 << 20))
    files = S.read_files(spark, str(tmp_path), ".md")
    assert sorted((r.path.split("/")[-1], r.n) for r in files.selectExpr("path", "length(content) AS n").collect()) == [("bad.md", 10), ("big0.md", 5 << 20), ("big1.md", 5 << 20), ("big2.md", 5 << 20), ("empty.md", 0)]
    assert files.where("path LIKE '%bad.md'").first().content == b"\xff\xfeok \r\n x\n"


def test_what_is_written_is_there_and_nothing_else(spark, tmp_path):
    files = spark.createDataFrame([(f"d{n % 3}/c{n}.md", f"text {n}") for n in range(500)], "name string, body string")
    assert S.write_files(files, f"file://{tmp_path}/out") == 500 == S.write_files(files, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["d0", "d1", "d2"] and not [x for d in range(3) for x in os.listdir(tmp_path / "out" / f"d{d}") if not x.endswith(".md")]
    assert sorted((r.doc_type, r.stem, r.text) for r in S.read_markdown(spark, f"{tmp_path}/out").collect()) == sorted((f"d{n % 3}", f"c{n}", f"text {n}") for n in range(500))
    assert S.write_files(files.where("false"), f"file://{tmp_path}/none") == 0
    assert S.read_markdown(spark, f"{tmp_path}/none").count() == 0


def test_ids_overwrite_each_other_inside_a_folder_only(spark):
    rows = spark.createDataFrame([("c1", "en", "a"), ("c1", "en", "b"), ("c1", "de", "a"), ("c/1", None, "y"), ("c?1", None, "x")], "chunk_id string, topic string, content string")
    for most in ("10m", "-1"):  # repeated names broadcast, or too many for that
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            got = sorted((str(r.topic), r.file_name, r.body.split("\n\n")[1]) for r in S.markdown_files(rows, "topic").collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert got == [("None", "c_1.md", "x"), ("de", "c1.md", "a"), ("en", "c1.md", "b")]


def test_bodies_of_names_that_come_once_are_not_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id AS string) AS chunk_id", "lang AS topic", "text AS content")
    files = S.markdown_files(docs, "topic")
    assert files.count() == docs.count()
    files.collect()
    plan = files._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Final Plan" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]


def test_no_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_markdown(spark, f"{tmp_path}/nowhere")
