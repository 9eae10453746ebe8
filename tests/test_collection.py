"""Merging by bucket: what is rewritten, what readers see, and that running again changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources.collection import Collection


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v string")


@pytest.fixture
def made(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "points"))
    c.create(table(spark, [(k, f"a{k}") for k in range(100)] + [(3, "a3"), (None, "none")]), "id", 16)
    return c


def test_only_touched_buckets_are_written(spark, made):
    before = made.listing()
    assert made.read().count() == 101 and len(before.places) == 16
    new = table(spark, [(5, "b5"), (500, "b500"), (5, "b5")])
    after = made.merge(new)
    changed = {b for b in after.places if after.places[b] != before.places.get(b)}
    own = {r.b for r in new.select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    assert changed == own and len(changed) <= 2
    want = {k: f"a{k}" for k in range(100)} | {5: "b5", 500: "b500", None: "none"}
    assert rows(made.read()) == sorted(want.items(), key=str)
    assert made.read(before.number).count() == 101 and dict(rows(made.read(before.number)))[5] == "a5"  # a reader of the old list
    assert rows(made.read()) == rows(Collection(spark, made.path).read())
    made.merge(new)  # once more
    assert rows(made.read()) == sorted(want.items(), key=str)


def test_a_failed_merge_is_not_seen(spark, made, monkeypatch):
    was = rows(made.read())

    def stop(new):
        raise KeyboardInterrupt

    monkeypatch.setattr(made, "_publish", stop)
    with pytest.raises(KeyboardInterrupt):
        made.merge(table(spark, [(1, "x")]))
    monkeypatch.undo()
    assert rows(made.read()) == was
    made.merge(table(spark, [(1, "x")]))
    assert dict(rows(made.read()))[1] == "x"


def test_two_merges_at_once(spark, made):
    now = made.listing()
    first, second = (made._merged(now, table(spark, [(1, v)]), None) for v in "xy")
    made._publish(first)
    with pytest.raises(RuntimeError):
        made._publish(second)
    assert dict(rows(made.read()))[1] == "x"


def test_no_rows_and_tidying(spark, made):
    was = rows(made.read())
    made.merge(table(spark, []))
    for v in "xyz":
        made.merge(table(spark, [(1, v)]))
    made.tidy(1)
    assert dict(rows(made.read()))[1] == "z" and len(rows(made.read())) == len(was)
    named = set(made.listing().places.values())
    data = f"{made.path}/data"
    assert {f"data/{v}/{b}" for v in os.listdir(data) for b in os.listdir(f"{data}/{v}") if b.startswith("__bucket")} == named
    with pytest.raises(FileExistsError):
        made.create(table(spark, []), "id")
    with pytest.raises(FileNotFoundError):
        Collection(spark, made.path + "-none").read()


def test_a_stream_merges_each_batch_once(spark, made, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    for k, v in enumerate(("x", "y")):
        table(spark, [(1, v), (200 + k, v)]).coalesce(1).write.mode("append").parquet(source)
        made.merge_stream(spark.readStream.schema("id long, v string").parquet(source), checkpoint).awaitTermination()
    assert dict(rows(made.read()))[1] == "y" and made.read().count() == 103
    number = made.listing().number
    for f in ("commits/1", "commits/.1.crc"):  # as if the query had stopped before it knew that the batch was merged
        os.path.exists(f"{checkpoint}/{f}") and os.remove(f"{checkpoint}/{f}")
    made.merge_stream(spark.readStream.schema("id long, v string").parquet(source), checkpoint).awaitTermination()
    assert made.listing().number == number and made.read().count() == 103


def test_rows_without_a_key_replace_each_other(spark, tmp_path):
    made = Collection(spark, f"file://{tmp_path}/c")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    made.create(rows((None, "a"), (1, "a"), (2, "a")), "id", 4)
    for v in "bc":
        made.merge(rows((None, v), (2, v)))
    assert sorted(map(tuple, made.read().collect()), key=str) == [(1, "a"), (2, "c"), (None, "c")]
