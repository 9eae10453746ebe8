"""The corpus laid out by id and by place: same rows as of the plain table, and no shuffle of the corpus."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import enrich as N
from lodestone.sources.places import drop_located, open_located, write_located

CORPUS = "id long, doc string, dieu int, khoan string, diem string, level int, content string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    rows = []
    for k in range(400):
        text = r.choice(["tịch thu phương tiện; hình thức xử phạt bổ sung", f"theo khoản {r.randint(1, 4)} Điều {r.randint(1, 4)}", "x" * r.choice([5, 900])])
        # a third of all chunks stand in one article; others have no article or no clause
        place = ("a", 1) if k % 3 == 0 else (r.choice(["a", "b", "", None]), r.choice([0, 1, 2, 3, None]))
        rows.append((k, *place, r.choice(["1", "2", "3", "4", "x", None]), r.choice(["a", "B", None]), r.choice([1, 2, 3]), text))
    corpus = spark.createDataFrame(rows, CORPUS)
    chunks = spark.createDataFrame([(q, r.randrange(400), p, 1.0 / p, p == 4) for q in range(12) for p in range(1, 6)], "query_id long, id long, pos int, score double, is_sibling boolean").dropDuplicates(["query_id", "id"])
    write_located(corpus, "places_test", str(tmp_path_factory.mktemp("places")), 4)
    yield corpus, open_located(spark, "places_test"), chunks
    drop_located(spark, "places_test")


REFS = "query_id long, ref_no int, doc string, dieu string, khoan string, diem string"
STEPS = {
    "completion": lambda s, k, c: N.completion_siblings(k, c),
    "neighbours": lambda s, k, c: N.neighbour_siblings(k, c),
    "siblings": lambda s, k, c: N.with_siblings(k.drop("is_sibling"), c),
    "lookups": lambda s, k, c: N.append_lookups(k, s.createDataFrame([(q, q % 3, "a", str(q % 4), [None, "", "2"][q % 3], [None, "A"][q % 2]) for q in range(12)], REFS), c),
    "cross_references": lambda s, k, c: N.append_cross_references(k, c, "a"),
    "diversity": lambda s, k, c: N.diversify(k, c, 3),
    "parents": lambda s, k, c: N.pull_parents(k, c),
    "clauses": lambda s, k, c: N.clause_sets(k, c),
    "frames": lambda s, k, c: N.multi_frame(k, c, F.lit("penalty")),
}


def shuffled(plan: str, table: str) -> bool:
    """Whether a scan of the table has an exchange before its first join."""
    above: list[tuple[int, str]] = []  # the nodes on the way down
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        if "Scan" in line and table in line:
            nearest = next((x for _, x in reversed(above) if "Join" in x or "Exchange" in x), "")
            if "Exchange" in nearest:
                return True
        above.append((depth, line.lstrip(" :+-").split("(")[0].split(" [")[0].split(" hash")[0]))
    return False


@pytest.mark.parametrize("name", sorted(STEPS))
def test_same_rows_and_no_shuffle_of_the_corpus(spark, tables, name):
    corpus, located, chunks = tables
    step, old = STEPS[name], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = step(spark, chunks, located), step(spark, chunks, corpus)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "places_test" in plan
        if name in ("completion", "neighbours", "parents", "lookups"):
            assert "places_test_places" in plan and not shuffled(plan, "places_test_places")
        assert name in ("siblings", "cross_references") or not shuffled(plan, "places_test_ids")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
