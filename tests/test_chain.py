from pyspark.sql import functions as F

from lodestone.functions.models import embed
from lodestone.operators import retrieval
from lodestone.operators.conversation import is_admin
from lodestone.plans import chain


def test_turn(spark):
    rows = []
    for i in range(60):
        dieu, khoan = i // 12 + 1, i % 12 // 3 + 1
        rows.append((i, "168/2024/NĐ-CP", "Nghị định", dieu, f"Tiêu đề {dieu}", str(khoan), "abc"[i % 3] if i % 3 else None, 3 if i % 3 else 2, "t", "active" if i % 10 else "repealed", f"Điều {dieu} khoản {khoan} chủ đề số{dieu} việc{i} phạt tiền {i + 1}00.000 đồng" + (" hình thức xử phạt bổ sung" if i % 12 == 11 else "")))
    corpus = spark.createDataFrame(rows, "id long, doc string, name string, dieu int, dieu_title string, khoan string, diem string, level int, topic string, status string, content string")
    vectors = embed(corpus.select("id", "content"), "content").select("id", "embedding")
    asked = [
        (1, "chủ đề số2 việc15", "chủ đề số2", "penalty", "o_to", ["chủ đề số2 việc15", "việc16 phạt"], None),
        (2, "khoản 2 Điều 5 là gì", "khoản 2 Điều 5", "definition", "any", None, None),
        (3, "các trường hợp số4", "", "mixed", "mo_to", ["số4", "số3"], "không dùng"),
        (4, "zzz", "", "fault", "any", ["", "qqq"], "yyy"),
    ]
    questions = spark.createDataFrame(asked, "query_id long, text string, raw string, intent string, vehicle string, expanded array<string>, hyde string")
    turn = chain.legal_turn(corpus, vectors, questions, lambda df: embed(df, "text"))
    chunks = {}
    for r in turn.chunks.orderBy("query_id", "pos").collect():
        chunks.setdefault(r.query_id, []).append(r)
    assert all(len({r.id for r in c}) == len(c) for c in chunks.values())
    assert 15 in {r.id for r in chunks[1]} and chunks[1][0].id // 12 == 1 and any(r.is_sibling for r in chunks[1])
    assert {48 + k for k in range(3, 6)} <= {r.id for r in chunks[2]}
    primaries = [r for r in chunks[1] if not r.is_sibling]
    assert len(primaries) <= 15
    verdicts = {r.query_id: r for r in turn.verdicts.collect()}
    assert verdicts[1].passed and verdicts[1].multi_frame and not verdicts[2].multi_frame
    prompts = {r.query_id: r for r in turn.prompts.collect()}
    assert prompts[1].route == "generate" and "[Nguồn 1] Nghị định (168/2024/NĐ-CP)" in prompts[1].context and "USER VEHICLE: ô tô" in prompts[1].hints
    assert prompts[4].route in ("clarify", "generate") and len(prompts) == 4


def test_search_shuffles_no_postings(spark, monkeypatch):
    """Words are scored where the documents lie; as before, only active documents are found, the lowest ids where no word fits."""

    def never(*_):
        raise AssertionError("postings meet the words of the queries in a join")

    monkeypatch.setattr(retrieval, "bm25_scores", never)
    rows = [(i, "d", 1, "1", None, 2, "t", "active" if i % 5 else "repealed", f"w{i} w{i % 3} common") for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, doc string, dieu int, khoan string, diem string, level int, topic string, status string, content string")
    vectors = embed(corpus.select("id", "content"), "content").select("id", "embedding")
    lists = embed(spark.createDataFrame([(1, 0, "w7"), (1, 1, "w10 w11"), (2, 0, "nowhere")], "query_id long, list int, text string"), "text")
    per_list = spark.createDataFrame([(1, 3), (2, 3)], "query_id long, per_list int")
    hits = [r for r in chain.search(corpus, vectors, lists, per_list).collect() if not r.is_sibling]
    assert {r.id for r in hits if (r.query_id, r.list) == (1, 0)} >= {7} and {r.id for r in hits if (r.query_id, r.list) == (1, 1)} >= {11}
    assert all(r.id % 5 for r in hits) and len(hits) == 9


def test_texts_to_embed_come_in_bounded_batches(spark):
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    try:
        for n in names:
            spark.conf.unset(n)
        df = embed(spark.range(3000).selectExpr("cast(id AS string) AS text"), "text")
        assert [int(spark.conf.get(n)) for n in names] == [1000, 8 << 20] and df.where("size(embedding) = 64").count() == 3000
    finally:
        for n in names:
            spark.conf.unset(n)


def test_admin_gate(spark):
    df = spark.createDataFrame([("A@b.c",), (None,)], "e string")
    gate = lambda allowed: [r.x for r in df.select(is_admin(F.col("e"), allowed).alias("x")).collect()]
    assert gate("*") == [True, True] and gate("") == [False, False] and gate(None) == [False, False] and gate("x@y.z, a@B.c") == [True, False]
