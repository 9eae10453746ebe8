"""Hand-derived cases of single operators."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.fixed import REFUSAL
from lodestone.functions.models import embed, passage_prefix, query_prefix
from lodestone.operators import chunking, conversation, enrich, generation, retrieval
from lodestone.operators import text as T


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, retrieval.tokens(F.col("t")), t="Xe của tôi, A đi 80km/h!") == ["xe", "tôi", "đi", "80km"]
    assert one(spark, retrieval.tokens(F.col("t")), t="") == []


@pytest.mark.parametrize("text, n", [("a " * 10, 13), ("a b c", 3), ("", 0)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate(F.col("t")), t=text) == n


def test_clauses(spark):
    got = one(spark, chunking.clauses_of(F.col("t")), t="1. Người …\n2. xe …\n3. Ô tô …")
    assert [(c.khoan, c.text) for c in got] == [("1", "1. Người …\n2. xe …\n3. Ô tô …")]
    got = one(spark, chunking.clauses_of(F.col("t")), t="Điều 1. X\n1. An\n2. Ban")
    assert [(c.khoan, c.text) for c in got] == [("0", "Điều 1. X"), ("1", "1. An\n"), ("2", "2. Ban")]


def test_points(spark):
    got = one(spark, chunking.points_of(F.col("t")), t="Phạt tiền:\na) Đi; b) Đứng")
    assert [(p.diem, p.text) for p in got] == [("", "Phạt tiền:"), ("a", "Phạt tiền:\na) Đi"), ("b", "Phạt tiền:\nb) Đứng")]
    assert [(p.diem, p.text) for p in one(spark, chunking.points_of(F.col("t")), t="không có")] == [("", "không có")]


def test_line_merge(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["Người lái", "xe phải", "1. Dừng", "Lại"])], "doc_id long, pos int, line string")
    assert [r.line for r in T.merge_lines(lines).orderBy("line_no").collect()] == ["Người lái xe phải", "1. Dừng", "Lại"]


def test_clean_pages(spark):
    df = spark.createDataFrame([(1, "Chương I Đầu\nĐiều 3. Tên\nTrang 4/9\nTừ ngày 1 tháng 2 năm 2024,\nkhí CO2 ......\n\n☐ có")], "doc_id long, text string")
    assert [r.line for r in T.clean_pages(df).orderBy("line_no").collect()] == ["# Chương I Đầu", "## Điều 3. Tên", "Từ **ngày 1 tháng 2 năm 2024**, khí $$CO2$$  [Cần điền thông tin]", "[Lựa chọn]  có"]


def test_markdown_table(spark):
    rows = [["A", "B"], ["x", "1"], [None, "2"], ["", ""], ["y"]]
    cells = spark.createDataFrame([(1, i, j, c) for i, r in enumerate(rows) for j, c in enumerate(r)], "tbl long, row int, col int, cell string")
    assert T.markdown_tables(cells).first().markdown == "| A | B |\n|---|---|\n| x | 1 |\n| x | 2 |\n| y | 2 |"


def test_keyword_policy(spark):
    df = spark.createDataFrame([("f", "a"), ("f", "ab"), ("f", "c"), ("g", "b"), ("h", "z")], "file string, text string")
    policy = spark.createDataFrame([("f", False, ["a"], ["b"]), ("g", True, ["a"], ["b"])], "file string, keep_all boolean, include array<string>, exclude array<string>")
    assert sorted(tuple(r) for r in T.keep_by_keywords(df, "text", policy, "file").collect()) == [("f", "a"), ("g", "b"), ("h", "z")]


def test_refine(spark):
    got = one(spark, T.refine(F.col("t")), t="xe-\n  máy chạy\ntrên đường\n-------\n\n\n\n| a |\n |b|\nEnd -\n| c |")
    assert got == "xe-máy chạy trên đường\n\n| a |\n |b|\nEnd -__TABLE_LINE_10__"


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, rank int")


def test_rrf(spark):
    dense, bm25 = hits(spark, [(1, 5, 1), (1, 7, 2)]), hits(spark, [(1, 7, 1), (1, 9, 2)])
    assert [(r.id, r.score) for r in retrieval.rrf_hybrid(dense, bm25, 3).orderBy("rank").collect()] == [(7, round(1 / 62 + 1 / 61, 9)), (5, round(1 / 61, 9)), (9, round(1 / 62, 9))]
    assert [r.id for r in retrieval.rrf_hybrid(hits(spark, [(1, 5, 1)]), hits(spark, [(1, 9, 1)]), 3).orderBy("rank").collect()] == [5, 9]


def corpus(spark, rows):
    return spark.createDataFrame([(i, "d", a, str(c), None, 3, x) for i, a, c, x in rows], "id long, doc string, dieu int, khoan string, diem string, level int, content string")


def test_neighbours(spark):
    c = corpus(spark, [(k, 6, k, "") for k in range(2, 9)])
    primary = spark.createDataFrame([(1, 5, 1, 0.5)], "query_id long, id long, pos int, score double")
    assert sorted(r.id for r in enrich.with_siblings(primary, c).where("is_sibling").collect()) == [3, 4, 6, 7]


@pytest.mark.parametrize(
    "text, want",
    [("điểm h khoản 14 Điều 32", [(32, "14", "h"), (32, "14", None)]), ("Điều 6 Khoản 9 Điều 7 Khoản 7", [(7, "9", None)]), ("khoản 3", []), ("điểm a khoản 2; điều 5", [(5, "2", "a"), (5, "2", None)])],
)
def test_references(spark, text, want):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    assert [(r.dieu, r.khoan, r.diem) for r in enrich.references(df, "t", ("k",)).orderBy("ref_no").collect()] == want


@pytest.mark.parametrize("k, n, want", [(15, 2, 9), (25, 2, 14), (15, 6, 8)])
def test_budget(spark, k, n, want):
    assert one(spark, enrich.budget(F.col("k"), F.col("n")), k=k, n=n) == want


def test_diversity(spark):
    c = corpus(spark, [(i, 1, 1 if i < 4 else 2, "") for i in range(7)])
    rows = [(1, i, i + 1, 0.1, i == 5) for i in range(6)]
    chunks = spark.createDataFrame(rows, "query_id long, id long, pos int, score double, is_sibling boolean")
    keep = lambda target: [r.id for r in enrich.diversify(chunks, c, target=target).orderBy("pos").collect()]
    assert keep(4) == [0, 1, 2, 4] and keep(2) == [0, 1] and keep(9) == [0, 1, 2, 4, 5]


def test_judge(spark):
    c = corpus(spark, [(1, 1, 1, "Điều 5 xe máy")])
    q = spark.createDataFrame([(1, "xe máy", "penalty"), (2, "xe", "penalty")], "query_id long, text string, intent string")
    chunks = spark.createDataFrame([(1, 1, 1, 0.016, False)], "query_id long, id long, pos int, score double, is_sibling boolean")
    assert sorted(tuple(r) for r in enrich.judge(chunks, c, q).collect()) == [(1, 2.0, True), (2, 0.0, False)]


def test_citations(spark):
    df = spark.createDataFrame([(1, "[Điều 6, Khoản 9 — NĐ 168/2024/NĐ-CP]"), (2, "[Điều 6 — Luật (36/2024/QH15)]")], "query_id long, answer string")
    assert [(r.dieu, r.khoan, r.diem) for r in generation.citations(df).collect()] == [("6", "9", None)]


@pytest.mark.parametrize("text, want", [(REFUSAL, True), (REFUSAL[:-1], True), (REFUSAL + " x", False)])
def test_refusal(spark, text, want):
    assert one(spark, generation.is_refusal(F.col("t")), t=text) is want


def test_dedup_within_documents(spark):
    df = spark.createDataFrame([("f", 1, "x"), ("f", 2, "x"), ("g", 1, "x")], "file string, pos int, content string")
    assert chunking.dedup_first(df, ("file",), "content", ("pos",)).count() == 2


def test_metrics(spark):
    rows = spark.createDataFrame([(4, False, 1), (3, True, 2), (3, False, 3)], "ms long, failed boolean, ts long")
    assert tuple(conversation.request_metrics(rows).first()) == (3, 1, 3.3, 3)
    assert conversation.request_metrics(rows.limit(0)).first().mean_ms is None


def test_status_filter(spark):
    df = spark.createDataFrame([(1, "active", "t", "d"), (2, "repealed", "u", "e")], "id long, status string, topic string, doc string")
    n = lambda **k: retrieval.filtered(df, **k).count()
    assert (n(), n(status=None), n(status="all"), n(status="active"), n(status="all", not_topics=("t",))) == (1, 2, 2, 1, 1)


def test_lookup(spark):
    c = spark.createDataFrame([(1, "d", 6, "9", "c"), (2, "d", 6, "9", "a"), (3, "d", 6, "8", None)], "id long, doc string, dieu int, khoan string, diem string")
    refs = spark.createDataFrame([(1, "d", "6", None, None), (2, "d", "6", "9", "C"), (3, "d", "x", None, None)], "n long, doc string, dieu string, khoan string, diem string")
    assert sorted((r.n, r.id) for r in enrich.lookup(refs, c).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_embedding_stub(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    rows = {r.id: r.embedding for r in embed(df, "t", prefix=query_prefix("x-e5-base")).collect()}
    assert len(rows[1]) == 64 and abs(sum(v * v for v in rows[1]) - 1) < 1e-6
    assert query_prefix("bge") == "" and passage_prefix("e5") == "passage: "


def test_containing_against_every_pair(spark):
    from lodestone.operators.conversation import containing

    texts = [(0, "a b c d e f g h"), (1, "xa b c d e f gx"), (2, "b c d e  f g"), (3, "e f g h i j a b c d e f"), (4, None), (5, ""), (6, "a b"), (7, "c d e f g h a b c d e f g h")]
    items = [(0, "a b c d e f"), (1, "b c d e f g"), (2, "a b"), (3, ""), (4, None), (5, "c d e f g h"), (6, "d e  f g"), (7, "a b c d e f g h i"), (8, "c d e"), (9, "a b c d"), (10, "b  f"), (11, "x"), (12, " "), (13, "d e f g h")]
    want = {(q, i) for q, x in items for i, t in texts if x is not None and t is not None and x in t}
    got = [tuple(r) for r in containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(items, "query_id long, text string")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_context_and_confidence_without_hits(spark):
    from lodestone.functions.fixed import NO_CONTEXT
    from lodestone.operators import enrich, generation

    q = spark.createDataFrame([(1, "một câu hỏi", "penalty")], "query_id long, text string, intent string")
    chunks = spark.createDataFrame([], "query_id long, id long, pos int, score double, is_sibling boolean, doc string, name string, dieu int, dieu_title string, khoan string, diem string, content string")
    assert [tuple(r) for r in generation.render_context(chunks, q).collect()] == [(1, NO_CONTEXT)]
    corpus = spark.createDataFrame([], "id long, content string")
    assert [tuple(r) for r in enrich.judge(chunks.select("query_id", "id", "pos", "score", "is_sibling"), corpus, q).collect()] == [(1, 0.0, False)]


def test_recall_gate_leaves_siblings_out(spark):
    from lodestone.operators.conversation import recall_gate
    from lodestone.operators.retrieval import fetch_size

    hits = spark.createDataFrame([(1, 1, "d", 1, "1", False), (1, 2, "d", 1, "2", True), (1, 11, "d", 1, "3", False), (2, 1, "d", 9, None, False)], "query_id long, rank int, doc string, dieu int, khoan string, is_sibling boolean")
    gold = spark.createDataFrame([(1, "d", 1, "1"), (1, "d", 1, "2"), (1, "d", 1, "3"), (2, "d", 8, "1"), (1, "d", 1, "1")], "query_id long, doc string, dieu int, khoan string")
    r = recall_gate(hits, gold, 10).first()
    assert r.n_questions == 2 and abs(r.mean_recall - 1 / 6) < 1e-9 and not r.passed
    assert recall_gate(hits, gold, 10, 0.1).first().passed
    assert (fetch_size(5, 20, True), fetch_size(5, 20, False), fetch_size(30, 20, True)) == (20, 5, 30)


def test_models_that_fail_cost_their_own_rows_only(spark):
    from lodestone.functions.models import ask

    def model(prompts):
        if "bad" in prompts:
            raise ValueError
        return prompts[:1] if "short" in prompts and len(prompts) > 1 else [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("short",), ("b",), (None,)], "p string").coalesce(1)
    assert [r.x for r in df.select(ask(F.col("p"), model, 3).alias("x")).collect()] == ["A", None, "SHORT", "B", ""]


def test_boxes_of_all_sizes_against_every_pair(spark):
    """Tiny, huge, endless, upside-down and broken boxes; characters on borders, negative, far out, without a place; one hot page."""
    import random

    from lodestone.operators.text import outside_boxes

    r = random.Random(2)
    far = float("inf")
    boxes = [(r.choice([1, 1, 1, 2]), x, y, x + w, y + h) for x, y, w, h in ((r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0.0, 3, 62.0, 200]), r.choice([0.0, 5, 64.0, 150])) for _ in range(60))]
    boxes += [(3, -1e300, 0.0, 1e300, 4.0), (4, 0.0, 10.0, far, 20.0), (5, 10.0, 10.0, 9.0, 30.0), (6, None, 0.0, 9.0, 9.0), (7, 0.0, 0.0, 1e6, 1e6), (None, 0.0, 0.0, 9.0, 9.0)]
    chars = [(k, r.choice([1, 1, 2, 3, 4, 5, 6, 7, None]), r.choice([r.uniform(-600, 600), 9.5, 1e13, -2.0, 64.0, None]), r.choice([r.uniform(-600, 600), 12.0, -64.0, 22.0, 1e6 + 2])) for k in range(1500)]
    inside = lambda p, x, y: any(p is not None and p == q and x is not None and None not in (a, b, c, d) and a - 2 <= x <= c + 2 and b - 2 <= y <= d + 2 for q, a, b, c, d in boxes)
    got = outside_boxes(spark.createDataFrame(chars, "n long, page int, x double, y double"), spark.createDataFrame(boxes, "page int, x0 double, top double, x1 double, bottom double"))
    assert sorted(x.n for x in got.collect()) == [n for n, p, x, y in chars if not inside(p, x, y)]
    assert got.columns == ["n", "page", "x", "y"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_rules_without_a_nested_loop(spark):
    """Names that hold each other either way, the empty one, other cases, ties by ordinal; thousands of rules."""
    import random

    from lodestone.operators.chunking import resolve_metadata

    r = random.Random(9)
    word = lambda: "".join(r.choice("abĐ_") for _ in range(r.randint(2, 9)))
    rules = [(word().upper() if k % 5 else word(), k) for k in range(3000)]
    stems = sorted({word() for _ in range(300)} | {"", "zzzz", rules[7][0]})
    fields = ("doc_id", "title", "issuer", "status", "effective_date", "topic")
    table = spark.createDataFrame([(key, n, *[f"{f}{n}" for f in fields]) for key, n in rules], "key string, ordinal int, " + ", ".join(f"{f} string" for f in fields))
    out = resolve_metadata(spark.createDataFrame([(s,) for s in stems] + [(None,)], "stem string"), table)
    want = {None: None}
    for s in stems:
        found = [(key != s, n) for key, n in rules if key.lower() in s.lower() or s.lower() in key.lower()]
        want[s] = f"doc_id{min(found)[1]}" if found else s
    assert {x.stem: x.doc_id for x in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
