import random
import tracemalloc

import numpy as np
import pandas as pd

from lodestone.llm import decontam
from lodestone.llm.common import table
from tests.llm.tables import clashing, docs, edge_rows, prose

ITEMS = "item_id long, text string"


def plain_tiles(item: list, doc: list) -> int:
    """Greedy string tiling as it is told: the longest unmarked match, again and again."""
    a, b = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < decontam.MIN_MATCH:
            return sum(a)
        for t in range(best[0]):
            a[best[1] + t] = b[best[2] + t] = True


def test_tiling_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        item = [r.choice("abcd") for _ in range(r.randint(5, 22))]
        doc = [r.choice("abcd") for _ in range(r.randint(5, 40))]
        cut = r.randint(0, len(item))
        doc[5:5] = item[cut:] + ["x"] + item[:cut]
        x, y = (np.array([ord(c) for c in z], np.uint64) for z in (item, doc))
        assert decontam.tile(x, y) == plain_tiles(item, doc)
        # what is left of a document under its seeds gives the same tiles
        hit = np.flatnonzero(np.isin(decontam.seeds_of(y), decontam.seeds_of(x)))
        runs = decontam.runs_of(y, hit)
        if len(hit):
            assert decontam.tile(x, runs) == plain_tiles(item, doc)
            want = plain_tiles(item, doc) / len(item)
            assert decontam.coverage(x, runs) == (want if want >= decontam.COVERAGE else decontam.coverage(x, runs)) and decontam.coverage(x, runs) <= want


def test_repeats_take_bounded_memory():
    """A million repeats of a word against an item of it: memory in proportion to the words, and the whole item is covered."""
    item, doc = np.full(200, 5, np.uint64), np.full(1_000_000, 5, np.uint64)
    tracemalloc.start()
    assert decontam.tile(item, doc) == 200
    mixed = np.tile(np.array([5, 5, 5, 5, 5, 5, 6], np.uint64), 100_000)
    assert decontam.tile(item, mixed) == 198  # 33 runs of six
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6


def report(d, bench):
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, bench).collect()}


def test_planted_reordered_and_clean(spark):
    item = prose(500, 40)
    w = item.split()
    rows = [(1, prose(1, 300) + " " + item.upper() + "! " + prose(2, 300)), (2, prose(3, 50) + " " + " ".join(w[20:]) + " xx " + " ".join(w[:20])), (3, prose(4, 80) + " " + " ".join(w[:20])), (4, prose(5, 200)), (5, ", ".join(w)), (6, "Ba, an!"), (7, "so ba an it is"), (8, "ba an " * 3)]
    bench = spark.createDataFrame([(10, item), (11, prose(501, 30)), (12, "ba an"), (13, None), (10, item), (None, prose(5, 200))], ITEMS)
    got = report(docs(spark, rows), bench)
    assert set(got) == {(1, 10), (2, 10), (5, 10), (6, 12)}
    assert got[1, 10].coverage == 1.0 and got[1, 10].n_items == 1
    assert sorted(r.doc_id for r in decontam.clean(docs(spark, rows), bench).collect()) == [3, 4, 7, 8]


def test_pairs_against_all_pairs(spark, monkeypatch):
    """Every document with every item, by plain tiling; with passages that many items share, small groups and no broadcast."""
    shared = prose(900, 12)
    items = [(i, shared + " " + prose(700 + i, 15 + i % 9)) for i in range(30)] + [(50, prose(800, 5)), (51, "an il or")]
    rows = [(i, prose(i, 30) + " " + (items[i][1] if i < 20 else shared) + " " + (items[i + 1][1] if i % 5 == 0 else "")) for i in range(28)]
    rows += [(100, " ".join(t for _, t in items)), (101, "An il, or"), (102, prose(800, 5) + " x"), (103, shared * 3), (104, None)]
    want = {}
    for i, t in rows:
        for k, x in items:
            words = decontam.tokens(x)
            if len(words) >= decontam.MIN_MATCH:
                share = plain_tiles(words, decontam.tokens(t)) / len(words) if t else 0
            else:
                share = float(decontam.tokens(t) == words)
            if share >= decontam.COVERAGE:
                want.setdefault(i, []).append((-share, k))
    bench, d = spark.createDataFrame(items, ITEMS), docs(spark, rows)
    expected = {(i, min(v)[1]): (-min(v)[0], len(v)) for i, v in want.items()}
    assert {k: (r.coverage, r.n_items) for k, r in report(d, bench).items()} == expected and len(expected) > 20
    monkeypatch.setattr(decontam, "GROUP", 3)
    monkeypatch.setattr(decontam, "BROADCAST_TEXTS", 0)
    assert {k: (r.coverage, r.n_items) for k, r in report(d, bench).items()} == expected
    assert {r.doc_id for r in decontam.clean(d, bench).collect()} == {i for i, _ in rows} - set(want)


def test_filter_lets_seeds_through_and_hardly_more(spark):
    r = np.random.default_rng(2)
    seeds, other = r.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2), r.integers(0, 1 << 63, 400_000, np.uint64) * np.uint64(2) + np.uint64(1)
    maybe, bits = decontam.seed_filter(spark.createDataFrame(pd.DataFrame({"seed": seeds.view(np.int64)})))
    assert bits == 21 and len(decontam.may_be_seeds(seeds, maybe, bits)) == len(seeds)
    assert len(decontam.may_be_seeds(other, maybe, bits)) < 40 and not len(decontam.may_be_seeds(other[:0], maybe, bits))


def test_edges(spark):
    bench = spark.createDataFrame([(1, prose(1))], ITEMS)
    d = clashing(docs(spark, edge_rows()))
    assert sorted(i for i, _ in report(d, clashing(bench))) == [1, 7]
    left = decontam.clean(d, bench)
    assert left.columns == d.columns and left.count() == len(edge_rows()) - 2
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(d, none).count() == 0 and decontam.contaminated(docs(spark, []), bench).count() == 0


def test_table_holds_the_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    d, b = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " " + " ".join(decontam.tokens(t)) + " "
    want = {i for i, t in zip(d.doc_id, map(flat, d.text)) if any(flat(x) in t for x in b.text)}
    got = {r.doc_id for r in decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).collect()}
    assert want and want <= got and len(got) <= len(want) + 2
