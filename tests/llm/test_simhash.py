import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.common import table
from tests.llm.tables import clashing, docs, edge_rows, prose


def plain_fingerprint(text):
    """Straight from the definition, by strings."""
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps: dict):
    """Smallest id reachable, over all pairs."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "one", "one two three", "A B c D e", "  Ärger\tÄRGER\x0bx y z\n" * 3, "é x a b c d", prose(4, 3000)])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_links_are_those_of_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = {f: 0 for f in base}
    for f in base[:30]:
        for k in range(7):
            g = f
            for b in r.sample(range(64), k):
                g ^= 1 << b
            fps[g] = 0
    fps |= {0: 0, (1 << 64) - 1: 0, 1 << 63: 0, 0b1111: 0, 0b11111: 0}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    assert {frozenset(x) for x in got} == want and len(got) == len(want)  # each once


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (900, 900)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and 900 not in got


def test_whole_table_against_all_pairs(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    want = plain_components({i: plain_fingerprint(t) for i, t in zip(d.doc_id, d.text)})
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, sf, "documents")).collect()}
    assert got == want


def test_edges(spark):
    rows = edge_rows()
    got = simhash.near_duplicates(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16 and by[4].component_id == 2
    assert by[7].component_id == 1 and by[5].component_id == 5
    assert by[None].component_id is None or by[None].component_id >= 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    d = clashing(docs(spark, [(1, prose(1)), (2, prose(1)), (3, prose(3)), (3, prose(3)), (4, None), (5, " ")]))
    got = simhash.keep_one(d)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_keep_one_drops_linked_rows_only(spark):
    rows = [(1, prose(1)), (None, prose(1)), (None, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)), (7, prose(5)), (7, prose(6)), (7, prose(6)), (8, prose(6))]
    got = simhash.keep_one(clashing(docs(spark, rows))).collect()
    want = [(1, prose(1)), (None, prose(2)), (None, prose(3)), (None, prose(4)), (7, prose(5)), (7, prose(6))]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_keep_one_by_brute_force(spark):
    """With null and repeated ids and near copies: one row of every component of all rows, one with its smallest id."""
    r = random.Random(6)
    rows = []
    for i in range(120):
        words = prose(i % 25, 150).split()
        words[r.randrange(150)] = f"x{r.randrange(4)}"
        rows.append((r.choice([None, i, i // 3, 5]), " ".join(words)))
    groups = plain_components({k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)})
    want = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(groups[k], []).append((i is None, i))
    got = simhash.keep_one(docs(spark, rows).repartition(4)).collect()
    place = {}
    for k, row in enumerate(rows):
        place.setdefault(row, groups[k])
    assert sorted(((place[x.doc_id, x.text], x.doc_id) for x in got), key=str) == sorted(((g, min(v)[1]) for g, v in want.items()), key=str)


def test_large_groups(spark):
    rows = [(i, prose(1)) for i in range(300)] + [(1000 + i, prose(1, 200) + f" tail{i}") for i in range(100)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert {got[i] for i in range(300)} == {0}
    want = plain_components({i: plain_fingerprint(t) for i, t in rows if i >= 1000 or i == 0})
    assert all(got[i] == c for i, c in want.items())
    assert np.unique(list(got.values())).size >= 1


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    plans, real = [], simhash.written

    def spy(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, tag)

    monkeypatch.setattr(simhash, "written", spy)
    rows = spark.createDataFrame([(i, f"one two three {i % 7}") for i in range(40)], "doc_id long, text string")
    for df in (simhash.dedup_components(rows), simhash.keep_one(rows), simhash.links(spark.range(9).selectExpr("id AS fp"))):
        spy(df, "last")
    assert len(plans) > 9 and not [p for p in plans if "Broadcast" in p]
