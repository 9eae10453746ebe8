import math
import os
import re

import duckdb
import pandas as pd

from lodestone.llm import mixing
from lodestone.llm.common import table
from tests.llm.tables import clashing, docs, edge_rows, prose


def plain_targets(sizes: dict):
    """Shares by weight; what is above twice a source's size goes back to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2.0 * sizes[s] for s in above)
        open_ -= above
    return out


def check(got, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        s = r[3] if len(r) > 3 else "s"
        sizes[s] = sizes.get(s, 0) + size(r[1])
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    by_source = {}
    for r, row in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.size)), sorted(rows, key=lambda r: (r[0] or -1, size(r[1]))), strict=True):
        s = row[3] if len(row) > 3 else "s"
        assert r.size == size(row[1]) and r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-5)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_source.setdefault(s, []).append(r)
    for s, rs in by_source.items():
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r.size for r in rs) + 1e-6


def test_targets_and_budgets(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", f"s{i % 7}" if i % 3 else "s0") for i in range(400)] + [(1000 + i, prose(i, 9), "en", None) for i in range(5)]
    got = mixing.mix_plan(docs(spark, rows)).collect()
    check(got, rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_plan(docs(spark, rows[::-1]).repartition(3)).collect()))


def test_keys_follow_quality(spark):
    """Documents of letters come into a fractional epoch before documents of signs."""
    rows = [(i, prose(i, 20) if i % 2 else " ".join(["12345"] * 20), "en", "a") for i in range(400)] + [(1000 + i, prose(i, 20), "en", "b") for i in range(40)]
    got = pd.DataFrame([r.asDict() for r in mixing.mix_plan(docs(spark, rows)).collect()])
    a = got[got.doc_id < 1000]
    assert a[a.doc_id % 2 == 1].taken.sum() > a[a.doc_id % 2 == 0].taken.sum()


def test_edges(spark):
    rows = edge_rows()
    got = mixing.mix_plan(clashing(docs(spark, rows))).collect()
    check(got, rows)
    assert mixing.mix_plan(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_plan(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_rows_without_id_and_equal_rows_meet_the_targets(spark):
    """Rows that share id, text and size are taken one by one: targets are met to half a document."""
    rows = [(None, prose(i, 10), "en", "a") for i in range(1000)] + [(7, prose(1, 10), "en", "b")] * 1000 + [(i, prose(2, 10), "en", "c") for i in range(50)]
    d = docs(spark, rows).repartition(5)
    got = pd.DataFrame([r.asDict() for r in mixing.mix_plan(d).collect()])
    assert len(got) == len(rows)
    for n, g in got.groupby("source_size"):
        assert all(abs(x.taken.sum() - t) <= 5 for t, x in g.groupby("target"))
    mixed = mixing.mix(d).toPandas()
    want = got.groupby("target").taken.sum().round(6).to_dict()
    assert mixed.groupby("target").taken.sum().round(6).to_dict() == want


def test_mix_keeps_rows(spark):
    d = docs(spark, [(i, prose(i, 30), "en", f"s{i % 3}") for i in range(90)])
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(d).collect()}
    got = mixing.mix(d).collect()
    assert {r.doc_id: r.taken for r in got} == {i: t for i, t in plan.items() if t} and all(r.text == prose(r.doc_id, 30) for r in got)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted((r[0], r[1], r[2], round(r[3], 4), r[4]) for r in c.execute(mixing.ORACLE).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 4), r.taken) for r in mixing.mix_plan(table(spark, sf, "documents")).collect())
    assert got == want and os.path.exists(sf)
