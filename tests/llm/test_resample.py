"""Resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import resample
from tests.llm.tables import clashing, docs, edge_rows, prose


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def plain(rows, target):
    """doc_id, n_features, weight and score by rows, and the drawn rows' places."""
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    out = []
    for i, x in rows:
        g = [gain(bucket(f)) for f in features(x)]
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def target(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


TARGET = [prose(1)[:200], None, "", "ÀB c-d_E9"]


def test_plain_counting(spark):
    rows = [(i, prose(i, 3 + i)) for i in range(60)] + [(5, prose(5, 8)), (5, prose(5, 8)), (70, "Ünï CÖDE a\x7fb 7" * 9)] + [(r[0], r[1]) for r in edge_rows()]
    got = resample.importance(clashing(docs(spark, rows)), target(spark, TARGET)).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(plain(rows, TARGET))
    able = sorted((r for r in plain(rows, TARGET) if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert drawn == [(k + 1, r[0], r[3]) for k, r in enumerate(able[: len(able) * 25 // 100])] and drawn


@pytest.mark.parametrize("part", [1, 5, 50])
def test_parts_of_a_text(monkeypatch, part):
    text = prose(3, 50) + " É!" + " x" * 20
    want = Counter(map(bucket, features(text)))
    monkeypatch.setattr(resample, "PART", part)
    assert Counter(resample.buckets(text.encode()).tolist()) == want


def test_a_third_of_all_rows_shares_id_and_text(spark):
    """Their ranks are all different, and follow each other."""
    rows = [(i, prose(i, 30)) for i in range(40)] + [(7, prose(7, 30))] * 40
    got = resample.importance(docs(spark, rows), target(spark, TARGET), percent=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, 81))
    same = sorted(r.rank for r in got if r.doc_id == 7)
    assert same == list(range(same[0], same[0] + 41))


def test_empty_tables(spark):
    assert resample.importance(docs(spark, []), target(spark, TARGET)).count() == 0
    got = resample.importance(docs(spark, [(1, prose(1)), (2, None)]), target(spark, []), percent=100).collect()
    assert {(r.doc_id, r.rank, r.n_features) for r in got} == {(1, 1, 119), (2, None, 0)}


def test_draw_keeps_rows_whole(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3, k]), prose(k, 40)) for k in range(40)]
    df = clashing(docs(spark, rows)).selectExpr("*", "1 AS `a.b`", "2 AS Rank", "3 AS resample_row", "4 AS `drawn_row`", "5 AS `x``y`")
    got = resample.draw(df, target(spark, TARGET), percent=50)
    assert got.columns == df.columns and got.count() == 20
    assert not Counter(map(tuple, got.select("doc_id", "text").collect())) - Counter(rows)
