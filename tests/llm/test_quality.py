import collections
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import quality
from lodestone.llm.common import table
from tests.llm.tables import LABELS, clashing, docs, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = [False] * len(w)
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            marked[i : i + 5] = [True] * 5
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(marked))
    return *n, n[0] < 10 or 100 * n[4] > 20 * n[0]


def judged(spark, texts, rules=()):
    got = quality.judge(docs(spark, list(enumerate(texts))), list(rules)).orderBy("doc_id").collect()
    return [tuple(r)[1:7] for r in got]


def test_base_on_the_table(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.judge(table(spark, sf, "documents"), []).collect()}
    assert got == {i: plain(t) for i, t in zip(d.doc_id, d.text)}


@pytest.mark.parametrize("text", [None, "", "a b c d", "a a a a a a", "a b c d e f a b c d e", "x y\nx y\n\n \nx  y\rz", "𝒳 é # | <>&% * $" * 4, "  a\x1cb", prose(3, 500) + " " + prose(3, 500)])
def test_base_edges(spark, text):
    assert judged(spark, [text]) == [plain(text)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=60), min_size=1, max_size=20))
def test_base_by_chance(spark, texts):
    assert judged(spark, texts) == [plain(t) for t in texts]


def test_learns_a_list():
    r = np.random.default_rng(1)
    x = r.random((900, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.7) & (x[:, 1] < 0.3))
    rules = quality.learn(x, bad)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= rule.covers(x)
    assert (hit == bad).mean() > 0.95
    assert quality.learn(x, np.zeros(900, bool)) == [] and quality.learn(x[:0], bad[:0]) == []


def plain_features(t):
    t = t or ""
    n_words, chars, symbols, dups, repeats, _ = plain(t)
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    share = lambda x, y: x / max(1, y)
    return dict(n_words=n_words, mean_word=share(chars, n_words), symbol_share=share(symbols, chars), dup_line_share=share(dups, len(lines)), repeat_share=share(repeats, n_words), upper_share=share(upper, chars), distinct_share=share(len(set(w)), n_words), lone_share=share(sum(len(x) == 1 for x in w), n_words))


def test_learned_verdicts_by_plain_reading(spark):
    """Statistics and the ordered list, worked out row by row; the list decides on rows that the base rules keep."""
    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/documents.parquet")
    rules = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want, by_rules = {}, 0
    for i, t in zip(d.doc_id, d.text):
        f = plain_features(t)
        hit = any(all(f[name] >= value if at_least else f[name] < value for name, at_least, value in r.conditions) for r in rules)
        want[i] = not plain(t)[5] and not hit
        by_rules += hit and not plain(t)[5]
    got = {r.doc_id: r.kept for r in quality.judge(table(spark, sf, "documents"), rules).collect()}
    assert rules and by_rules > 0 and got == want
    assert sum(r.kept for r in quality.judge(table(spark, sf, "documents"), []).collect()) == sum(want.values()) + by_rules


def test_sample_is_bounded_in_rows(spark, monkeypatch):
    """One labelled id with many rows doesn't come to the driver whole."""
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 20)
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad: seen.append(len(x)) or [])
    rows = [(0, prose(i, 60)) for i in range(300)] + [(i, prose(i, 60)) for i in range(1, 30)]
    quality.fit(docs(spark, rows), spark.createDataFrame([(i, i % 2, 0) for i in range(30)], LABELS))
    assert seen == [40]


def test_fits_and_keeps_clean_rows(spark):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(w + "###" for w in prose(i, 60).split())) for i in range(200)] + [(900, None), (None, prose(5))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(900, 0, 0), (None, 0, None), (3, 1, None)], LABELS)
    d = clashing(docs(spark, rows))
    rules = quality.fit(d, clashing(labels))
    kept = quality.keep_good(d, rules)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(200) if i % 2} | {None} == ids


def test_edges(spark):
    got = quality.judge(clashing(docs(spark, edge_rows())), []).collect()
    assert len(got) == len(edge_rows()) and {r.kept for r in got if r.doc_id in (2, 3, 4, 9)} == {False}
    empty = docs(spark, [])
    assert quality.judge(empty, quality.fit(empty, spark.createDataFrame([], LABELS))).count() == 0
