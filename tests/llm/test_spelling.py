"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

from lodestone.llm import spelling
from tests.llm.tables import clashing, docs, edge_rows


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * c else None
    out = set()
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_all_pairs(spark):
    r = random.Random(3)
    words = {}
    for _ in range(700):
        w = "".join(r.choice("abé÷") for _ in range(r.randint(5, 9)))
        words[w] = 3 + int(r.paretovariate(0.5)) % 10_000
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain(words)
    assert any(x.root != x.form and x.form for x in got.collect())


def test_astral_and_short_words(spark):
    """Code points, not bytes or pairs of surrogates; words shorter than the segments are long."""
    words = {"a": 9, "b": 8, "ab": 7, "😀b": 20, "😀😀b": 3, "é": 4, "": 5}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain(words)


def test_ties_and_chains(spark):
    words = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "zaaaaa": 6}
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaa"] == ("aaaaab", "aabbbb") and got["zaaaaa"] == (None, "zaaaaa")


def test_counts_and_errors(spark):
    r = random.Random(8)
    base = ["Straße", "colour", "COLOR", "Ünite", "naïve", "abcde", "theatre", "theater"]
    rows = [(r.choice([None, k, 7]), " ".join(r.choice(base) for _ in range(60)) + "|x÷yzzz9abcdef") for k in range(60)] + [(x[0], x[1]) for x in edge_rows() if x[0] != 6]
    got = spelling.groups(clashing(docs(spark, rows)))
    assert {tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain(plain_words(rows))


def test_empty(spark):
    assert spelling.groups(docs(spark, [])).count() == 0 and spelling.groups(docs(spark, [(1, None), (2, "")])).count() == 0


def test_no_broadcast_of_the_index(spark):
    words = spark.createDataFrame([("abcde", 3)], "word string, n long")
    plan = spelling.pairs(words)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
