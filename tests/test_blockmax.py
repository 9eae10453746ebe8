"""The stored index against plain BM25 over the whole corpus, and what it doesn't read."""

import random

import pytest
from pyspark.errors import AnalysisException

from lodestone.operators import blockmax as B
from lodestone.operators import retrieval as R
from lodestone.sources.scratch import kept

VOWELS = {"en": "aeiou", "de": "äöü", "fr": "éèà"}


def text(r, lang, n):
    """Words of a language, some of them far commoner than others."""
    letters = VOWELS[lang]
    return " ".join(f"{r.choice('bdfgklm')}{r.choice(letters)}{'rstn'[min(3, int(r.expovariate(1)))]}{r.choice(letters)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(11)
    docs = [(k, text(r, r.choice(list(VOWELS)), r.randint(0, 60))) for k in range(600)]
    docs += [(700 + k, docs[5][1]) for k in range(80)] + [(900, None), (901, ""), (-5, "đặc biệt")]
    questions = [(k, " ".join(r.sample((docs[k * 7][1] or "x").split() or ["x"], min(6, len((docs[k * 7][1] or "x").split()) or 1)))) for k in range(40)] + [(50, "đặc biệt"), (51, "nothing here zzz"), (52, ""), (53, None), (54, docs[5][1])]
    return spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(questions, "query_id long, text string")


def rows(df):
    return sorted(tuple(x) for x in df.select("query_id", "id", "score", "rank").collect())


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bm25"))
    B.write_index(tables[0], path, slice_docs=8)
    return B.open_index(spark, path)


@pytest.mark.parametrize("k", [1, 7, 30])
def test_as_plain_bm25(tables, index, k):
    """Copies, ties, empty documents and questions, words that no document has."""
    assert rows(B.block_topk(index, tables[1], k)) == rows(R.bm25_topk(*tables, k))


def test_of_allowed_documents(tables, index):
    allowed = tables[0].where("id % 3 = 1")
    assert rows(B.block_topk(index, tables[1], 20, allowed)) == rows(R.bm25_topk(*tables, 20, allowed))


def test_most_blocks_are_skipped(tables, index, monkeypatch):
    """Of all pairs of a question and a slice, those that are scored; the best hits lie in few of them."""
    monkeypatch.setattr(B, "FIRST_SLICES", 4)
    asked = tables[1].where("query_id < 40")
    found = B.search(index, asked, 5)
    scored, slices = found.scored.count(), index.documents.select("slice").distinct().count()
    assert scored == found.scored.distinct().count() and scored < 0.35 * 40 * slices and scored < 0.8 * found.bounds.count()
    assert rows(B.block_topk(index, asked, 5)) == rows(R.bm25_topk(tables[0], asked, 5))


def test_bounds_hold(tables, index):
    """No document scores more than its slice's bound."""
    weights = B.query_weights(index, tables[1])
    bound = B.bounds(index.blocks, weights)
    every = B.scores(index.blocks, weights, bound).join(index.documents, "id").join(bound, ["query_id", "slice"])
    assert every.where("score > bound + 1e-6").count() == 0 and every.count() > 0


def test_empty_corpus_and_unfinished_index(spark, tables, tmp_path):
    B.write_index(tables[0].where("id IS NULL"), str(tmp_path / "none"))
    assert B.block_topk(B.open_index(spark, str(tmp_path / "none")), tables[1]).count() == 0
    with pytest.raises(AnalysisException):
        B.open_index(spark, str(tmp_path / "nothing"))


def test_what_is_kept_is_built_once(spark, tmp_path):
    source, built = str(tmp_path / "t"), []
    spark.range(3).write.parquet(source)
    for _ in range(2):
        path = kept(spark, "thing", [spark.read.parquet(source)], built.append)
    assert built == [path]
    spark.range(1).write.mode("append").parquet(source)
    assert kept(spark, "thing", [spark.read.parquet(source)], built.append) != path and len(built) == 2
