import zlib

import pandas as pd

from lodestone.llm import toxicity
from lodestone.llm.common import table
from tests.llm.tables import LABELS, clashing, docs, edge_rows, prose


def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = prose(i, 80)
        if bad:
            w = text.split()
            for k, insult in enumerate(("grobnix", "zlartpest", "vurmhund", "grobnix")):
                w.insert(7 + 15 * k, insult)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, LABELS)


def test_learns_and_holds_out(spark):
    d, labels = labelled(spark)
    got = toxicity.classify(d, labels).toPandas()
    assert len(got) == 240 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.doc_id % 3 == 0)).mean() > 0.95
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_finds_a_toxic_part_of_a_long_text(spark):
    d, labels = labelled(spark)
    model = toxicity.fit(d, labels)
    long = prose(7, 3000)
    dirty = long + " " + " ".join(f"grobnix zlartpest vurmhund {w}" for w in prose(8, 120).split())
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, [(1, long), (2, dirty)]), model).collect()}
    assert got[1] < 0.3 < got[2]


def test_edges(spark):
    d, labels = labelled(spark)
    model = toxicity.fit(clashing(d), clashing(labels))
    got = toxicity.score(clashing(docs(spark, edge_rows())), model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[2].score == by[3].score == by[4].score and by[2].n_windows == 0
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_without_labels(spark):
    d = docs(spark, [(0, "a"), (1, "b")])
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.classify(d, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(0, 1, 1), (1, None, None), (0, 1, 1)], LABELS)
    assert all(r.score == 1.0 for r in toxicity.classify(d, one).collect())


def test_held_out_labels_are_never_seen(spark):
    """Turning round the labels of the held-out fold changes no score."""
    d, labels = labelled(spark)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(toxicity.classify(d, labels)) == key(toxicity.classify(d, turned))


def test_held_out_rows_of_the_table(spark):
    """Rows that training never saw, against what calling nothing toxic would give."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas()
    m = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    hits = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert m.toxic.sum() > 80 and 2 * hits / (m.predicted.sum() + m.toxic.sum()) > 0.7


def test_windows_by_plain_compression(spark):
    """Counts of a text are those of compressing each word's window anew with both dictionaries."""
    d, labels = labelled(spark)
    model = toxicity.fit(d, labels)
    text = prose(3, 50) + " grobnix vurmhund " + prose(4, 20) + " unseen Grobnix"
    sizes = []
    for word in toxicity.TOKEN.findall(text.lower()):
        fresh = toxicity.Gains(model)
        window = f" {word} ".encode(toxicity.ENCODING)
        sizes.append(max(0, len(fresh.pair[0].compress(window)) - len(fresh.pair[1].compress(window))))
    want = [sum(g >= t for g in sizes) for t in toxicity.THRESHOLDS] + [len(sizes)]
    assert toxicity.Gains(model).counts(text).tolist() == want and want[0] >= 3


def test_switching_the_dictionary_off_changes_results(spark):
    d, labels = labelled(spark)
    model = toxicity.fit(d, labels)
    off = toxicity.Model(model.ordinary, model.ordinary, model.mean, model.scale, model.weight, model.prior)
    flagged = lambda m: toxicity.score(d, m).where("score >= 0.3").count()
    assert flagged(model) >= 70 and flagged(off) == 0


def test_only_near_copies_are_copies():
    """Texts that share a fifth of their triples are no copies, whatever hash is the least; changed words don't undo one."""
    passage = prose(1, 25)
    shared = [passage + " " + " ".join(f"{w}{i}" for w in prose(2 + i, 40).split()) for i in range(30)]
    copies = []
    for i in range(30):
        words = prose(99, 200).split()
        words[i * 5] = f"x{i}"
        copies.append(" ".join(words))
    got = toxicity.leaders([toxicity.outline(t)[0] for t in shared + copies])
    assert got == [*range(30), *[30] * 30]
