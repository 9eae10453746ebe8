import re

import pandas as pd

import corpus_pipeline
from lodestone.llm import decontam, pii, quality
from lodestone.llm.common import table, written
from tests.llm.tables import LABELS, ODD, clashing, docs, edge_rows, odd_names, prose
from tests.llm.test_decontam import plain_tiles
from tests.llm.test_mixing import plain_targets
from tests.llm.test_quality import plain
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_stages_against_brute_force(spark, sf):
    """Every stage on what its predecessor kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "redact_personal_data", "mix_sources"]
    first = table(spark, sf, "documents")
    now, columns = first, first.columns
    frames = [first.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf), name)
        frames.append(now.toPandas())
        assert name == names[-1] or now.columns == columns
    f = [dict(zip(x.doc_id, x.text)) for x in frames]

    rules = quality.fit(first, table(spark, sf, "labels"))
    assert all(not plain(f[0][i])[5] for i in f[1]) and {i for i, t in f[0].items() if not plain(t)[5]} - set(f[1]) == {i for i, t in f[0].items() if not plain(t)[5] and not kept_by(spark, rules, t)}
    groups = plain_components({i: plain_fingerprint(t) for i, t in f[1].items()})
    assert set(f[2]) == {i for i in f[1] if groups[i] == i}
    items = [decontam.tokens(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    assert set(f[2]) - set(f[3]) == {i for i, t in f[2].items() if covers(decontam.tokens(t), items)} and set(f[3]) < set(f[2])
    spans = {r.doc_id: r.spans for r in pii.find(written(docs(spark, list(f[3].items())), "left")).collect()}
    assert set(f[4]) == set(f[3]) and f[4] == {i: cut_out(t, spans[i]) for i, t in f[3].items()} and any(spans.values())
    assert all(not pii.base_spans(t) for t in f[4].values())
    mixed = frames[5]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes: dict = {}
    for i, t in f[4].items():
        s = frames[4].set_index("doc_id").source[i]
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    assert (mixed.taken == mixed["size"] * mixed.copies).all() and mixed.copies.between(1, 2).all()
    for s, g in mixed.groupby("source"):
        assert abs(g.taken.sum() - want[s]) <= max(size(t) for i, t in f[4].items())


def covers(words, items):
    """Plain tiling, of the items that share a run of words with the text."""
    runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    return any(plain_tiles(x, words) >= decontam.COVERAGE * len(x) for x in items if sum(tuple(x[k : k + 5]) in runs for k in range(len(x) - 4)) * 5 >= 0.5 * len(x))


def cut_out(text, spans):
    """The text with each span of the list replaced by its kind; one that begins in another is left out with it."""
    out, at = "", 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def kept_by(spark, rules, text):
    return quality.keep_good(docs(spark, [(1, text)]), rules).count() == 1


def test_run_gives_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "taken", "copies"} <= set(got.columns) and got.count() > 50


def test_edges(spark, tmp_path):
    for rows in ([], edge_rows()):
        d = clashing(docs(spark, rows))
        home = str(tmp_path / f"t{len(rows)}")
        d.write.parquet(f"{home}/documents.parquet")
        spark.createDataFrame([], LABELS).write.parquet(f"{home}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
        got = corpus_pipeline.run(spark, home)
        assert got.columns[: len(d.columns)] == d.columns
        # null, blank and short texts fail the base rules; of equal texts the smallest id stays; without an id or not, distinct texts all come this far
        stages = dict(corpus_pipeline.STAGES)
        good = written(stages["quality_rules"](spark, d, home), "good")
        assert sorted(str(r.doc_id) for r in good.collect()) == (sorted(map(str, [1, None, 5, 5, 6, 7, 8])) if rows else [])
        assert sorted(str(r.doc_id) for r in stages["near_dedup"](spark, good, home).collect()) == (["1", "5", "6", "8", "None"] if rows else [])
        assert {str(r.doc_id) for r in got.collect()} <= {"1", "5", "6", "8", "None"} and (got.count() > 0) == bool(rows)


def test_near_dedup_keeps_distinct_texts(spark, sf):
    """Null and shared ids are no reason to drop a text."""
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(3)), (5, prose(4)), (5, prose(5)), (6, prose(6)), (6, prose(6))]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs(spark, rows), sf).collect()
    assert sorted(r.text for r in got) == sorted(prose(i) for i in range(1, 7))


def test_any_column_names(spark, sf):
    """Columns keep their names and values through all stages, and what comes out can be written."""
    rows = [(i, prose(i, 80)) for i in range(30)] + [(40, prose(1, 80)), (41, "mail a.b@c.org " + prose(41, 60))] + [(r[0], r[1]) for r in edge_rows() if r[0] != 6]
    now = written(odd_names(docs(spark, rows)), "odd")
    columns = now.columns
    values = list(range(len(ODD)))
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf), name)
        assert now.columns[: len(columns)] == columns and now.count() > 0
        assert {tuple(r)[5:20] for r in now.collect()} == {tuple(values)}
    assert now.columns[len(columns) :] == ["source_size", "target", "copies"]
