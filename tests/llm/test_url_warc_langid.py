import base64
import gzip
import hashlib
import io
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.llm import langid, url_filter, warc
from lodestone.llm.common import fresh_path, table
from tests.llm.tables import PAGES, clashing, docs, edge_rows, prose

# --- url filter -------------------------------------------------------------------------------------


def plain_verdicts(rows):
    """Rules by reading, ranks by plain power iteration over dictionaries."""
    parts = {}
    for i, (_, url, _) in enumerate(rows):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        best = max((r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        parts[i] = (host, path, best)
    import re

    links = {}
    for i, (_, _, h) in enumerate(rows):
        for to in re.findall(url_filter.LINK, h or ""):
            a, b = parts[i][0], to.lower()
            if a and a != b:
                links[a, b] = links.get((a, b), 0) + 1
    scores = []
    for kind, edges in (("allow", links), ("block", {(b, a): n for (a, b), n in links.items()})):
        seed, out = {}, {}
        for host in {p[0] for p in parts.values() if p[2] and p[0]}:
            ruled = [p[2][0] for p in parts.values() if p[0] == host and p[2]]
            if kind in ruled:
                seed[host] = 0.15 * ruled.count(kind) / len(ruled)
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        rank = dict(seed)
        for _ in range(300):
            new = dict(seed)
            for (a, b), n in edges.items():
                if a in rank:
                    new[b] = new.get(b, 0) + 0.85 * rank[a] * n / out[a]
            rank = new
        scores.append(rank)
    return [(parts[i][0], parts[i][1], parts[i][2] and parts[i][2][1] + parts[i][2][2], parts[i][2][0] if parts[i][2] else "block" if scores[1].get(parts[i][0], 0) - scores[0].get(parts[i][0], 0) > url_filter.MARGIN else "allow") for i in range(len(rows))]


def linked_pages():
    r = random.Random(2)
    hosts = ["good.org", "a.example.org", "b.com", "c.com", "farm.net", "d.net", "e.net", "X.Net"]
    rows = []
    for i in range(120):
        to = "".join(f'<a href="{r.choice(["http://", "https://", "//"])}{r.choice(hosts)}/p{k}">x</a>' for k in range(r.randint(0, 4)))
        rows.append((i, f"http://{r.choice(hosts)}{r.choice(['', '/', '/fr/1', '/de/2', '/es/3', '/en/14', '/en/2?x#y'])}", to + '<a href="/local">l</a>'))
    rows += [(300 + k, "http://spam.net/en/2", '<a href="https://blocked.com/de/1">x</a>') for k in range(9)] + [(320 + k, "https://blocked.com/de/1", None) for k in range(4)]
    return rows + [(200, None, None), (201, "no scheme", "<a href=http://b.com>"), (202, "ftp://FARM.net?q", ""), (203, "http://", ""), (None, "http://good.org/", None), (1, "http://b.com/de/1", "")]


def test_url_rules_and_graph(spark):
    rows = linked_pages()
    got = [tuple(r)[1:] for r in url_filter.filter_urls(clashing(spark.createDataFrame(rows, PAGES))).collect()]
    want = plain_verdicts(rows)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {v[3] for v in want if v[2] is None} == {"allow", "block"}


def test_url_sql(spark):
    rows = [r for r in linked_pages() if r[0] is not None]
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", frame.astype(object).where(frame.notna(), None).values.tolist())
    cur = c.execute(url_filter.oracle())
    names = [x[0] for x in cur.description]
    want = [tuple(r[names.index(n)] for n in ("page_id", "host", "path", "rule", "verdict")) for r in cur.fetchall()]
    got = [tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_distrust_reaches_far_hosts(spark):
    """A chain of fifteen hosts that leads to a blocked one, and one that leads nowhere."""
    rows = [(i, f"http://h{i}.net/x", f'<a href="http://h{i + 1}.net/">n</a>') for i in range(15)] + [(15, "http://h15.net/x", '<a href="//bad.com/de/">n</a>'), (16, "http://bad.com/de/1", None)]
    rows += [(100 + i, f"http://g{i}.net/x", f'<a href="http://g{i + 1}.net/">n</a>') for i in range(15)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == "block" for i in range(17)) and all(got[100 + i] == "allow" for i in range(15))


def test_url_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


# --- warc -------------------------------------------------------------------------------------------


def warc_rows():
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\n"
    rows = [(i, f"http://h{i % 5}.example.com/{'a' if i % 2 else 'b'}", prose(i % 7, 30)) for i in range(60)]
    return rows + [(100, "http://z.com/é x\r\ny", trap), (101, None, trap), (102, "u", None), (103, "u", ""), (104, "http://h0.example.com/b", "é𝒳\n\r"), (None, "n", prose(1, 30)), (None, "n", "alone"), (105, "w", prose(5, 60_000))]


def test_warc_round_trip(spark):
    rows = warc_rows()
    got = warc.archive_and_index(clashing(spark.createDataFrame(rows, PAGES))).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max([x for x in (last.get(h or ""), i) if x is not None], default=None)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        keeper = last[h or ""]
        again = keeper is not None and i != keeper
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    order = [(r.url_key, r.captured) for r in got]
    assert order == sorted(order)


def test_warc_archives_hold_the_payloads(spark, monkeypatch):
    """By a small bound: files are bounded in bytes, every record is a member that its offset leads to, record ids are unique."""
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(warc, "MEMBER_BYTES", 100_000)
    path = fresh_path(spark, "test-warc")
    rows = warc_rows() + [(104, "http://h0.example.com/b", "é𝒳\n\r")] * 2 + [(106, "w", prose(77, 60_000))]
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path)
    found, ids, sizes = {}, [], []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        sizes.append(len(r.content))
        whole = gzip.decompress(r.content)
        for place, head, block in warc.parse(r.content):
            ids.append(head["warc-record-id"])
            assert gzip.GzipFile(fileobj=io.BytesIO(r.content[place:])).read(9) == b"WARC/1.1\r" and block in whole
            if head["warc-type"] == "response":
                found[head.get("x-page-id")] = block.partition(b"\r\n\r\n")[2].decode()
    assert found["105"] == prose(5, 60_000) and found["106"] == prose(77, 60_000) and found["104"] == "é𝒳\n\r" and found["103"] == ""
    assert len(ids) == len(set(ids)) == len(rows) and len(sizes) > 4
    assert sorted(sizes)[:-2] == [n for n in sorted(sizes)[:-2] if n < 6000]  # but for the long records


def test_warc_damage_is_found():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: d\r\nX-Page-ID: 1\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    for data in (warc.member(record), warc.member(record + b"\r\n\r\n")[:-9], warc.member(record + b"\r\n\r\nmore"), warc.member(b"x")):
        with pytest.raises(ValueError):
            list(warc.parse(data))
    [(place, head, block)] = warc.parse(warc.member(record + b"\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.capture("r", place, head, block)


def test_loser_tree():
    r = random.Random(4)
    for k in range(0, 12):
        runs = [sorted(r.randint(0, 20) for _ in range(r.choice((0, 1, 5, 30)))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_warc_ranges_and_empty(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 1500)
    rows = [(i, "http://one.example.com/", prose(i, 5)) for i in range(80)]
    got = [(r.url_key, r.captured, r.page_id) for r in warc.archive_and_index(spark.createDataFrame(rows, PAGES).repartition(3)).collect()]
    assert got == sorted(got) and len(got) == 80
    assert warc.archive_and_index(spark.createDataFrame([], PAGES)).count() == 0


# --- language identification ------------------------------------------------------------------------

VOICES = {"en": "the and of to in that was with for on are this".split(), "fr": "les des une est dans pour qui sur pas avec vous être".split(), "de": "der die und nicht ist ein mit für auf dem sich über".split()}


def speech(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(VOICES[lang]) for _ in range(n))


def test_langid_learns_and_mixes(spark):
    rows = [(i, speech(lang, i), lang) for i in range(120) for lang in [list(VOICES)[i % 3]]]
    mixed = [(1000, speech("fr", 1, 150) + " " + speech("en", 2, 60), None), (1001, "12 34 !?", None), (1002, speech("DE".lower(), 5, 4), None)]
    got = {r.doc_id: r for r in langid.classify(docs(spark, rows + mixed)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[1000].lang_pred == "fr" and 0.55 < got[1000].score < 0.9
    assert got[1001].lang_pred == "und" and got[1001].score == 0 and got[1002].lang_pred == "de"


def test_langid_edges(spark):
    rows = [(i, speech(lang, i), lang) for i in range(60) for lang in [list(VOICES)[i % 3]]]
    model = langid.fit(clashing(docs(spark, rows)))
    got = langid.predict(clashing(docs(spark, edge_rows())), model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got}[2] == "und"
    none = langid.classify(docs(spark, [(1, "text", None)])).collect()
    assert none[0].lang_pred == "und" and langid.classify(docs(spark, [])).count() == 0


def test_langid_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.classify(table(spark, sf, "documents")).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.98


def test_rounds_on_long_mixed_text():
    model = langid.fit_rows([(lang, speech(lang, k, 400)) for lang in VOICES for k in range(5)])
    letters = langid.letters_table()
    text = " ".join(speech(lang, k, 500) for k in range(20) for lang in ("en", "de"))
    lang, share = langid.identify(text * 20, model, letters)
    assert lang in ("en", "de") and 0.4 < share < 0.6


def plain_shares(ll, chosen):
    """Expectation-maximisation as it is told, over lists."""
    p = [1 / len(chosen)] * len(chosen)
    for _ in range(langid.ROUNDS):
        total = [0.0] * len(chosen)
        for row in ll:
            like = [p[k] * np.exp(row[c]) for k, c in enumerate(chosen)]
            total = [t + x / sum(like) for t, x in zip(total, like)]
        p = [t / len(ll) for t in total]
    return p, sum(float(np.log(sum(p[k] * np.exp(row[c]) for k, c in enumerate(chosen)))) for row in ll)


def test_mixture_by_brute_force():
    """The set grows by the language that gains most, while it gains more than the penalty."""
    r = np.random.default_rng(1)
    for _ in range(40):
        n, k = int(r.integers(1, 30)), int(r.integers(1, 5))
        ll = r.normal(0, 12, (n, k))
        tempered = langid.TEMPER * (ll - ll.max(1, keepdims=True))
        chosen = [int(tempered.sum(0).argmax())]
        shares, best = [1.0], float(tempered.sum(0).max())
        while len(chosen) < k:
            p, value, other = max(((*plain_shares(tempered, [*chosen, o]), o) for o in range(k) if o not in chosen), key=lambda x: x[1])
            if value - best <= 3 * np.log(n + 1) + 2:
                break
            shares, best = p, value
            chosen.append(other)
        want = np.zeros(k)
        want[chosen] = shares
        assert np.allclose(langid.mixture(ll), want, atol=1e-6)


def test_only_letters_are_letters():
    model, letters = langid.fit_rows([(lang, speech(lang, 1, 400)) for lang in VOICES]), langid.letters_table()
    for text in ("\U000e0100\U000e0101", "\U000f0000 \U00100001", "1 2 \u2460", "\U0001f600"):
        assert langid.identify(text, model, letters) == ("und", 0.0)
    assert langid.identify("\U00020000", model, letters)[0] != "und"


def test_seams_lose_nothing(monkeypatch):
    model, letters = langid.fit_rows([(lang, speech(lang, 1, 400)) for lang in VOICES]), langid.letters_table()
    text = speech("en", 3, 300) + " 1, 2;  " + speech("fr", 4, 200)
    whole, _ = langid.window_likelihoods(text, model, letters)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "PIECE", size)
        assert np.allclose(langid.window_likelihoods(text, model, letters)[0], whole, atol=1e-3)
