"""Encoding and decoding against the library itself."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import sentence_pieces as M
from tests.llm.tables import clashing, docs, edge_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return M.Codec(M.load(PATH))


PARTS = ["the", "in", "g", "▁", " ", "  ", " " * 15, " " * 17, " " * 40, "=", "====", "aa", "é", "日本", "語", "한국", "\n", "\t", "\x00", "😀", "<s>", "</s>", "<0x0A>", "tion", "2024", "́", "ß", "Ω", "न"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60))
def test_any_text(library, codec, text):
    ids = codec.encode([text])[0].tolist()
    assert ids == library.encode(text) and codec.decode([ids]) == [library.decode(ids)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 260), max_size=12))
def test_any_ids(library, codec, ids):
    assert codec.decode([ids]) == [library.decode(ids)]


@pytest.mark.parametrize("long", [1, 3, 1000])
def test_rounds_and_queue_agree(library, monkeypatch, long):
    """Whether words are merged by rounds or by the queue, in batches and in parts of any size."""
    monkeypatch.setattr(M, "LONG", long)
    monkeypatch.setattr(M, "PART", 7)
    r = random.Random(long)
    texts = ["".join(r.choice("abcdest= ▁") for _ in range(r.randint(0, 200))) for _ in range(300)]
    codec = M.Codec(M.load(PATH))
    assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts)
    assert codec.decode(codec.encode(texts)) == library.decode(library.encode(texts))


def test_long_runs_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(M, "CACHED", 3)
    codec = M.Codec(M.load(PATH))
    for text in (" " * 40_001 + "x", "ACGT" * 10_000, "日本語" * 10_000, "=" * 30_001, "one two three four", "one five"):
        assert codec.encode([text, "", text])[2].tolist() == library.encode(text)


def test_pieces_that_come_before_their_parts():
    """A pair of a merged piece may come before a pair of the same rank further right: XYX before XY + XY."""
    texts = ["<unk>", *[f"<0x{k:02X}>" for k in range(256)], "x", "y", "▁", "xyx", "xy"]
    kinds = np.array([M.UNKNOWN, *[M.BYTE] * 256, *[M.NORMAL] * 5], np.int32)
    model = M._model(texts, [0.0] * 257 + [-9.0, -9.0, -9.0, -1.0, -2.0], kinds, True)
    ids = M.Codec(model).encode(["xyxy"])[0].tolist()
    assert [texts[i] for i in ids] == ["▁", "xyx", "y"]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x04\x18\x01\x98\x02")
    with pytest.raises((ValueError, IndexError)):
        M.load(str(tmp_path / "m"))


def test_edges(spark, library):
    rows = edge_rows()
    got = M.digests(clashing(docs(spark, rows)), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is None, i or 0, len(library.encode(t or ""))) for i, t, *_ in rows)
    assert M.digests(docs(spark, []), PATH).count() == 0
    encoded = M.encode(docs(spark, rows), PATH)
    want = {(i, t or "") for i, t, *_ in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {(i, tuple(library.encode(t))) for i, t in want}
    assert {(r.doc_id, r.text) for r in M.decode(encoded, PATH).collect()} == want
