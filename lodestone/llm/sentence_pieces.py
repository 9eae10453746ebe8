"""SentencePiece encoding and decoding, by vectorised merge rounds.

A text is cut where no piece of the model can reach across: before a mark of white space that follows anything
else, and between two characters that stand beside each other in no piece. What lies between is encoded on its own,
once however often it occurs. All new ones of a batch are encoded together, as one flat array of symbols with the
number of the word that each stands in: every round looks up the ranks of neighbouring symbols, takes the least of
each word by a segmented minimum, merges its pairs from the left at once, and moves words without a pair out, until
none is left. Where a merge could bring about a pair that comes before another pair of the same rank, only the
leftmost one is merged, so that rounds do what one merge after the other would. Words of over LONG symbols that can't
be cut (a run of letters without a blank) would take a round for nearly each symbol; a queue of pairs merges them.

Characters that are no piece become the pieces of their UTF-8 bytes. Decoding gathers the bytes of all pieces of a
batch at once; ids that don't come from encoding (broken characters, control ids) are decoded one by one.

Models: BPE with byte fallback and without normalisation; others raise ValueError.

Defined results: a null text is an empty one; empty texts have no ids; blanks, line ends and controls are encoded
like any other character; repeated rows are encoded each; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow

# Fixed values of the model format: the mark of white space, types of pieces, and the surface of an unknown one.
BLANK, NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = "▁", 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT, BROKEN = " ⁇ ", "�"

#: Words that a task remembers at most, characters that are cut into words in one go, symbols of a word up to which it's merged by rounds.
CACHED, PART, LONG = 1 << 18, 1 << 20, 256
#: A symbol is the id of a piece, or RAW and the code point of a character that is no piece; two of them make a key.
BITS = 21
RAW = 1 << 20
NONE = np.iinfo(np.int32).max
WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


@dataclass(frozen=True)
class Model:
    """What encoding and decoding need, as arrays that travel to the tasks."""

    chars: np.ndarray  # code points that are pieces, ordered, and their ids
    char_ids: np.ndarray
    pairs: np.ndarray  # keys of pairs that are pieces, ordered; the piece that they make, and its rank
    made: np.ndarray
    ranks: np.ndarray
    late: np.ndarray  # by id: whether a pair with this piece may come before another pair that makes it
    beside: np.ndarray  # keys of code points that stand beside each other in a piece, ordered
    byte_ids: np.ndarray
    kinds: np.ndarray
    surfaces: tuple[str, ...]
    prefix: bool  # whether a text begins with a mark of white space


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def load(path: str) -> Model:
    """The model in a file that the driver can read."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    texts, scores, kinds = [], [], []
    trainer, normaliser = {}, {}
    for number, value in parts:
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    kinds = np.array(kinds, np.int32)
    # fields 3 and 35 of the trainer: kind of model, byte fallback; 2, 3, 4 and 5 of the normaliser: its table, prefix, removal and escape of blanks
    if trainer.get(3, 1) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or np.isin(kinds, (USER, UNUSED)).any():
        raise ValueError(f"{path}: not a BPE model with byte fallback and without normalisation")
    return _model(texts, scores, kinds, bool(normaliser.get(3, 1)))


def _model(texts: list[str], scores: list[float], kinds: np.ndarray, prefix: bool) -> Model:
    ids = {t: i for i, t in enumerate(texts) if kinds[i] == NORMAL}
    order = {s: k for k, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
    rank = np.full(len(texts), NONE, np.int32)
    for i in ids.values():
        rank[i] = order[scores[i]]
    shared = np.bincount(rank[rank < NONE])
    late = np.zeros(len(texts), bool)
    late[list(ids.values())] = shared[rank[list(ids.values())]] > 1
    pairs, beside = {}, set()
    for t, i in ids.items():
        beside.update((ord(a) << BITS) | ord(b) for a, b in zip(t, t[1:]))
        for k in range(1, len(t)):
            a, b = ids.get(t[:k]), ids.get(t[k:])
            if a is not None and b is not None:
                pairs[(a << BITS) | b] = i
                late[a] |= rank[i] <= rank[a]
                late[b] |= rank[i] <= rank[b]
    keys = np.array(sorted(pairs), np.int64)
    made = np.array([pairs[k] for k in keys.tolist()], np.int64)
    chars = np.array(sorted(ord(t) for t in ids if len(t) == 1), np.int64)
    byte_ids = np.full(256, -1, np.int64)
    for i in np.flatnonzero(kinds == BYTE).tolist():
        byte_ids[int(texts[i][3:5], 16)] = i
    surfaces = tuple("" if k == CONTROL else UNKNOWN_TEXT if k == UNKNOWN else t.replace(BLANK, " ") for t, k in zip(texts, kinds.tolist(), strict=True))
    char_ids = np.array([ids[chr(c)] for c in chars.tolist()], np.int64)
    return Model(chars, char_ids, keys, made, rank[made], late, np.array(sorted(beside), np.int64), byte_ids, kinds, surfaces, prefix)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in an ordered table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _starts(of: np.ndarray) -> np.ndarray:
    """Where a new value begins in an array of runs."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]])


def _queued(symbols: list[int], model: Model) -> list[int]:
    """One word's symbols merged pair by pair: least rank first, then leftmost."""
    found, hit = _find(model.pairs, (np.array(symbols[:-1], np.int64) << BITS) | np.array(symbols[1:], np.int64))
    queue = [(r, i, s, t, m) for i, (ok, r, m, s, t) in enumerate(zip(hit.tolist(), model.ranks[found].tolist(), model.made[found].tolist(), symbols, symbols[1:])) if ok]
    heapq.heapify(queue)
    before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    known: dict[int, tuple[int, int] | None] = {}

    def put(i: int, j: int) -> None:
        key = (symbols[i] << BITS) | symbols[j]
        if key not in known:
            at, ok = _find(model.pairs, np.array([key], np.int64))
            known[key] = (int(model.ranks[at[0]]), int(model.made[at[0]])) if ok[0] else None
        if known[key]:
            heapq.heappush(queue, (known[key][0], i, symbols[i], symbols[j], known[key][1]))

    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of them has been merged since
        symbols[i], symbols[j], after[i] = made, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            put(i, after[i])
        if before[i] >= 0:
            put(before[i], i)
    return [s for s in symbols if s >= 0]


def merge_words(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and where each word's begin (with the end)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    at, known = _find(model.chars, points)
    symbol = np.where(known, model.char_ids[at], RAW + points)
    joined = (word[1:] == word[:-1]) & _find(model.beside, (points[:-1] << BITS) | points[1:])[1]
    span = np.cumsum(np.r_[True, ~joined]) - 1
    first = _starts(span)
    owner, size = word[first], np.diff(np.r_[first, len(span)])
    ended = []  # (span, symbols) of what has no pair left
    for k in np.flatnonzero(size > LONG).tolist():
        done = np.array(_queued(symbol[first[k] : first[k] + size[k]].tolist(), model), np.int64)
        ended.append((np.full(len(done), k), done))
    rest = np.repeat(size <= LONG, size)
    span, symbol = span[rest], symbol[rest]
    while len(span):
        at, pair = _find(model.pairs, (symbol[:-1] << BITS) | symbol[1:])
        rank = np.r_[np.where(pair & (span[1:] == span[:-1]), model.ranks[at], NONE), NONE]
        first = _starts(span)
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(span)]))
        over = least == NONE
        ended.append((span[over], symbol[over]))
        hits = np.flatnonzero((rank == least) & ~over)
        if not len(hits):
            break
        made = model.made[at[hits]]
        # pairs that overlap form runs, of which every other one is merged
        run = np.r_[True, np.diff(hits) != 1]
        place = np.arange(len(hits))
        merged = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
        of = span[hits]
        merged &= ~model.late[made] | np.r_[True, of[1:] != of[:-1]]
        symbol[hits[merged]] = made[merged]
        left = ~over
        left[hits[merged] + 1] = False
        span, symbol = span[left], symbol[left]
    span, symbol = (np.concatenate([e[k] for e in ended]) for k in (0, 1))
    order = np.argsort(span, kind="stable")
    return _with_bytes(symbol[order], owner[span[order]], len(words), model)


def _with_bytes(symbol: np.ndarray, word: np.ndarray, n: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their words to ids and words' offsets; a character that is no piece becomes its bytes."""
    raw = symbol >= RAW
    count = np.ones(len(symbol), np.int64)
    point = symbol[raw] - RAW
    count[raw] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
    ids = np.repeat(symbol, count)
    ids[np.repeat(raw, count)] = model.byte_ids[np.frombuffer("".join(map(chr, point.tolist())).encode(), np.uint8)]
    return ids.astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, count, n).astype(np.int64))]


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every slice, one slice after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Codec:
    """Encodes and decodes texts; keeps the words that it has met, up to CACHED."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()
        surfaces = [bytes([int(np.flatnonzero(model.byte_ids == i)[0])]) if model.kinds[i] == BYTE else s.encode() for i, s in enumerate(model.surfaces)]
        self.bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        self.sizes = np.array([len(s) for s in surfaces])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's words, new ones included; cut part by part, each ending before a blank."""
        text = (BLANK if self.model.prefix and text else "") + text.replace(" ", BLANK)
        words, numbers, at = self.words, [], 0
        while at < len(text):
            end = at + PART
            while end < len(text) and not (text[end] == BLANK and text[end - 1] != BLANK):
                end = text.find(BLANK, end + 1)
                end = len(text) if end < 0 else end
            part = text[at:end]
            if part[0] != BLANK:  # only without the prefix
                first = re.match(f"[^{BLANK}]+", part)[0]
                numbers.append(np.array([words.setdefault(first, len(words))]))
            numbers.append(np.array([words.setdefault(w, len(words)) for w in WORD.findall(part)], np.int64))
            at = end
        return np.concatenate(numbers) if numbers else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > CACHED:
            self._forget()
        old = len(self.words)
        numbers = [self._numbered(t) for t in texts]
        if len(self.words) > old:
            ids, offsets = merge_words(list(islice(self.words, old, None)), self.model)
            self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        sizes = np.diff(self.offsets)
        return [self.ids[_gather(self.offsets[n], sizes[n])] for n in numbers]

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """The text of each list of ids."""
        return [self._decoded(np.asarray(x, np.int64)) for x in lists]

    def _decoded(self, ids: np.ndarray) -> str:
        kinds = self.model.kinds[ids]
        if (kinds == CONTROL).any():
            return self._one_by_one(ids)
        parts = [self.bytes[_gather(self.starts[ids[k : k + PART]], self.sizes[ids[k : k + PART]])].tobytes() for k in range(0, len(ids), PART)]
        try:
            text = b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._one_by_one(ids)
        return text[1:] if self._drops_blank(ids) else text

    def _drops_blank(self, ids: np.ndarray) -> bool:
        """Whether the first piece, control ids aside, begins with the blank that stands for the start of the text."""
        said = ids[self.model.kinds[ids] != CONTROL][:1]
        return bool(self.model.prefix and len(said) and self.model.kinds[said[0]] == NORMAL and self.model.surfaces[said[0]].startswith(" "))

    def _one_by_one(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append(BROKEN)
                at += n
            run.clear()

        for i in ids.tolist():
            if self.model.kinds[i] == BYTE:
                run.append(int(self.bytes[self.starts[i]]))
            else:
                flush()
                out.append(self.model.surfaces[i])
        flush()
        text = "".join(out)
        return text[1:] if self._drops_blank(ids) else text


def _codecs(df: DataFrame, path: str):
    """A function that gives a task its codec; the model is read once by the driver and sent as a broadcast of a few megabytes."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    return lambda: Codec(shared.value)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array) of every row, by the model at path."""
    codec_of = _codecs(documents, path)

    def run(batches):
        codec = codec_of()
        for b in batches:
            lists = codec.encode([t or "" for t in b.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""
    codec_of = _codecs(encoded, path)

    def run(batches):
        codec = codec_of()
        for b in batches:
            texts = [None if x is None else codec.decode([x])[0] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of what they decode to, for every row. Map only: ids and texts stay in the task."""
    codec_of = _codecs(documents, path)

    def run(batches):
        codec = codec_of()
        names = [str(i) for i in range(len(codec.model.kinds))]
        for b in batches:
            lists = codec.encode([t or "" for t in b.column(1).to_pylist()])
            n = pa.array([len(x) for x in lists], pa.int64())
            said = [hashlib.sha256(",".join([names[i] for i in x.tolist()]).encode()).hexdigest() for x in lists]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(lists)]
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(said, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
