"""Personal data: fixed base patterns, and candidates that boosted trees judge.

The base patterns always hold. Besides them, generous generators propose overlapping spans (spelled-out
addresses, loosely grouped numbers, numbers without a country code, IPv6 groups); gradient-boosted trees
over the span's format and its context give each a probability; of those over their kind's calibrated
threshold the most probable ones that overlap nothing are taken.

No table labels personal data, so the trees learn from sentences made here from a fixed seed: real formats
and look-alikes (dates, amounts, versions, order numbers) in contexts that fit either, alone and side by side.
Thresholds are calibrated on text of another make: prose of four languages with formats, cues and look-alikes of its own.

Defined results: null and empty texts have no spans; repeated rows are searched each on its own; texts are
searched whole, in time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, plain_names

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(t: str) -> list[Span]:
    """Found from the @ outwards: what a scan for local part, @ and domain finds, without trying every start."""
    out, last = [], 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(t, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    return out


def ips(t: str) -> list[Span]:
    """Of a run of dotted numbers, four at a time."""
    out = []
    for m in DOTTED.finditer(t):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def cards(t: str) -> list[Span]:
    out = []
    for m in CARD.finditer(t):
        if 14 <= m.end() - m.start() and len(m[0]) < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def phones(t: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(t: str) -> list[Span]:
    out = emails(t) if "@" in t else []
    if DIGIT.search(t):
        out += ips(t) + cards(t)
        if "+" in t:
            out += phones(t)
    return ordered(out)


def written_as(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- candidates -------------------------------------------------------------------------------------

SPELLED_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]|\x20at\x20|\x20?@\x20?", re.I)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+", re.I)
#: Without one of these, and without an @, nothing can be an address.
AT_SIGN = re.compile(r"[\[({]\x20?at\x20?[\])}]|dot", re.I)
RUN = re.compile(r"[0-9][0-9()\x20./-]{5,}")
GROUP = re.compile(r"[0-9]+")
#: Groups of one number stand at most so many separators apart; it has at most so many digits.
GAP, DIGITS = 4, 19
COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
SHORTENED = re.compile(r"(?<![\w:])[0-9A-Fa-f:]{3,39}(?![\w:])")
HEX_GROUP = re.compile(r"[0-9A-Fa-f]{1,4}")
BRACKETED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}")


def numbers(t: str) -> list[Span]:
    """Every span of a run of numbers that starts and ends with a group of digits and has a phone's or a card's
    count of them; what stands beside an item in the run thus hides nothing. At most DIGITS ends to a start."""
    out: list[Span] = []
    for m in RUN.finditer(t):
        groups = [g.span() for g in GROUP.finditer(t, *m.span())]
        for k, (start, _) in enumerate(groups):
            if k and coded:  # what follows a country code isn't a number without it
                coded = False
                continue
            a = start
            if t[max(0, a - 1) : a] == "(":
                a -= 1
            coded = t[max(0, a - 1) : a] == "+"
            a -= coded
            digits, end = 0, start
            for n in range(k, len(groups)):
                low, b = groups[n]
                digits += b - low
                if digits > DIGITS or low - end > GAP:
                    break
                end = b
                if 7 <= digits <= 15:
                    out.append(("phone", a, b))
                if digits >= 13:
                    out.append(("card", start, b))
    return out


def shortened(t: str) -> list[Span]:
    """IPv6 with its zeros left out: one '::', at most seven groups."""
    out: list[Span] = []
    for m in SHORTENED.finditer(t):
        sides = m[0].split("::")
        groups = [g for side in sides if side for g in side.split(":")]
        if len(sides) == 2 and 1 <= len(groups) <= 7 and all(map(HEX_GROUP.fullmatch, groups)):
            out.append(("ip", *m.span()))
    return out


def candidates(t: str) -> list[Span]:
    out: list[Span] = []
    if "@" in t or AT_SIGN.search(t):
        last = 0
        for m in SPELLED_AT.finditer(t):
            a = m.start()
            while a > last and t[a - 1] in LOCAL:
                a -= 1
            last = m.end()
            if a < m.start() and (d := SPELLED_DOMAIN.match(t, m.end() + (t[m.end() : m.end() + 1] == " "))):
                out.append(("email", a, d.end()))
    if DIGIT.search(t):
        out += numbers(t)
        out += [("ip", *m.span()) for m in BRACKETED.finditer(t)]
        if t.count(":") > 2:
            out += [("ip", *m.span()) for m in COLONS.finditer(t)]
    if "::" in t:
        out += shortened(t)
    return out


CUES = {
    "email": re.compile(r"e-?mail|contact|write to|reach|mailto|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|ipv6|host|server|address|subnet|ping|peer", re.I),
    "card": re.compile(r"card|visa|master|amex|payment|charged|credit|debit|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|whats|text me|\bring|handy|number|numéro|nummer|número|tél|teléfono|appele|llam|anruf|ruf ", re.I),
}
AGAINST = re.compile(r"order|invoice|ref|isbn|version|\bv\.?$|\bno\.?|\bid\b|sku|serial|pages?|[$€£]|total|price|batch|code|ticket|date|since|from|between|figure|table|section|grid", re.I)
DATE = re.compile(r"^(?:(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)?\d\d)\b")
GROUPED = re.compile(r"^\(?\d{3}\)?[\x20.-]\d{3}[\x20.-]\d{4}$")
FOURS = re.compile(r"^\d{4}([\x20-])\d{4}\1\d{4}\1\d{1,7}$")
#: What stands between a span and the next number of its run.
BEFORE = re.compile(r"[0-9]([()\x20./-]{1,4})$")
AFTER = re.compile(r"([()\x20./-]{1,4})[0-9]")
BETWEEN = re.compile(r"(?<=[0-9])[^0-9]+(?=[0-9])")
TLD = re.compile(r"(?:\.|dot\W*)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$", re.I)


def features(t: str, span: Span) -> list[float]:
    kind, a, b = span
    s, left, right = t[a:b], t[max(0, a - 32) : a], t[b : b + 16]
    digits = [c for c in s if c.isdigit()]
    groups = re.findall(r"\d+", s)
    line = "".join(digits)
    inner = BETWEEN.findall(s)
    # parts of an item go on with the separator that they have, neighbours with another one
    before, after = BEFORE.search(left), AFTER.match(right)
    return [
        float(KINDS.index(kind)),
        len(s),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        len(set(digits)) / max(1, len(digits)),
        s.startswith("+"),
        "(" in s and ")" in s,
        s.count("("),
        s.count("."),
        s.count("-"),
        s.count("/"),
        s.count(" "),
        luhn(line) if digits else 0,
        bool(CUES[kind].search(left)),
        any(bool(c.search(left)) for k, c in CUES.items() if k != kind),
        bool(AGAINST.search(left)),
        bool(CUES[kind].search(right)),
        bool(DATE.match(s)),
        bool(GROUPED.match(s)),
        bool(FOURS.match(s)),
        bool(TLD.search(s)),
        "dot" in s.lower() and bool(re.search(r"\W?at\W|@", s, re.I)),
        left[-1:].isalnum() or left[-1:] in ("#", "$", "=", '"', "."),
        right[:1].isalnum() or right[:1] in ("%", "=", '"'),
        line[:1] in ("4", "5", "3", "6"),
        s.count(":"),
        bool(re.search(r"[a-f]", s, re.I)),
        len(groups[0]) if groups else 0,
        len(groups[1]) if len(groups) > 1 else 0,
        len(groups[-2]) if len(groups) > 1 else 0,
        len(set(inner)),
        max(map(len, inner), default=0),
        0 if not before else 2 if before[1] in inner else 1,
        0 if not after else 2 if after[1] in inner else 1,
        len(before[1]) if before else 0,
        len(after[1]) if after else 0,
        bool(DATE.search(s[-10:])) or bool(DATE.search(s[-8:])),
        s.count("::"),
        len(HEX_GROUP.findall(s)),
    ]


# --- boosted trees ----------------------------------------------------------------------------------

DEPTH, TREES, RATE, LEAST, BINS = 3, 60, 0.2, 8, 32


@dataclass
class Forest:
    trees: list[tuple]
    start: float
    thresholds: dict[str, float]

    def probability(self, x: list[float]) -> float:
        z = self.start
        for node in self.trees:
            while len(node) == 4:
                node = node[2] if x[node[0]] < node[1] else node[3]
            z += node[0]
        return 1 / (1 + np.exp(-z))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, z: np.ndarray) -> tuple:
    """binned: feature x row. The leaves' values are added to z."""
    gr, hr = g[rows], h[rows]
    gs, hs = gr.sum(), hr.sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST:
        for k, cut in enumerate(cuts):
            if len(cut):
                v = binned[k, rows]
                n = np.cumsum(np.bincount(v, minlength=len(cut) + 1))[:-1]
                gl, hl = np.cumsum(np.bincount(v, gr, len(cut) + 1))[:-1], np.cumsum(np.bincount(v, hr, len(cut) + 1))[:-1]
                gain = np.where((n >= LEAST) & (n <= len(rows) - LEAST), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, at)
    if best[1] is None:
        z[rows] += RATE * gs / (hs + 1.0)
        return (RATE * gs / (hs + 1.0),)
    _, k, at = best
    low = binned[k, rows] <= at
    return k, float(cuts[k][at]), _tree(binned, cuts, g, h, rows[low], depth - 1, z), _tree(binned, cuts, g, h, rows[~low], depth - 1, z)


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    p0 = min(max(y.mean(), 0.01), 0.99)
    f = Forest([], float(np.log(p0 / (1 - p0))), {})
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS)))[1:] for v in x.T]
    binned = np.array([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)])
    z, rows = np.full(len(y), f.start), np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        f.trees.append(_tree(binned, cuts, y - p, p * (1 - p), rows, DEPTH, z))
    return f


def sentences(n: int, seed: int):
    """(text, true spans): made sentences with one thing in each, personal or a look-alike."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))

    def luhned(k: int) -> str:
        s = r.choice("3456") + d(k - 2)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def cut(s: str, sep: str, sizes) -> str:
        out, at = [], 0
        for z in sizes:
            out.append(s[at : at + z])
            at += z
        return sep.join(x for x in [*out, s[at:]] if x)

    good = {
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(6)}", f"{d(3)}-{d(4)}"]),
        "card": lambda: r.choice([luhned(13), cut(luhned(16), ".", (4, 4, 4)), cut(luhned(16), "/", (4, 4, 4)), cut(luhned(15), ".", (4, 6))]),
        "email": lambda: r.choice([f"{word()} [at] {word()} [dot] com", f"{word()}.{word()} (at) {word()}.org", f"{word()} at {word()} dot net", f"{word()} @ {word()}.de", f"{word()}(at){word()}(dot)fr"]),
        "ip": lambda: r.choice([":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)), "[.]".join(str(r.randint(1, 255)) for _ in range(4))]),
    }
    before = {
        "phone": ["call me at", "phone:", "tel.", "mobile", "my cell is", "fax", "or ring", "téléphone", "Handy"],
        "card": ["my card is", "visa", "charged to credit card", "payment card", "carte"],
        "email": ["email", "contact", "write to", "reach me:", "correo"],
        "ip": ["host", "from ip", "server address", "peer"],
    }
    bad = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
        lambda: f"{d(2)} {d(3)} {d(3)}",
        lambda: f"{d(1)}.{d(3)}.{d(3)}.{d(3)}",
        lambda: d(r.randint(7, 19)),
        lambda: f"{d(3)}-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: f"{d(2)}.{d(1)}.{d(2)}.{d(4)}",
        lambda: f"{d(3)} {d(4)} {d(2)} {d(5)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(3)}",
        lambda: f"{word()} at {word()} dot",
        lambda: f"{word()} at {word()}.{word()}",
    ]
    against = ["order no.", "invoice", "ISBN", "version", "total $", "id", "serial", "on date", "ref", "between", "page", "table", "score", "code ="]
    for _ in range(n):
        lead, tail = " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 5)))
        if r.random() < 0.5:
            kind = r.choice(KINDS)
            thing = good[kind]()
            cue = r.choice(before[kind]) if kind in ("phone", "card") and not re.match(r"\(\d{3}\)", thing) or r.random() < 0.6 else word()
            head = f"{lead} {cue} ".lstrip()
            yield head + thing + r.choice([" ", ". ", ", "]) + tail, (kind, len(head), len(head) + len(thing))
        else:
            cue = r.choice(against) if r.random() < 0.5 else word()
            yield f"{lead} {cue} ".lstrip() + r.choice(bad)() + r.choice([" ", ". ", ", "]) + tail, None


def crowded(n: int, seed: int):
    """(text, true spans): made sentences with neighbouring items, personal or not, and shortened IPv6."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    four = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))

    def card() -> str:
        s = r.choice("3456") + d(14)
        s = next(s + c for c in "0123456789" if luhn(s + c))
        return r.choice("./ -").join(s[k : k + 4] for k in range(0, 16, 4))

    def short() -> str:
        left = [four() for _ in range(r.randint(1, 4))]
        left[0] = r.choice(["2001", "2a02", "fe80", "fd" + d(2), "2606", left[0]])
        return ":".join(left) + "::" + ":".join(four() for _ in range(r.randint(0 if len(left) > 1 else 1, 7 - len(left) if r.random() < 0.3 else 2)))

    phone = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)}-{d(3)}-{d(2)}-{d(2)}", f"0{d(2)}/{d(3)}{d(4)}"])
    other = lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", d(r.randint(1, 6)), f"{d(1)}.{d(2)}", f"{r.randint(1900, 2030)}"])
    plain = ["d::add", "12::30", "a::b", "face::dead", "1::2", "::", "c::d", "e::f", "0::1"]
    for _ in range(n):
        parts, spans = [" ".join(word() for _ in range(r.randint(0, 4)))], []
        at = len(parts[0])

        def put(text: str, kind: str | None = None) -> None:
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(text)))
            parts.append(text)
            at += len(text)

        what = r.random()
        if what < 0.2:
            put(r.choice([" host ", " from ip ", " server ", " address ", " peer ", f" {word()} ", f" {word()} "]))
            put(short(), "ip")
            put(r.choice([" ", ", ", "/64 ", ". "]))
        elif what < 0.3:
            put(f" {word()} ")
            put(r.choice(plain))
            put(" ")
        elif what < 0.5:  # runs of other things only
            sep = r.choice([" ", " / ", " - ", "  ", "-", "/"])
            put(f" {r.choice(['scores', 'table', 'dates', 'totals', word(), word()])} ")
            for k in range(r.randint(2, 10)):
                put((sep if k else "") + (other() if r.random() < 0.5 else d(r.randint(1, 5))))
        else:
            cue = r.choice([" call ", " phone: ", " tel. ", " fax ", " reach us at ", f" {word()} ", f" {word()} ", " "])
            put(cue)
            sep = r.choice([" ", " / ", "  ", " - ", ", ", "/", " "])
            items = r.choice([["p", "p"], ["p", "p"], ["o", "p"], ["p", "o"], ["o", "p", "o"], ["p", "p", "p"], ["c", "p"], ["p", "c"], ["c", "o"], ["o", "c"]])
            for k, i in enumerate(items):
                if k:
                    put(sep)
                put(*{"p": lambda: (phone(), "phone"), "c": lambda: (card(), "card"), "o": lambda: (other(),)}[i]())
            put(r.choice([" ", ". ", ", "]))
        put(" ".join(word() for _ in range(r.randint(0, 4))))
        yield "".join(parts), spans


def loose(n: int, seed: int):
    """(text, true spans): numbers in groups of any sizes and separators, hexadecimal groups and words around an at,
    which what stands before them, or their check digit, makes personal or not."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrstdmkp") for _ in range(r.randint(2, 9)))
    calls = ["phone", "tel", "Tel.:", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "Handy", "téléphone", "teléfono", "numéro", "appelez", "llame", "anrufen", "my number is"]
    pays = ["card", "Karte", "carte", "tarjeta", "visa", "mastercard", "credit card", "paid with", "payment"]
    hosts = ["ip", "host", "server", "address", "peer", "subnet", "ping"]
    other = ["order", "No.", "ref", "id", "lot", "serial", "tracking", "total", "page", "chapter", "version", "ISBN", "since", "score", "code", "room", "part", "§"]

    def grouped(sizes, most: int = 2) -> str:
        seps = r.choice([["-"], [" "], ["."], ["/"], [" ", "-"], [" / ", " "], ["/", "-"]])
        out = d(sizes[0])
        if r.random() < 0.2:
            out = f"({out})"
            seps = [" "] if r.random() < 0.7 else ["-"]
        for z in sizes[1:]:
            out += r.choice(seps) + d(z)
        return out

    def sizes(total: int) -> list[int]:
        out = []
        while total > 0:
            z = min(total, r.randint(1 if not out and r.random() < 0.15 else 2, 4 if r.random() < 0.9 else 8))
            out.append(z)
            total -= z
        return out if out[-1] > 1 or len(out) == 1 else [*out[:-2], out[-2] + out[-1]]

    def card() -> str:
        s = r.choice("3456") + d(r.choice((11, 13, 14)))
        s = next(s + c for c in "0123456789" if luhn(s + c))
        ends = [0, *sorted(r.sample(range(3, len(s) - 2), r.choice((2, 3)))), len(s)] if r.random() < 0.4 else [0, 4, 8, 12, len(s)] if r.random() < 0.6 else [0, 4, 10, len(s)]
        return r.choice(("", "/", ".", " . ", "  ", " / ")).join(s[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def fails(s: str) -> str:
        k = max(i for i, c in enumerate(s) if c.isdigit())
        return s[:k] + str((int(s[k]) + r.randint(1, 9)) % 10)

    at = lambda: r.choice((" [at] ", "(at)", " (at) ", "[at]", " {at} ", "{at}", " at ", " @ ", " @", "@ "))
    for _ in range(n):
        lead = " ".join(word() for _ in range(r.randint(0, 5)))
        kind = r.choice(("phone", "phone", "phone", "card", "email", "ip", "ip"))
        mine = r.random() < 0.5
        cue = r.choice(other) if r.random() < 0.5 else word()
        if kind == "phone":
            thing = grouped(sizes(r.choice((9, 10, 10, 10, 11, 12) if mine else (7, 8, 9, 10, 10, 11, 12, 13))))
            cue = r.choice(calls) if mine else cue
        elif kind == "card":
            thing = card()
            cue = r.choice(pays) if mine and r.random() < 0.9 else cue
            thing = thing if mine else fails(thing)
        elif kind == "email":
            dot = r.choice((" [dot] ", " dot ", "(dot)", " {dot} ", ".", " (dot) "))
            sign = at()
            thing = word() + r.choice(("", ".", "_", "-")) + (word() if r.random() < 0.3 else d(r.randint(0, 2))) + sign + word() + dot + r.choice(("com", "org", "net", "de", "fr", "es", "co.uk" if dot == "." else "co" + dot + "uk", "io"))
            if not mine:
                thing = f"{word()}{r.choice((' at ', ' at the ', ' @ '))}{word()} {r.choice(('dot', 'dots', 'dotted ' + word(), word()))}" if r.random() < 0.7 else f"{word()} at {word()}. {word().title()}"
        else:
            if mine:
                thing = r.choice((lambda: ":".join(h(r.randint(1, 4)) for _ in range(8)), lambda: r.choice(("2001", "fe80", "2a0" + h(1), "fd" + h(2))) + "::" + ":".join(h(r.randint(1, 4)) for _ in range(r.randint(1, 3))), lambda: r.choice(("[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))))()
                cue = r.choice(hosts) if r.random() < 0.5 else word()
            else:
                thing = r.choice((lambda: ":".join(h(2) for _ in range(6)), lambda: ":".join(d(2) for _ in range(r.randint(3, 5))), lambda: "::".join((word(), word())), lambda: ":".join(h(2) for _ in range(8))))()
        tail = r.choice((" ", ". ", ", ", "\n"))
        if kind == "phone" and r.random() < 0.1:  # a country code speaks for itself, whatever stands beside the number
            mine, cue = True, cue if r.random() < 0.5 else word()
            thing = f"+{d(r.randint(1, 3))} " + r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(7)}", f"{d(2)} {d(4)} {d(4)}"))
            tail = " " + r.choice((".".join(str(r.randint(0, 255)) for _ in range(4)), d(r.randint(6, 9)), fails(card()))) + " "
        head = (lead + " " + cue).lstrip() + r.choice((" ", " ", ": "))
        yield head + thing + tail + " ".join(word() for _ in range(r.randint(0, 4))), [(kind, len(head), len(head) + len(thing))] if mine else []


#: Ordinary words, for the text that thresholds are calibrated on.
PROSE = {
    "en": "the people said that work would begin after lunch because nobody had found a better way to reach her before we met again and it was late".split(),
    "de": "die Leute sagten dass wir nach dem Essen beginnen weil niemand einen besseren Weg fand und es schon spät war also kommt bitte morgen".split(),
    "fr": "les gens ont dit que nous allons commencer après le repas car personne ne savait comment faire mieux et il était déjà tard pour venir".split(),
    "es": "la gente dijo que vamos a empezar después de comer porque nadie sabía cómo hacerlo mejor y ya era tarde para venir mañana".split(),
}


def prose_cases(n: int, seed: int):
    """(text, true spans): prose with up to three things in it, by other formats, cues and look-alikes than the training sentences."""
    r = random.Random(seed)

    def fill(shape: str) -> str:
        return "".join(r.choice("0123456789") if c == "#" else r.choice("0123456789abcdef") if c == "~" else c for c in shape)

    def luhned(n: int) -> str:
        s = r.choice(("4", "51", "37", "6011", "35")) + "".join(r.choice("0123456789") for _ in range(n))
        s = s[: n - 1]
        return next(s + c for c in "0123456789" if luhn(s + c))

    def cut(s: str, sizes, sep: str) -> str:
        ends = np.cumsum([0, *sizes]).tolist()
        return sep.join(s[a:b] for a, b in zip(ends, ends[1:], strict=False))

    name = lambda: r.choice(("anna", "j.smith", "info", "paul_87", "maria.lopez", "kontakt", "c.dubois", "sales"))
    host = lambda: r.choice(("acme", "uni-bonn", "mailbox", "orange", "example", "firma24"))
    top = lambda: r.choice(("com", "de", "fr", "org", "co dot uk", "es", "net"))
    good = {
        "phone": lambda: fill(r.choice(("0## #### ####", "(0##) ### ## ##", "0#### ######", "1-###-###-####", "0#-##-##-##-##", "0# ## ## ## ##", "(##) #### ####", "### ### ####", "###.###.####", "### ## ## ##", "0##/#######"))),
        "card": lambda: r.choice((lambda: luhned(13), lambda: cut(luhned(16), (4, 4, 4, 4), r.choice(("/", ".", " . "))), lambda: cut(luhned(15), (4, 6, 5), r.choice((".", "/")))))(),
        "email": lambda: r.choice((lambda: f"{name()} [at] {host()} [dot] com", lambda: f"{name()} at {host()} dot {top()}", lambda: f"{name()}(at){host()}.{r.choice(('de', 'org'))}", lambda: f"{name()} @{host()}.com", lambda: f"{name()} {{at}} {host()} {{dot}} net"))(),
        "ip": lambda: fill(r.choice(("2001:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "fe80::~~~~:~~~~", "2a01:~~~~:~~~~::1", "1#.##.#.##".replace(".", "[.]"), "1##.##.#.#".replace(".", "(.)"), "fd00:~~::~~~~"))),
    }
    cues = {
        "phone": ("Tel.", "Telefon:", "appelez le", "llame al", "phone", "my number is", "ruf an unter", "mobile:", "fax", "WhatsApp"),
        "card": ("card number", "Karte", "carte bancaire", "tarjeta", "Visa", "credit card:"),
        "email": ("write to", "e-mail:", "Kontakt", "courriel", "correo", "mail me:"),
        "ip": ("from host", "IP", "server", "the address", "peer"),
    }
    bad = (
        "20##-0#-1# 1#:##:##", "0#.1#.20##", "1#/0#/20##", "978-#-##-######-#", "40063813#####", "#.###.###,##", "## ### ###", "19##-19##", "3-2 4-1 0-0 2-2", "v1#.#.##.####",
        "48.####/2.####", "SN ####-####-####", "order ########", "No. ##########", "################", "1#:##:##:##", "~~:~~:~~:~~:~~:~~", "std::sort", "12.5/33.1/54.4", "100.000.000", "§ ## 1.2.3.4.5",
        "he looked at them dot", "arrived at noon. Dot", "meet at cafe.", "GTIN #############", "lot ##-####-##", "#### #### #### ####", "p. ###-###", "1 000 000 - 2 000 000", "chapter #.#.#.#.#", "tracking ####-####-######",
    )
    for _ in range(n):
        words = PROSE[r.choice(sorted(PROSE))]
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(words) for _ in range(r.randint(2, 8))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                # without a cue only some formats can be told from other numbers
                if r.random() < 0.85:
                    text += r.choice(cues[kind]) + " "
                thing = good[kind]()
                spans.append((kind, len(text), len(text) + len(thing)))
                text += thing
            else:
                text += fill(r.choice(bad))
            text += r.choice((". ", ", ", " ", "\n"))
        yield text + " ".join(r.choice(words) for _ in range(3)), spans


def _true(c: Span, spans: list[Span]) -> bool:
    """Numbers end at their groups' borders, so nothing but the whole item is right; others may differ a little."""
    return any(c[0] == k and ((c[1], c[2]) == (a, b) if k in ("phone", "card") else min(c[2], b) - max(c[1], a) >= 0.8 * (max(c[2], b) - min(c[1], a))) for k, a, b in spans)


def _rows(made) -> tuple[np.ndarray, np.ndarray]:
    rows = [(features(t, c), _true(c, spans)) for t, spans in made for c in candidates(t)]
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


#: What share of a kind's added spans must be true where thresholds are calibrated.
PRECISION = 0.98


@cache
def trained() -> Forest:
    """The trees, and for each kind the least threshold at which PRECISION of what is added to prose is true."""
    f = boost(*_rows([*((t, [true] if true else []) for t, true in sentences(2500, 1)), *crowded(2500, 1), *loose(5000, 1)]))
    found = []
    for t, spans in prose_cases(2500, 2):
        base = base_spans(t)
        found += [(c[0], p, _true(c, spans)) for c, p in judged(t, base, f)]
    for kind in KINDS:
        mine = sorted((p, y) for k, p, y in found if k == kind)
        p, y = np.array([x[0] for x in mine]), np.array([x[1] for x in mine], float)
        # the share that is true among all at and above each probability
        each, first = np.unique(p, return_index=True)
        held = (y[::-1].cumsum()[::-1] / np.arange(len(y), 0, -1))[first] if len(y) else y
        right = np.flatnonzero(held >= PRECISION)
        f.thresholds[kind] = float(each[right[0]]) if len(right) else 1.1
    return f


def judged(t: str, base: list[Span], forest: Forest) -> list[tuple[Span, float]]:
    """The most probable candidates that overlap neither base nor each other, whatever the probability."""
    taken = _Taken()
    for _, a, b in base:
        taken.put(a, b)
    found = [(-forest.probability(features(t, c)), c[1] - c[2], c) for c in candidates(t) if not taken.meets(c[1], c[2])]
    return [(c, -p) for p, _, c in sorted(found) if taken.put(c[1], c[2])]


class _Taken:
    """Intervals that overlap nothing, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def put(self, a: int, b: int) -> bool:
        """Adds [a, b), or where it overlaps others is left out: what they leave of it overlaps nothing that they don't."""
        if self.meets(a, b):
            return False
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def added_spans(t: str, base: list[Span], forest: Forest) -> list[Span]:
    return [c for c, p in judged(t, base, forest) if p >= forest.thresholds[c[0]]]


def find(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and all spans, for every row. Map only."""
    forest = trained()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                every = ordered(base + added_spans(t or "", base, forest))
                rows.append((*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(written_as(base).encode()).hexdigest(), written_as(every)))
            cols = [pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redacted(t: str, forest: Forest) -> str:
    base = base_spans(t)
    spans = base + added_spans(t, base, forest)
    if not spans:
        return t
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [t[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    forest = trained()
    plain, named = plain_names(documents, "text", "n_chars")
    at = plain.columns.index("text")

    def run(batches):
        for b in batches:
            new = [t if t is None else redacted(t, forest) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = map_arrow(plain, run, plain.schema)
    return named(out.withColumn("n_chars", F.length("text").cast(plain.schema["n_chars"].dataType)) if "n_chars" in plain.columns else out)
