r"""Personal data by offset-preserving deobfuscation.

The base detectors read the text as it is. For what is disguised, the text passes through
transducers, each of which rewrites a text and carries, for every character it puts out, the source
characters that it stands for: homoglyphs and full-width forms become ASCII, invisible characters
vanish, runs of spelled digits become digits, and "at" and "dot" disguises become @ and full stops.
The same detectors then read the normalised text, and their spans are mapped back to source
characters. Finds that no base span of their kind holds are added; base spans are never changed.

A text with nothing that a transducer rewrites is read once. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match ends with a run of digits, so that the next can start only at the start of one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The card pattern with its least number of digits written in, which drops runs that are too short.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, @ and the host, leftmost and without overlap, found from each @
    outwards: a match starts as far left as its local part reaches after the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (host := HOST.match(text, at + 1)):
            done = host.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[Span]:
    """Spans of all kinds by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if not _ANY_DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


_ANY_DIGIT = re.compile("[0-9]")

#: What looks like a letter, digit or sign of an identifier, and what is invisible.
ALIKE = (
    dict(zip("аеорсухіјѕһԁԛԝѵɡ", "aeopcyxijshdqwvg", strict=True))
    | dict(zip("АВЕКМНОРСТУХІЈЅ", "ABEKMHOPCTYXIJS", strict=True))
    | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρτυχ", "ABEZHIKMNOPTYXoavptux", strict=True))
    | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    | dict.fromkeys("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")
    | dict.fromkeys("‐‑‒–—―−﹣", "-")
    | dict.fromkeys("․‧∙。．｡", ".")
    | {"﹫": "@", "﹢": "+"}
    | {chr(start + d): str(d) for start in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
)
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
#: Digits as words.
SPELLED = {
    **{w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())},
    "oh": "0",
    **{w: str(i) for i, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())},
    **{w: str(i) for i, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(i) for i, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_GAP = r"[ .,()-]{1,3}"
_SEEN_ALIKE = re.compile("[" + "".join(map(re.escape, [*ALIKE, *INVISIBLE])) + "]")
#: A number of seven or more digits, of which at least two neighbours are spelled.
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_WORD}|plus|[0-9]){_GAP}){{6,}}(?:{_WORD}|[0-9]+)(?![^\W_])", re.I)
_TWO_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}){_GAP}(?:{_WORD})(?![^\W_])", re.I)
_ONE_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}|plus)(?![^\W_])", re.I)
_OPEN, _SHUT = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_AT = rf"(?:{_OPEN}(?:at|@|arroba)(?:{_SHUT})|\s+(?:at|arroba)\s+|\s*_at_\s*|\s+@\s*|\s*@\s+)"
_DOT = rf"(?:{_OPEN}(?:dot|punkt|point|punto|\.)(?:{_SHUT})|\s+(?:dot|punkt|punto)\s+|\s*_dot_\s*)"
_HOST = r"[A-Za-z0-9-]++"
#: The @ and host of an address in which the @ or a full stop may be disguised, with any number of labels.
_AT_HOST = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?P<at>{_AT}|@)(?P<host>{_HOST}(?:(?:\.|{_DOT}){_HOST})++)", re.I)
#: A local part and the stops in it, read backwards from the @. Each text has one reading only.
_TOD = r"(?:\s*[\])}>]\s*(?:tod|tknup|tniop|otnup|\.)\s*[\[({<]\s*|\s+(?:tod|tknup|otnup)\s+|\s*_tod_\s*)"
_LACOL = r"(?:(?!_tod_)[A-Za-z0-9._%+-])++"
_BACKWARDS = re.compile(rf"{_LACOL}(?:{_TOD}{_LACOL})*+", re.I)
_DOTTED = re.compile(_DOT, re.I)
_MAY_BE_DISGUISED = re.compile(rf"[\[({{<]\s*+(?:at|@|arroba|dot|punkt|point|punto|\.)\s*+[\])}}>]|\s(?:dot|punkt|punto)\s|_(?:at|dot)_|\s@|@\s", re.I)
#: A network address with a disguised stop, in digits or in words, of which a part has three at most.
_STOP = rf"(?:{_DOT}|\.)"
_PART = rf"(?:[0-9]{{1,3}}|(?:{_WORD})(?:[ -](?:{_WORD})){{0,2}})"
_NETWORK = re.compile(rf"(?<![\w.]){_PART}(?:{_STOP}{_PART}){{3}}(?!\w|\.[0-9])", re.I)
_STOPS = re.compile(_STOP, re.I)
_TOP = re.compile(r"[A-Za-z]{2,24}$")
#: Last labels of hosts that plain "at" and "dot" between blanks may be read before.
_COMMON_TOP = re.compile(r"(?:com|org|net|edu|gov|info|io|co|uk|eu|de|fr|es|it|ch|at|us|example|test)$", re.I)


class Mapped:
    """A text and, per character, the source characters [start, end) that it stands for. ``starts``
    is None while every character stands for itself."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | None = None
        self.ends: list[int] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts strings in place of [start, end); edits are in order and do not overlap. Each new
        character stands for the whole of what it replaces."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = [*range(len(self.text))], [*range(1, len(self.text) + 1)]
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _alike(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), ALIKE.get(x[0], "")) for x in _SEEN_ALIKE.finditer(m.text)])


def _spelled(m: Mapped) -> None:
    """Runs of spelled digits lose their words and gaps, so that a run is one number."""
    edits = []
    for run in _SPELLED_RUN.finditer(m.text):
        if not _TWO_SPELLED.search(run[0]):
            continue
        at, parts = run.start(), []
        for x in _ONE_SPELLED.finditer(run[0]):
            parts.append((at + x.start(), at + x.end(), SPELLED.get(x[0].lower(), "+")))
        stop = at
        for a, b, new in parts:
            if a > stop and stop > at and not any(c.isdigit() for c in m.text[stop:a]):
                edits.append((stop, a, ""))  # the gap between two spelled digits
            edits.append((a, b, new))
            stop = b
    m.rewrite(edits)


def _networks(m: Mapped) -> None:
    """Network addresses whose stops are disguised or whose parts are spelled become digits and stops."""
    edits: list[tuple[int, int, str]] = []
    for x in _NETWORK.finditer(m.text):
        if not _DOTTED.search(x[0]):
            continue
        at, own = x.start(), []
        for stop in [*_STOPS.finditer(m.text, *x.span()), None]:
            part = m.text[at : stop.start() if stop else x.end()]
            spelled = [SPELLED.get(w.lower(), w) for w in re.split("[ -]", part)]
            own.append((at, at + len(part), "".join(spelled)))
            if stop:
                own.append((*stop.span(), "."))
                at = stop.end()
        edits += [e for e in own if m.text[e[0] : e[1]] != e[2]]
    m.rewrite(edits)


def _addresses(m: Mapped) -> None:
    edits: list[tuple[int, int, str]] = []
    backwards, n, done = m.text[::-1], len(m.text), 0
    for x in _AT_HOST.finditer(m.text):
        local = _BACKWARDS.match(backwards, n - x.start(), n - done)
        if not local:
            continue
        dots = [d for span in ((n - local.end(), x.start()), x.span("host")) for d in _DOTTED.finditer(m.text, *span)]
        plain_at = re.fullmatch(r"\s+(?:at|arroba)\s+", x["at"], re.I)
        # "at" between blanks is a word; it is a disguise if the host's stops are disguised too
        if (plain_at and not any(d.start() > x.end("at") for d in dots)) or not (_COMMON_TOP if plain_at else _TOP).search(x["host"]):
            continue
        edits += sorted([(d.start(), d.end(), ".") for d in dots] + [(*x.span("at"), "@")])
        done = x.end()
    m.rewrite(edits)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans in source characters that only the normalised text shows."""
    m = Mapped(text)
    if not text.isascii() and _SEEN_ALIKE.search(text):
        _alike(m)
    signs = _MAY_BE_DISGUISED.search(m.text)
    if signs:
        _networks(m)
    if _TWO_SPELLED.search(m.text):
        _spelled(m)
    if signs:
        _addresses(m)
    if m.starts is None:
        return []
    taken: dict[int, list[Span]] = {}
    for s in base:
        taken.setdefault(s[1], []).append(s)
    out = []
    for start, kind, end in detect(m.text):
        a, b = m.source(start, end)
        if not any(x[0] <= a and b <= x[2] for x in taken.get(kind, ())):
            out.append((a, kind, b))
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans
    (base and disguised).

    Null is empty; a text without finds has zero counts, the digest of the empty string and an
    empty list. Spans of one start go by kind, then end. Repeated rows, and rows that repeat or lack an
    id, give a result each, an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, lists, n = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                base = detect(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                more = disguised(text, base)
                lists.append(_listed(sorted(base + more) if more else base))
                n.append(len(base) + len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(n, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"],
            )

    return id_and_text(docs).mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")
