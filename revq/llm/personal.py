"""Personal data in texts, plain and disguised, at its place in the source.

Plain e-mail addresses, IP addresses, card and phone numbers are found by patterns. For
disguised ones the text passes through transducers, each of which rewrites pieces of
it: look-alike characters, entities and bracketed signs, spelled digits, letters among
digits, spelled "at" and "dot", blanks around signs. A `Tape` carries along, for every
character, the source characters that it stands for; what the patterns then find on
the last tape is mapped back to the source. Plain finds stay as they are; a disguised
one is added if the rewriting made it and no plain find of its kind holds it.

A text is read whole, in time proportional to its length. A null or empty text has no
spans. Rows are independent: repeated rows give repeated results, an empty table an
empty one. Other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revq.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind string, start long, end long, plain boolean>>"

Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match cannot begin inside a run of digits, as it would have begun at the run's start. The
# patterns look back after their first character, which lets the search skip to it.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    end = 0
    for found in _DOMAIN.finditer(text):
        # The local part goes back from the sign, but not into the address before.
        at = first = found.start()
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            end = found.end()
            yield first, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        total += value if i % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def _ips(text: str) -> Iterator[Span]:
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") for p in found.group().split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield found.span()


def _cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in found.group()) <= 15:
            yield found.span()


_FINDERS: dict[str, Callable[[str], Iterator[Span]]] = dict(zip(KINDS, (_emails, _ips, _cards, _phones)))


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans (code points, end exclusive) of each kind, from left to right."""
    return {kind: list(find(text)) for kind, find in _FINDERS.items()}


class Tape:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def rewritten(self, pieces: list[tuple[int, int, str]]) -> Tape:
        """Each piece (from, to, new) replaced; pieces are in order and do not overlap.

        Every new character stands for all source characters of its piece.
        """
        if not pieces:
            return self
        texts, starts, ends, done = [], [], [], 0
        for a, b, new in pieces:
            texts += [self.text[done:a], new]
            starts += [self.start[done:a], np.full(len(new), self.start[a])]
            ends += [self.end[done:a], np.full(len(new), self.end[b - 1])]
            done = b
        texts.append(self.text[done:])
        return Tape(
            "".join(texts),
            np.concatenate([*starts, self.start[done:]]),
            np.concatenate([*ends, self.end[done:]]),
        )


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ѕ": "s", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o",
    "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "。": ".", "۔": ".",
}
# Characters without width.
WIDTHLESS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_table: list[np.ndarray] = []


def _look_alike_table() -> np.ndarray:
    """For each code point the one it is read as; 0 where it is left out."""
    if not _table:
        table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for code in range(0x80, 0x20000):
            c = chr(code)
            same = unicodedata.normalize("NFKC", c)
            kind = unicodedata.category(c)
            if kind == "Nd":
                table[code] = ord("0") + unicodedata.digit(c)
            elif kind == "Pd":
                table[code] = ord("-")
            elif kind == "Zs":
                table[code] = ord(" ")
            elif len(same) == 1 and same.isascii():
                table[code] = ord(same)
        for c, same in LOOK_ALIKES.items():
            table[ord(c)] = ord(same)
        for c in WIDTHLESS:
            table[ord(c)] = 0
        _table.append(table)
    return _table[0]


def _look_alikes(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    codes = np.frombuffer(tape.text.encode("utf-32-le"), np.uint32)
    read = _look_alike_table()[codes]
    if np.array_equal(read, codes):
        return tape
    stays = np.flatnonzero((read != 0) | (codes == 0))
    return Tape(read[stays].tobytes().decode("utf-32-le"), tape.start[stays], tape.end[stays])


# Names of the signs and digits in the languages that are known.
AT = "at|arroba|arobase|klammeraffe"
DOT = "dot|punkt|punto|point"
DIGITS = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
_DIGIT = {name: str(value) for value, names in enumerate(DIGITS) for name in names}
LEAST_SPELLED = 3
# Last parts of addresses that are spelled without brackets, which prose may hold by chance.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|eu|us|uk|de|fr|es|it|nl|ch"


def _any_of(names: Iterable[str]) -> str:
    """An alternation that looks at a first letter once."""
    by_letter: dict[str, list[str]] = {}
    for name in names:
        by_letter.setdefault(name[0], []).append(name[1:])
    return "|".join(f"{first}(?:{'|'.join(sorted(rest, reverse=True))})" for first, rest in by_letter.items())


_NAME = _any_of(_DIGIT)
_SIGNS = re.compile(
    r"[(\[{<&%](?:"
    rf"(?<=[(\[{{<])\s*+(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s*+[)\]}}>]\s*+"
    r"|(?<=&)(?:(?P<at_entity>#64;|#x40;|commat;)|(?P<dot_entity>#46;|#x2e;|period;))"
    r"|(?<=[a-z0-9]%)(?P<at_code>40)(?=[a-z0-9]))",
    re.IGNORECASE,
)
_GAP = r"[\x20\t\n\r,.()-]"
_NAMES_MEET = re.compile(
    rf"\b(?:{_NAME})\b{_GAP}{{1,3}}(?:{_NAME}|{DOT})\b|[0-9]\x20(?:{DOT})\x20[0-9]", re.IGNORECASE
)
_TOKEN = rf"(?:(?:double|triple)[\x20-])?(?:{_NAME})\b|plus\b|(?:{DOT})\b|[0-9]++|\+"
_SPELLED = re.compile(rf"(?<![\w+])(?:{_TOKEN})(?:{_GAP}{{0,3}}(?:{_TOKEN}))++", re.IGNORECASE)
_PARTS = re.compile(
    rf"(?:(?P<times>double|triple)[\x20-])?\b(?P<name>{_NAME})\b|(?P<plus>\bplus\b)|(?P<dot>\b(?:{DOT})\b)"
    r"|(?P<own>[0-9+]+)",
    re.IGNORECASE,
)
_NUMBERLIKE = re.compile(r"[0-9OoIl](?<![A-Za-z0-9].)[0-9OoIl]{2,}+(?![A-Za-z0-9])", re.DOTALL)
_LABEL = r"[a-z0-9_%+-]++(?:\.[a-z0-9_%+-]++)*+"
_SPELLED_DOT = re.compile(rf"\s(?:{DOT})\s++(?:[a-z0-9-]++\s++(?:{DOT})\s++){{0,3}}(?:{ENDINGS})\b", re.IGNORECASE)
_SPELLED_ADDRESS = re.compile(
    rf"(?<![\w.%+-]){_LABEL}(?:\s++(?:{DOT})\s++{_LABEL}){{0,4}}?(?:\s++(?:{AT})\s++|@)[a-z0-9.-]++"
    rf"(?:\s++(?:{DOT})\s++[a-z0-9.-]++){{0,3}}?\s++(?:{DOT})\s++(?:{ENDINGS})\b",
    re.IGNORECASE,
)
_SPELLED_SIGN = re.compile(rf"(?<=\S)\s++(?:(?P<at>{AT})|(?:{DOT}))\s++", re.IGNORECASE)
_SPACED_ADDRESS = re.compile(
    r"(?<=[a-z0-9])[\x20\t]{0,3}@[\x20\t]{0,3}(?:[a-z0-9-]{1,63}[\x20\t]{0,3}\.[\x20\t]{0,3}){1,4}[a-z]{2,6}\b",
    re.IGNORECASE,
)


def _signs(tape: Tape) -> Tape:
    """Entities and bracketed signs with the blanks around them: '&#64;', ' [at] ', '(dot)'."""
    pieces, done = [], 0
    for m in _SIGNS.finditer(tape.text):
        first = m.start()
        while m.lastgroup in ("at", "dot") and first > done and tape.text[first - 1].isspace():
            first -= 1
        done = m.end()
        pieces.append((first, done, "@" if m.lastgroup.startswith("at") else "."))
    return tape.rewritten(pieces)


def _spelled_digits(tape: Tape) -> Tape:
    """Runs of names of digits, with their gaps left out: 'plus one, double five' as '+155'.

    A run holds at least three names or "dots", somewhere two in succession (or "dot" between digits).
    """
    if not _NAMES_MEET.search(tape.text):
        return tape
    pieces = []
    for run in _SPELLED.finditer(tape.text):
        parts = list(_PARTS.finditer(tape.text, *run.span()))
        if sum(p["name"] is not None or p["dot"] is not None for p in parts) < LEAST_SPELLED:
            continue
        done = run.start()
        for p in parts:
            if p.start() > done:
                # A full stop between digits, as in a number of four parts, is a sign of its own.
                gap = tape.text[done : p.start()]
                if gap != ".":
                    pieces.append((done, p.start(), ""))
            if p["name"]:
                times = {"double": 2, "triple": 3}.get((p["times"] or "").lower(), 1)
                pieces.append((*p.span(), _DIGIT[p["name"].lower()] * times))
            elif p["plus"]:
                pieces.append((*p.span(), "+"))
            elif p["dot"]:
                pieces.append((*p.span(), "."))
            done = p.end()
    return tape.rewritten(pieces)


def _letters_as_digits(tape: Tape) -> Tape:
    """'4O3' and '55l' as '403' and '551', where most of the characters are digits."""
    pieces = []
    for m in _NUMBERLIKE.finditer(tape.text):
        token = m.group()
        letters = [i for i, c in enumerate(token) if c in "OoIl"]
        if letters and 2 * len(letters) < len(token):
            pieces += [(m.start() + i, m.start() + i + 1, "0" if token[i] in "Oo" else "1") for i in letters]
    return tape.rewritten(pieces)


def _spelled_addresses(tape: Tape) -> Tape:
    """'ann at example dot org': an "at" counts only before a spelled "dot" and a known ending."""
    if not _SPELLED_DOT.search(tape.text):
        return tape
    pieces = []
    for address in _SPELLED_ADDRESS.finditer(tape.text):
        pieces += [
            (*sign.span(), "@" if sign["at"] else ".") for sign in _SPELLED_SIGN.finditer(tape.text, *address.span())
        ]
    return tape.rewritten(pieces)


def _spaced_addresses(tape: Tape) -> Tape:
    """'ann @ example . org' without its blanks."""
    pieces = []
    if "@" not in tape.text:
        return tape
    for address in _SPACED_ADDRESS.finditer(tape.text):
        pieces += [
            (address.start() + blank.start(), address.start() + blank.end(), "")
            for blank in re.finditer(r"[\x20\t]+", address.group())
        ]
    return tape.rewritten(pieces)


TRANSDUCERS = (_look_alikes, _signs, _spelled_digits, _letters_as_digits, _spelled_addresses, _spaced_addresses)


def spans(text: str | None) -> list[dict]:
    """All spans of a text by kind, start and end; `plain` tells those found without rewriting."""
    if not text:
        return []
    plain = plain_spans(text)
    tape = source = Tape(text)
    for transducer in TRANSDUCERS:
        tape = transducer(tape)
    found = [(kind, a, b, True) for kind, places in plain.items() for a, b in places]
    if tape is not source:
        for kind, places in plain_spans(tape.text).items():
            held = np.array(plain[kind], np.int64).reshape(-1, 2)
            for a, b in places:
                first, last = int(tape.start[a]), int(tape.end[b - 1])
                # Plain spans are in order and apart, so only the last that starts by `first` can hold it.
                i = int(np.searchsorted(held[:, 0], first, side="right")) - 1
                inside = i >= 0 and held[i, 1] >= last
                if text[first:last] != tape.text[a:b] and not inside:
                    found.append((kind, first, last, False))
    found.sort(key=lambda s: (KINDS.index(s[0]), s[1:]))
    return [dict(zip(("kind", "start", "end", "plain"), s)) for s in found]


def redacted(text: str | None, found: list[dict]) -> str | None:
    """The text with each stretch of spans replaced by the kind of the first, as '<EMAIL>'."""
    if not text:
        return text
    out, done, stretch = [], 0, None
    for span in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if stretch and span["start"] < stretch["end"]:
            stretch["end"] = max(stretch["end"], span["end"])
            continue
        if stretch:
            out += [text[done : stretch["start"]], f"<{stretch['kind'].upper()}>"]
            done = stretch["end"]
        stretch = dict(span)
    if stretch:
        out += [text[done : stretch["start"]], f"<{stretch['kind'].upper()}>"]
        done = stretch["end"]
    return "".join([*out, text[done:]])


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """doc_id and spans per document; with `redact` also its text without them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans {SPANS}" + (", text string" if redact else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
        for batch in batches:
            for part in slices(batch):
                texts = part["text"].to_pylist()
                found = [spans(t) for t in texts]
                columns = {"doc_id": part["doc_id"], "spans": pa.array(found, pa.list_(struct))}
                if redact:
                    columns["text"] = pa.array([redacted(t, f) for t, f in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(work, schema)
