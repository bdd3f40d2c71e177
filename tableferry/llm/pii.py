"""Personal data: plain detection, and detection behind disguises with spans mapped back.

A transducer rewrites look-alike letters, spelled digits and "at"/"dot" disguises into plain
characters and remembers which source characters each written character stands for. Identifiers
are found in the rewritten text, and their spans are mapped back to the source.

Null and empty texts have no spans. Spans count code points, end exclusive. Texts may be of any length: each
rule passes over a text once. Repeated rows give repeated results. Detection looks at the key and the text only;
redaction keeps all other columns, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

Span = tuple[str, int, int]

#: Kinds, in the order of the output.
KINDS = ("email", "ip", "card", "phone")

#: Look-alikes of ASCII characters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "﹒": ".", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ",
}
#: Runs of ten digits in other scripts, by the code point of their zero.
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
PLAIN = str.maketrans(
    LOOK_ALIKES
    | {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}
    | {chr(zero + d): str(d) for zero in DIGIT_ZEROS for d in range(10)}
    | {chr(0x2460 + d): str(d + 1) for d in range(9)}
)
#: Spelled digits, in English, German, Spanish and French.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: Words for @ that mean nothing else, and words for a dot, in those languages.
AT_WORDS, DOT_WORDS = "ät|arroba|arobase|arrobase|klammeraffe", "dot|punkt|punto|point"

_digit_word = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: One next to digits: "un" there is an article as a rule.
_single = rf"(?!un\b){_digit_word}"
_hidden = "[​-‍⁠﻿­]"
_dot_word = rf"(?:[ \t]*[(\[{{<][ \t]*(?:{DOT_WORDS})[ \t]*[)\]}}>][ \t]*|[ \t]+(?:dot|DOT)[ \t]+)"
_label = r"[A-Za-z0-9-]+"
#: Last labels of a host behind a bare "at" and a determiner.
_known = "(?:com|net|org|edu|gov|info|biz|io|co|eu|de|fr|es|it|uk|us|ch|at|nl|pl|ru|jp|cn|in|br)"
_determiner = "(?:the|an?|this|that|these|those|each|every|any|some|one|no|its|his|her|their|our|my|your)"
_spoken = rf"[ \t]+(?:{DOT_WORDS})[ \t]+"
_apart = r"(?:[ \t]+\.[ \t]*|\.[ \t]+)"
_any_dot = rf"(?:\.|{_apart}|{_spoken}|{_dot_word})"
_in_brackets = rf"[ \t]*[(\[{{<][ \t]*(?:at|@|{AT_WORDS})[ \t]*[)\]}}>][ \t]*"
#: A host behind a word for @ or one in brackets, with dots of any kind; behind "at" with a spoken last dot; and behind @
#: alone with a last dot that is spoken or stands apart.
_address = (
    rf"(?:[ \t]+(?:{AT_WORDS})[ \t]+|{_in_brackets}){_label}(?:{_any_dot}{_label})*?{_any_dot}{_known}\b"
    rf"|[ \t]+at[ \t]+(?!{_determiner}\b){_label}(?:(?:\.|{_spoken}){_label})*?{_spoken}{_known}\b"
    rf"|[ \t]+@[ \t]+{_label}(?:(?:\.|{_apart}|{_spoken}){_label})*?(?:{_apart}|{_spoken}){_known}\b"
)
_in_address = re.compile(rf"(?P<at>^(?:[ \t]+(?:{AT_WORDS}|at|@)[ \t]+|{_in_brackets}))|(?P<dot>{_any_dot})|{_label}", re.IGNORECASE)
_host = rf"{_label}(?:(?:\.|{_dot_word}){_label})*?{_dot_word}"
#: What the transducer rewrites. A bare "at" counts only before a host that spells a dot; after a determiner, only
#: one of a known last label ("look at the dot on it").
REWRITES = re.compile(
    rf"(?P<none>{_hidden}+)"
    rf"|(?<=[A-Za-z0-9._%+-])(?P<address>{_address})"
    rf"|(?P<at>(?<=[A-Za-z0-9._%+-])[ \t]*[(\[{{<][ \t]*(?:[aA][tT]|@|{AT_WORDS})[ \t]*[)\]}}>][ \t]*(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9._%+-])[ \t]+(?:at|AT)[ \t]+(?={_host}{_known}\b|(?!{_determiner}\b){_host}[A-Za-z]{{2,}}\b))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_dot_word}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus[ \t]+(?=[0-9]|{_digit_word}\b))"
    rf"|(?P<digits>\b{_digit_word}(?:[ \t,-]+{_digit_word}){{1,}}\b|(?<=[0-9])[ \t-]{_single}\b|(?<=[.+]){_digit_word}\b|\b{_single}(?=[ \t-][0-9]|[ \t]+dot[ \t]))",
    re.IGNORECASE,
)
_word = re.compile(_digit_word, re.IGNORECASE)
_behind_word = "(?:" + "|".join(f"(?<={w}.)" for w in SPELLED) + ")"
#: A lower-cased text without look-alikes and any of these has nothing to rewrite: every alternative of REWRITES holds one.
TRIGGERS = (
    re.compile(rf"[ \t](?:dot|@|{AT_WORDS})[ \t]|[ \t]at[ \t][^\n]*[ \t](?:{DOT_WORDS})[ \t]"),
    re.compile(rf"[(\[{{<][ \t]*(?:at|@|{AT_WORDS}|{DOT_WORDS})[ \t]*[)\]}}>]"),
    re.compile(rf"plus[ \t]+(?:[0-9]|{_digit_word})"),
    re.compile(rf"[0-9][ \t-]{_digit_word}"),
    re.compile(rf"[.+]{_digit_word}"),
    re.compile(rf"[ \t,-](?=[0-9]|[ \t,-]*{_digit_word}){_behind_word}"),
)
#: Letters that match "s", "i" and "k" when case is ignored.
_folds = {"\u017f": "s", "\u0130": "i", "\u212a": "k"}
_fold = str.maketrans(_folds)
LOOKS = re.compile("[" + "".join(map(re.escape, [*map(chr, PLAIN), *_folds])) + "]|" + _hidden)
#: Those of them that Latin-1 has.
LATIN_LOOKS = re.compile("[\u00a0\u00ad\u00b7]")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_any_digit = re.compile("[0-9]")
_not_digit = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each match has one @: from it, back over the local part (never into an earlier match) and on
    over the domain. That is the leftmost match, in one pass."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _local:
            begin -= 1
        if begin < at and (m := _domain.match(text, at + 1)):
            yield "email", begin, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def plain_spans(text: str) -> list[Span]:
    """Spans of the plain rules, by kind and start."""
    out = list(_emails(text))
    if _any_digit.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in _card.finditer(text):
            if 16 <= len(m[0]) and 16 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


class Rewritten:
    """A text after the transducer, with the source span of each of its characters."""

    def __init__(self, source: str):
        plain = source.translate(PLAIN)
        parts, self.begins, self.sources, at, n = [], [], [], 0, 0

        def put(piece: str, begin: int, end: int, exact: bool) -> None:
            nonlocal n
            if piece:
                parts.append(piece)
                self.begins.append(n)
                self.sources.append((begin, end, exact))
                n += len(piece)

        for m in REWRITES.finditer(plain):
            put(plain[at : m.start()], at, m.start(), True)
            at = m.end()
            if m["at"]:
                put("@", *m.span(), False)
            elif m["address"]:
                for p in _in_address.finditer(plain[m.start() : m.end()]):
                    exact = not p["at"] and not p["dot"]
                    put(p[0] if exact else "@" if p["at"] else ".", m.start() + p.start(), m.start() + p.end(), exact)
            elif m["dot"]:
                put(".", *m.span(), False)
            elif m["plus"]:
                put("+", *m.span(), False)
            elif m["digits"]:
                for w in _word.finditer(plain, *m.span()):
                    put(SPELLED[w[0].translate(_fold).lower()], *w.span(), False)
        put(plain[at:], at, len(plain), True)
        self.text = "".join(parts)

    def back(self, begin: int, end: int) -> tuple[int, int]:
        def at(k: int, last: bool) -> int:
            s = bisect.bisect_right(self.begins, k) - 1
            a, b, exact = self.sources[s]
            return a + k - self.begins[s] + last if exact else b if last else a

        return at(begin, False), at(end - 1, True)


def disguised(text: str) -> bool:
    """Whether the transducer may change the text: never false for one that it does change."""
    if not text.isascii():
        try:
            text.encode("latin-1")
            looks = LATIN_LOOKS
        except UnicodeEncodeError:
            looks = LOOKS
        if looks.search(text):
            return True
    low = text.lower()
    return any(t.search(low) for t in TRIGGERS)


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """The plain spans, and those found behind disguises that no plain span of the kind contains."""
    base = plain_spans(text) if base is None else base
    if not disguised(text):
        return base
    new, found = Rewritten(text), set(base)
    for kind, begin, end in plain_spans(new.text):
        a, b = new.back(begin, end)
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            found.add((kind, a, b))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of plain spans by kind, base_sha256, spans, n_added (spans behind disguises), n_spans (all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                base = plain_spans(t or "")
                every = all_spans(t or "", base)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted_text(text: str) -> str:
    """Every span becomes its kind in angle brackets; overlapping spans become one, by the first."""
    out, at = [], 0
    for kind, a, b in sorted(all_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            k = batch.schema.get_field_index(text)
            yield batch.set_column(k, text, pa.array([t if t is None else redacted_text(t) for t in batch.column(k).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)
