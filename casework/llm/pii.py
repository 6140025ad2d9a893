"""Personal data in text, plain and disguised, with source offsets (operator 7).

Plain identifiers are found on the text as it is.  Then transducers rewrite
the text one after the other - look-alike letters and invisible characters,
spelled digits, at/dot disguises - and keep for every rewritten character the
stretch of source characters it stands for.  The same detectors run on the
result, and what they find is mapped back.  A find that overlaps a plain one of
its kind adds nothing; plain ones always stay.

Spans count code points, end exclusive.  Every detector is linear in the text.

Defined results: a null text is an empty one and has no spans; repeated rows
get equal results; other columns are not touched.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
# a match can only begin where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in _LOCAL:
            i -= 1
        host = _HOST.match(text, at + 1) if i < at else None
        if host:
            yield i, host.end()
        end = host.end() if host else at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[Span]:
    """Identifiers that stand in the text undisguised, by start, then kind."""
    out: list[Span] = [("email", i, j) for i, j in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Aligned:
    """A rewritten text; character i stands for source characters start[i] to end[i]."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> bool:
        """Replace stretches (i, j, new), in order and apart; each new character stands for all of its stretch."""
        if not edits:
            return False
        text, start, end, at = [], [], [], 0
        for i, j, new in edits:
            text.append(self.text[at:i])
            start += self.start[at:i]
            end += self.end[at:i]
            if new and j > i:
                text.append(new)
                start += [self.start[i]] * len(new)
                end += [self.end[j - 1]] * len(new)
            at = j
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(text), start, end
        return True

    def source(self, i: int, j: int) -> tuple[int, int]:
        return self.start[i], self.end[j - 1]


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝՕոսΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχɡıℓ",
    "ABESIJKMHOPCTYXaesijopcyxdhqwOnuABEZHIKMNOPTYXaiknopuxgil", strict=True))
INVISIBLE = "­​‌‍‎‏⁠﻿"
_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + INVISIBLE
                  + "²³¹٠-٩۰-۹०-९‐-―․⁰-₎"
                    "℀-⅏①-⓿。﹐-﹯＀-･\U0001d400-\U0001d7ff]")
_DASHES = re.compile("[‐-―﹘﹣－]")


def _plain_letter(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if _DASHES.match(c):
        return "-"
    if c in "。․":
        return "."
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    flat = unicodedata.normalize("NFKC", c)
    return flat if flat.isascii() else LOOK_ALIKES.get(flat, c)


def plain_letters(a: Aligned) -> bool:
    return a.rewrite([(m.start(), m.end(), _plain_letter(m.group())) for m in _ODD.finditer(a.text)])


# Digits as words, in the languages of the documents.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
MARKS = {"plus": "+", "dash": "-", "hyphen": "-", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
REPEATS = {"double": 2, "triple": 3}
_WORD = "|".join(sorted([*SPELLED, *MARKS, *REPEATS], key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_WORD})(?!\w)|[0-9+](?![^\W\d]))(?:[\s,.;()/-]{{0,3}}(?:(?:{_WORD})(?!\w)|[0-9]+(?![^\W\d])))+", re.I)
_SPELLED_PART = re.compile(rf"(?:{_WORD})(?!\w)|[0-9]+|\+", re.I)


def _spelled(run: str) -> tuple[str, int]:
    """The digits and marks of a run, and how many digits were spelled."""
    out, words, times = [], 0, 1
    for m in _SPELLED_PART.finditer(run):
        w = m.group().lower()
        if w in REPEATS:
            times = REPEATS[w]
        elif w in SPELLED:
            out.append(SPELLED[w] * times)
            words += times
            times = 1
        else:
            out.append(MARKS.get(w, w))
            times = 1
    return "".join(out), words


def _figures(run: str, apart: bool) -> Aligned:
    """A run with figures for its words.  Spelled digits in a row become one
    number; next to figures they keep what stands between (``apart``) or not."""
    a, edits, times, last = Aligned(run), [], 1, None
    for m in _SPELLED_PART.finditer(run):
        w = m.group().lower()
        if w in REPEATS:
            kind, new = "spelled", ""
        else:
            kind = "spelled" if w in SPELLED else "mark" if w in MARKS or w == "+" else "figures"
            new = SPELLED[w] * times if w in SPELLED else MARKS.get(w, w)
        if last and m.start() > last[1]:
            between = run[last[1]:m.start()]
            shut = "mark" in (kind, last[0]) or not apart or (kind == last[0] == "spelled" and "." not in between)
            edits.append((last[1], m.start(), "" if shut else re.sub(r"\s*-\s*", "-", re.sub(r"\s+", " ", between))))
        edits.append((*m.span(), new))
        times, last = REPEATS.get(w, 1), (kind, m.end())
    a.rewrite(edits)
    return a


def partly_spelled(run: str) -> list[Span]:
    """Identifiers in a run, however few of its digits are spelled: what the
    detectors find beside figures kept apart, and addresses with figures joined."""
    out = []
    for apart in (True, False):
        a = _figures(run, apart)
        out += [(k, *a.source(i, j)) for k, i, j in plain_spans(a.text) if apart or k == "ip"]
    return out


def spelled_digits(a: Aligned) -> tuple[list[Span], list[Span]]:
    """Rewrite runs of at least five spelled digits; also phone numbers spelled
    without a plus: 10 to 15 digits, all or nearly all of them words.  Second,
    what the detectors find in each run by itself."""
    edits, phones, partly = [], [], []
    for m in _SPELLED_RUN.finditer(a.text):
        digits, words = _spelled(m.group())
        # no identifier has fewer than four digits
        if words and sum(map(str.isdigit, digits)) >= 4:
            partly += [(k, *a.source(m.start() + i, m.start() + j)) for k, i, j in partly_spelled(m.group())]
        if words < 5:
            continue
        edits.append((*m.span(), digits))
        if digits.isdigit() and 10 <= len(digits) <= 15 and len(set(digits)) > 2 and words >= len(digits) - 3 and not (len(digits) >= 12 and luhn(digits)):
            phones.append(("phone", *a.source(*m.span())))
    a.rewrite(edits)
    return phones, partly


_NAME = r"[A-Za-z0-9][A-Za-z0-9_%+-]{0,63}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_OPEN, _CLOSE = r"\s{0,2}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,2}"
_AT_BOX = re.compile(rf"{_OPEN}(?:at|@|arroba){_CLOSE}", re.I)
_DOT_BOX = re.compile(rf"{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}", re.I)
_DOT = r"(?:\s{1,2}(?:dot|punkt|punto|point)\s{1,2}|\s{0,2}\.\s{0,2})"
_PHRASE = re.compile(rf"(?<![A-Za-z0-9]){_NAME}(?:(?:\s{{1,2}}dot\s{{1,2}}|\.){_NAME}){{0,4}}"
                     rf"(?:\s{{1,2}}(?:at|arroba|@)\s{{1,2}}|@){_LABEL}(?:{_DOT}{_LABEL}){{1,6}}", re.I)
_PHRASE_AT = re.compile(r"\s+(?:at|arroba|@)\s+|@", re.I)
_PHRASE_DOT = re.compile(r"\s+(?:dot|punkt|punto|point)\s+|\s*\.\s*", re.I)
_IP_WORDS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_ARTICLES = {"a", "an", "the", "this", "that", "my", "your", "his", "her", "its", "our", "their"}
_TOP_LEVEL = re.compile(r"\.[A-Za-z]{2,12}$")


def at_and_dot(a: Aligned) -> bool:
    done = a.rewrite([(*m.span(), "@") for m in _AT_BOX.finditer(a.text)])
    done |= a.rewrite([(*m.span(), ".") for m in _DOT_BOX.finditer(a.text)])
    edits = []
    for m in _PHRASE.finditer(a.text):
        name, host = _PHRASE_AT.split(m.group(), maxsplit=1)
        said = re.search(r"\s(?:dot|punkt|punto|point)\s", host, re.I) or re.search(r"\sdot\s", name, re.I)
        joined = f"{_PHRASE_DOT.sub('.', name)}@{_PHRASE_DOT.sub('.', host)}"
        if joined == m.group() or not _TOP_LEVEL.search(joined) or not _ARTICLES.isdisjoint(host.lower().split()):
            continue
        # a bare "at" alone is an ordinary word unless a dot is spelled or the name looks like an account
        if said or (" @ " in m.group() and re.search(r"\s\.\s", host)) or (re.search(r"[0-9._]", name) and "@" not in m.group() and not re.search(r"\s", host)):
            edits.append((*m.span(), joined))
    done |= a.rewrite(edits)
    return done | a.rewrite([(*m.span(), _PHRASE_DOT.sub(".", m.group())) for m in _IP_WORDS.finditer(a.text)
                             if re.search(r"\s(?:dot|punkt|punto|point)\s", m.group(), re.I)])


# what every pattern above needs at least: a dot word, an opened box, an at between blanks
_DOT_WORDS = ("dot", "punkt", "punto", "point", "arroba")
_DOT_WORD = re.compile("|".join(_DOT_WORDS), re.I)
_BOX_OR_AT = re.compile(r"[\[({<]\s{0,2}(?:at|@|\.)|\s(?:at|@)\s", re.I)


def _may_hide(text: str) -> tuple[bool, bool, bool]:
    """Could look-alikes, spelled digits, at/dot disguises be there?  Never a wrong no."""
    odd = not text.isascii() and _ODD.search(text) is not None
    low = text.lower()
    spelled = not SPELLED.keys().isdisjoint(re.split(r"\W+", low))
    at_dot = any(w in low for w in _DOT_WORDS) or _BOX_OR_AT.search(text) or (not text.isascii() and _DOT_WORD.search(text))
    return odd, spelled, bool(at_dot)


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only show after rewriting, on source characters."""
    odd, spelled, at_dot = _may_hide(text)
    if not (odd or spelled or at_dot):
        return []
    a, found, partly = Aligned(text), [], []
    if odd:
        plain_letters(a)
        odd, spelled, at_dot = True, True, True
    if spelled:
        found, partly = spelled_digits(a)
    if at_dot:
        at_and_dot(a)
    if a.text != text:
        found += [(k, *a.source(i, j)) for k, i, j in plain_spans(a.text)]
    taken: dict[str, list[tuple[int, int]]] = {k: sorted((i, j) for kk, i, j in plain if kk == k) for k in KINDS}
    out = []
    order = lambda s: (s[1], KINDS.index(s[0]), -s[2])
    for kind, i, j in sorted(found, key=order) + sorted(partly, key=order):
        # spans of a kind do not overlap: only the neighbours can
        held = taken[kind]
        at = bisect.bisect_left(held, (i, j))
        if not (at and held[at - 1][1] > i) and not (at < len(held) and held[at][0] < j):
            held.insert(at, (i, j))
            out.append((kind, i, j))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


_SCHEMA = ("id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: plain counts of each kind, the digest of the plain spans,
    all spans, and how many of them were disguised."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                plain = plain_spans(text)
                more = added_spans(text, plain)
                counts = [sum(s[0] == k for s in plain) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(plain + more), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                             ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, _SCHEMA)
