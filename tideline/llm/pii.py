"""Personal data in whole texts, disguised or not, told by places in the source.

Addresses, network numbers, cards and phones are first found in the text as it stands. Then two transducers rewrite it:
the first turns look-alike characters into ASCII and drops invisible ones, the second turns spelled digits, written
signs and at and dot in words, brackets or entities into what they stand for. Each keeps the pieces it made with their
places in its input, so that a span of its output goes back to the source through both. What is found only in the
rewritten text is added: an address also where it extends one of the source (part of it was disguised), numbers only
where no span of their kind stood before.

Cases: a null text is empty and has no spans; repeated rows are searched each for itself; a row with a null id keeps
it; of spans that start together the order is that of KINDS; texts of any length are searched whole, in time linear in
their length for the patterns below (every run is scanned once); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")

#: Letters of other scripts that look like one of ASCII; compatibility forms (full width, bold and so on) follow from Unicode.
LOOK_ALIKES = dict(
    zip(
        "ЗзбАВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝѵɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυ٠۰०০٫․。．‐‑‒–—−﹣",
        "336ABESIJKMHOPCTXYaesijopcxyhdqwvgABEZHIKMNOPTYXavopu0000....-------",
    )
)
INVISIBLE = dict.fromkeys("­​‌‍‎‏⁠﻿️", "")
#: Digits as words, in the four languages.
SPELLED = {
    "zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
DIGIT_WORDS, AT_WORDS, DOT_WORDS = ({w.encode() for w in words} for words in (SPELLED, ("at", "ät", "arroba", "arobase"), ("dot", "punkt", "punto", "point")))
AT, DOT, OPEN, SHUT, GAP = "(?:at|ät|arroba|arobase)", "(?:dot|punkt|punto|point)", r"[\[({<]", r"[\])}>]", "(?: {1,3}|[_-])"
#: Spelled digits: two in a row or more, or beside a digit or a spelled dot. All patterns read lower-cased text.
RUN = re.compile(rf"\b{WORD}(?:(?:[ ,-]|, ){WORD})+\b|(?<=[0-9]){WORD}\b|(?<=[0-9][ -]){WORD}\b|(?<= dot ){WORD}\b|(?<=plus ){WORD}\b|(?<=\+){WORD}\b|\b{WORD}(?=[ -]?[0-9])|\b{WORD}(?= dot )")
RUN_WORD = re.compile(WORD)
PLUS = re.compile(rf"\bplus (?=[0-9]|{WORD}\b)")
#: An at needs brackets, or a disguised dot after the name that follows it, or else (where that dot is a plain one) what
#: looks like an account before it: parts joined by signs, or letters and then digits.
OPEN_AT = re.compile(rf"{OPEN} ?(?:{AT}|@) ?{SHUT}")
BARE_AT = re.compile(rf"{GAP}{AT}{GAP}(?=[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,9}}(?:{GAP}{DOT}{GAP}| {{0,3}}{OPEN} ?(?:{DOT}|\.) ?{SHUT}))")
PLAIN_AT = re.compile(rf"{GAP}{AT}{GAP}(?=[a-z0-9-]{{1,63}}\.[a-z0-9-])")
ACCOUNT = re.compile(rf"(?<![a-z0-9])[a-z0-9]+(?:[._%+-]+[a-z0-9]+)+\Z|(?<![a-z0-9])[a-z]+[0-9]+\Z|{GAP}{DOT}{GAP}[a-z0-9]+\Z")
OPEN_DOT = re.compile(rf"{OPEN} ?(?:{DOT}|\.) ?{SHUT}")
BARE_DOT = re.compile(rf"{GAP}{DOT}{GAP}")
ENTITY = {"@": re.compile("&#0*64;|&#x40;|&commat;|%40"), ".": re.compile("&#0*46;|&#x2e;|&period;|%2e")}
#: O and l among digits.
ROUND, STROKE = re.compile("[0-9](?=o[0-9])"), re.compile("[0-9](?=[il|][0-9])")
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BEYOND = re.compile("[^\x00-\xac\xae-ɏ]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Each @ with the run of letters, digits and signs before it that no earlier match holds, and a domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    """Each four parts of a dotted run of numbers."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in four)):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


class Rewritten:
    """A transducer's output, with the piece of input that each piece of it came from."""

    def __init__(self, source: str, changes: Iterable[tuple[int, int, str]]):
        out, self.starts, self.sources, self.kept, size, at = [], [], [], [], 0, 0
        for start, end, put in changes:
            for text, begins, ends, same in ((source[at:start], at, start, True), (put, start, end, False)):
                if text:
                    self._add(size, begins, ends, same)
                    out.append(text)
                    size += len(text)
            at = end
        self._add(size, at, len(source), True)
        self.text = "".join((*out, source[at:]))

    def _add(self, place: int, begins: int, ends: int, same: bool) -> None:
        self.starts.append(place)
        self.sources.append((begins, ends))
        self.kept.append(same)

    def back(self, start: int, end: int) -> Span:
        """The span of the input that made a span of the output (not an empty one)."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first = self.sources[i][0] + (start - self.starts[i] if self.kept[i] else 0)
        return first, self.sources[j][0] + end - self.starts[j] if self.kept[j] else self.sources[j][1]


def look_alike(char: str) -> str:
    """What a character beyond Latin letters is taken for: one of ASCII, nothing, or itself."""
    if (found := LOOK_ALIKES.get(char, INVISIBLE.get(char))) is not None:
        return found
    if (digit := unicodedata.decimal(char, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else char


def plain_letters(text: str) -> Iterator[tuple[int, int, str]]:
    if text.isascii():
        return
    for m in BEYOND.finditer(text):
        if (put := look_alike(m[0])) != m[0]:
            yield m.start(), m.end(), put


def lowered(text: str) -> str:
    """``text`` in lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def widened(text: str, start: int, end: int) -> Span:
    """A span with up to three spaces on either side."""
    before, after = text[max(0, start - 3) : start], text[end : end + 3]
    return start - len(before) + len(before.rstrip(" ")), end + len(after) - len(after.lstrip(" "))


def written_out(text: str) -> Iterator[tuple[int, int, str]]:
    """Changes that turn words and signs into the digits, @ and dots they stand for; a change that overlaps one before it is left out."""
    low = lowered(text)
    words, found = set(low.encode().translate(LETTERS).split()), []
    if words & DIGIT_WORDS:
        for m in RUN.finditer(low):
            last = m.start()
            for word in RUN_WORD.finditer(low, m.start(), m.end()):
                found.append((last, word.end(), SPELLED[word[0]]))
                last = word.end()
    if b"plus" in words:
        found += [(*m.span(), "+") for m in PLUS.finditer(low)]
    opened = any(c in low for c in "[({<")
    for sign, put in (("@", OPEN_AT), (".", OPEN_DOT)):
        if opened and (sign in low or words & (AT_WORDS if sign == "@" else DOT_WORDS)):
            found += [(*widened(low, *m.span()), sign) for m in put.finditer(low)]
        if "&" in low or "%" in low:
            found += [(*m.span(), sign) for m in ENTITY[sign].finditer(low)]
        at = low.find(f" {sign} ")
        while at >= 0:
            found.append((*widened(low, at + 1, at + 2), sign))
            at = low.find(f" {sign} ", at + 2)
    if words & AT_WORDS and (opened or words & DOT_WORDS):
        found += [(*m.span(), "@") for m in BARE_AT.finditer(low)]
    if words & AT_WORDS:
        found += [(*m.span(), "@") for m in PLAIN_AT.finditer(low) if ACCOUNT.search(low[max(0, m.start() - 64) : m.start()])]
    if words & DOT_WORDS:
        found += [(*m.span(), ".") for m in BARE_DOT.finditer(low)]
    for pattern, put in ((ROUND, "0"), (STROKE, "1")):
        found += [(m.end(), m.end() + 1, put) for m in pattern.finditer(low)]
    free = 0
    for start, end, put in sorted(found):
        if start >= free:
            yield start, end, put
            free = end


def known(spans: list[Span], start: int, end: int, extends: bool) -> bool:
    """Whether the ordered, disjoint ``spans`` hold a span whole, or (unless one may extend them) any of it."""
    i = bisect_right(spans, (end - 1, float("inf")))
    if not i or spans[i - 1][1] <= start:
        return False
    return not extends or spans[i - 1][0] <= start and end <= spans[i - 1][1]


def found_in(text: str) -> list[tuple[int, int, int, bool, str]]:
    """``start, kind (its place in KINDS), end, added, value`` of all spans of a text, in order; ``value`` is what was read."""
    base = {kind: list(find(text)) for kind, find in FINDERS.items()}
    out = [(s, k, e, False, text[s:e]) for k, kind in enumerate(KINDS) for s, e in base[kind]]
    letters = Rewritten(text, plain_letters(text))
    signs = Rewritten(letters.text, written_out(letters.text))
    if signs.text != text:
        for k, kind in enumerate(KINDS):
            for s, e in FINDERS[kind](signs.text):
                start, end = letters.back(*signs.back(s, e))
                if text[start:end] != signs.text[s:e] and not known(base[kind], start, end, kind == "email"):
                    out.append((start, k, end, True, signs.text[s:e]))
    return sorted(out)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: for each row the spans found, in order, as (kind, start, end, added, value); places in code points, ``end`` exclusive."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            spans = []
            for text in batch.column("text"):
                own = found_in(text.as_py() or "")
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "added": added, "value": value} for s, k, e, added, value in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind string, start int, end int, added boolean, value string>>"
    return rows.mapInArrow(run, ddl)


def span_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (spans of the text as it stands), ``base_sha256`` over those, ``spans`` (all) and ``n_added``."""
    rows = personal_data(docs)
    base = F.filter("spans", lambda s: ~s["added"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        F.col("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each personal span of ``text_col`` replaced by its kind in brackets; spans that overlap go as one, by the first."""

    def clean(text: str) -> str:
        out, at = [], 0
        for start, k, end, _, _ in found_in(text):
            if start >= at:
                out += [text[at:start], f"[{KINDS[k]}]"]
            at = max(at, end)
        return "".join((*out, text[at:]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [None if t.as_py() is None else clean(t.as_py()) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
