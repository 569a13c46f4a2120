"""Personal data, also behind homoglyphs, spelled digits and disguised at and dot.

Plain identifiers are found in the source. Three transducers then rewrite a text (look-alike characters to ASCII, invisible ones away;
runs of spelled digits to digits; disguised @ and . to themselves), each keeping for every character the source span it stands for; the
same detectors read the result, and spans that touch a rewritten character are mapped back and added.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwright.llm.common import chunks, release, text_buffer
from siftwright.llm.spans import Layer, Span, scan

KINDS = ["email", "ip", "card", "phone"]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and domain; a local part is what stands before an @, so the search goes from @ to @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part) < 4 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].translate(NOT_DIGITS)) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(m[0].translate(NOT_DIGITS)) <= 15:
                out.append(("phone", *m.span()))
    return out


# Look-alikes of ASCII letters in Cyrillic and Greek, invisible characters, digits as words.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοικνραΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。．｡﹒∙", "aeopcyxijsdhqwABEKMHOPCTYXIJSoikvpaABEZHIKMNOPTYX......", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SPELLED = {w: str(k) for names in DIGIT_WORDS.values() for k, w in enumerate(names.split())} | {"oh": "0"}
_digit = rf"(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})"
#: Three digit words in a row at least; a single "one" is a word.
DIGIT_RUN = re.compile(rf"(?i)\b(?:plus[\x20-]+)?{_digit}(?:[\x20,.-]{{1,2}}{_digit}){{2,}}\b")
DIGIT_WORD = re.compile(rf"(?i){_digit}")
#: Anything that might be a look-alike or invisible: the blocks of the above, full-width and mathematical forms.
ODD = re.compile("[­Ͱ-ϿЀ-ԯ​-‍․⁠∙。﹒﻿！-ﾟ\U0001d400-\U0001d7ff]")
_open, _close = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_at, _dot = "at|ät|arroba|arobase", "dot|punkt|punto|point"
BRACKETED_AT = re.compile(rf"(?i){_open}(?:{_at}|@){_close}")
BRACKETED_DOT = re.compile(rf"(?i){_open}(?:{_dot}|\.){_close}")
#: Words for @ and . without brackets count only together and in one language, as in "name at host dot com".
PAIRS = {"at": "dot", "ät": "punkt", "arobase": "point", "arroba": "punto"}
SPOKEN = {
    dot: re.compile(rf"(?i)(?<=[a-z0-9])(\s+{at}\s+)(?=([a-z0-9-]+(?:(?:\s+{dot}\s+|\.)[a-z0-9-]+)*\s+{dot}\s+[a-z]+))") for at, dot in PAIRS.items()
}
SPOKEN_DOT = {dot: re.compile(rf"(?i)(?<=[a-z0-9])\s+{dot}\s+(?=[a-z])") for dot in PAIRS.values()}
#: What a text holds wherever one of the above matches: the bracketed ones without the blank before, and the words for a dot.
BRACKETED = re.compile(rf"(?i){_open.removeprefix(r'\s?')}(?:{_at}|@|{_dot}|\.){_close}")
DOT_WORDS = {dot: re.compile(rf"(?i){dot}") for dot in PAIRS.values()}


def lookalikes(layer: Layer) -> Layer:
    edits = []
    for m in ODD.finditer(layer.text):
        ch = m[0]
        new = "" if ch in INVISIBLE else LOOKALIKES.get(ch) or unicodedata.normalize("NFKC", ch)
        if new != ch and new.isascii():
            edits.append((*m.span(), new))
    return layer.replaced(edits) if edits else layer


def spelled_digits(layer: Layer) -> Layer:
    """Digit words of a run become digits and what parts them goes; a run after "plus" starts with +."""
    edits = []
    for run in DIGIT_RUN.finditer(layer.text):
        words = list(DIGIT_WORD.finditer(layer.text, *run.span()))
        at = run.start()
        for k, w in enumerate(words):
            sign = "+" if k == 0 and w.start() > run.start() else ""
            edits.append((at, w.end(), sign + SPELLED[w[0].lower()]))
            at = w.end()
    return layer.replaced(edits) if edits else layer


def disguised_sign(text: str) -> bool:
    """Whether any transducer for @ and dot may find something."""
    return bool(BRACKETED.search(text)) or any(w.search(text) for w in DOT_WORDS.values())


def at_and_dot(layer: Layer) -> Layer:
    if not disguised_sign(layer.text):
        return layer
    edits = {(m.start(), m.end()): "@" for m in BRACKETED_AT.finditer(layer.text)}
    edits |= {(m.start(), m.end()): "." for m in BRACKETED_DOT.finditer(layer.text)}
    for dot, spoken in SPOKEN.items():
        for m in spoken.finditer(layer.text) if DOT_WORDS[dot].search(layer.text) else ():
            edits.setdefault(m.span(1), "@")
            for d in SPOKEN_DOT[dot].finditer(layer.text, *m.span(2)):
                edits.setdefault(d.span(), ".")
    kept, at = [], 0
    for (a, b), new in sorted(edits.items()):
        if a >= at:
            kept.append((a, b, new))
            at = b
    return layer.replaced(kept) if kept else layer


def disguised_spans(text: str) -> list[Span]:
    """Spans that only the rewritten text shows, as source offsets."""
    odd = not text.isascii() and ODD.search(text)
    if not odd and not DIGIT_RUN.search(text) and not disguised_sign(text):
        return []
    source = Layer.source(text)
    layer = at_and_dot(spelled_digits(lookalikes(source)))
    if layer is source:
        return []
    return [s for found in plain_spans(layer.text) if (s := layer.origin(found))]


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs (doc_id, text); see spans.scan."""
    return scan(docs, KINDS, plain_spans, disguised_spans)


def masked(text: str) -> str:
    """text with every span, plain or disguised, replaced by <KIND>; of spans that overlap, what the earlier leaves."""
    out, at = [], 0
    for kind, a, b in sorted({*plain_spans(text), *disguised_spans(text)}, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs, which has one column text, with that masked; null stays null, whole texts are read, all columns and their order are kept."""
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("pii")
        for batch in batches:
            _, offsets = text_buffer(batch.column(place))
            for a, b in chunks(offsets):  # rows of a batch may hold very much text
                part = batch.slice(a, b - a)
                texts = pa.array([None if t is None else masked(t) for t in part.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(part.columns)], batch.schema.names)

    return docs.mapInArrow(run, schema)
