"""Secrets, also inside URL, Unicode and base64 encodings and compressed data, nested at will.

A worklist starts with the source. Each layer is scanned, then unwrapped: escapes are rewritten in place, every base64 run is a layer of its
own, and so is what a compressed stream in it holds, however often it was compressed. Bytes that aren't UTF-8 are replaced, one by one.
Layers carry the source span of each character, so hits map back through all of them. A layer whose text was seen before at the same place
isn't unwrapped again, which ends cycles; the list ends when no layer yields a new one.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import io
import itertools
import lzma
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame

from siftwright.llm.spans import Layer, Span, scan

KINDS = ["assign", "access", "hex"]

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a whole run: none of its characters can start a shorter match first

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ESCAPED = re.compile(r"\\[ux]([0-9A-Fa-f]+)|&#[0-9]+;|&#[xX][0-9A-Fa-f]+;")
#: Sixteen characters hold twelve bytes, the shortest secret.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Bytes that a compressed stream is unfolded by.
BLOCK = 1 << 20
#: Characters that patterns and encodings are made of; a text may be cut after any other.
JOINED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\&#;"
ODD_BYTE = re.compile("[\udc80-\udcff]")


def plain_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def url_edits(text: str) -> list[tuple[int, int, str]]:
    """Each percent-coded character in place; runs that aren't UTF-8 stay."""
    edits = []
    for m in URL.finditer(text):
        try:
            decoded = bytes.fromhex(m[0].replace("%", "")).decode()
        except UnicodeDecodeError:
            continue
        at = m.start()
        for ch in decoded:
            width = 3 * len(ch.encode())
            edits.append((at, at + width, ch))
            at += width
    return edits


def escape_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in ESCAPE.finditer(text):
        for m in ESCAPED.finditer(run[0]):
            ch = chr(int(m[1], 16)) if m[1] else html.unescape(m[0])
            if not 0xD800 <= ord(ch[:1] or "\0") < 0xE000:  # half of a pair alone is no character
                edits.append((run.start() + m.start(), run.start() + m.end(), ch))
    return edits


def decompressor(raw: bytes):
    """What reads the compressed stream that raw starts like; None if it starts like none."""
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and int.from_bytes(raw[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=1 << 27) if raw[:6] == b"\xfd7zXZ\0" else None


def unfolded(source: BinaryIO) -> Iterator[bytes]:
    """Blocks of what the compressed streams one after the other in source hold and of what follows them; as far as they are sound."""
    data = source.read(BLOCK)
    try:
        while (stream := decompressor(data)) is not None:
            while not stream.eof:
                out = stream.decompress(data, BLOCK)
                data = getattr(stream, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not data and not stream.eof and not (data := source.read(BLOCK)):
                    return
            data = stream.unused_data or data
            if len(data) < 6:
                data += source.read(BLOCK)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return
    while data:
        yield data
        data = source.read(BLOCK)


def text_blocks(blocks: Iterable[bytes]) -> Iterator[str]:
    """The text of blocks of bytes, parted after characters that no pattern and no encoding reaches across."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), []
    for block in blocks:
        text = decoder.decode(block)
        if end := len(text.rstrip(JOINED)):
            yield "".join([*held, text[:end]])
            held = []
        held.append(text[end:])
    yield "".join([*held, decoder.decode(b"", True)])


def stream_texts(raw: bytes) -> Iterator[str]:
    """Blocks of the text that a compressed stream holds; streams in it are unfolded again until none is left or one comes back."""
    source, seen = io.BytesIO(raw), {hashlib.blake2b(raw, digest_size=16).digest()}
    while True:
        blocks, head = unfolded(source), b""
        while len(head) < 6 and (more := next(blocks, b"")):
            head += more
        blocks = itertools.chain([head], blocks)
        if decompressor(head) is None:
            yield from text_blocks(blocks)
            return
        source, digest = tempfile.SpooledTemporaryFile(1 << 24), hashlib.blake2b(digest_size=16)
        for block in blocks:
            source.write(block)
            digest.update(block)
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        source.seek(0)
        yield from text_blocks(iter(lambda: source.read(BLOCK), b""))  # it may only look like a stream  # noqa: B023
        source.seek(0)


def base64_bytes(run: str) -> bytes | None:
    run = run.rstrip("=")
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4)) if len(run) % 4 != 1 else None
    except binascii.Error:
        return None


def readable(raw: bytes) -> str:
    """raw as text; a byte that is no UTF-8 is a lone surrogate."""
    return raw.decode("utf-8", "surrogateescape")


def promising(text: str) -> bool:
    """Whether text holds a secret or may be encoded again."""
    return bool(URL.search(text) or ESCAPE.search(text) or BASE64.search(text) or plain_spans(text))


def base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        if (raw := base64_bytes(m[0])) is None:
            continue
        a, b = m.span()
        if decompressor(raw) is not None:  # a compressed character comes from all of the stream
            first, last = min(layer.starts[a:b]), max(layer.ends[a:b])
            for text in stream_texts(raw):
                if promising(text):
                    yield Layer(text, [first] * len(text), [last] * len(text), [True] * len(text))
        if promising(text := readable(raw)):
            starts, ends, at = [], [], 0
            for ch in text:
                till = at + (1 if ODD_BYTE.match(ch) else len(ch.encode()))
                one, two = a + at * 4 // 3, min(b, a - (-till * 4 // 3))
                starts.append(min(layer.starts[one:two]))
                ends.append(max(layer.ends[one:two]))
                at = till
            yield Layer(ODD_BYTE.sub("\ufffd", text), starts, ends, [True] * len(text))


def wrapped(text: str) -> bool:
    """Whether anything in text might be encoded; cheap, as almost no text is."""
    if "%" in text and URL.search(text) or ("\\" in text or "&#" in text) and ESCAPE.search(text):
        return True
    return any((raw := base64_bytes(m[0])) is not None and (decompressor(raw) is not None or promising(readable(raw))) for m in BASE64.finditer(text))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers that layer holds, one after the other."""
    for edits in (url_edits(layer.text), escape_edits(layer.text)):
        if edits:
            yield layer.replaced(edits)
    yield from base64_layers(layer)


def nested_spans(text: str) -> list[Span]:
    """Spans found under at least one encoding, as source offsets."""
    if not wrapped(text):
        return []

    def key(layer: Layer) -> tuple[bytes, int, int]:
        return hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.starts[0], layer.ends[-1]

    source = Layer.source(text)
    work, seen, out = [unwrapped(source)], {key(source)}, set()
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif new.text and (k := key(new)) not in seen:
            seen.add(k)
            out.update(s for span in plain_spans(new.text) if (s := new.origin(span)))
            work.append(unwrapped(new))
    return list(out)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs (doc_id, text); see spans.scan."""
    return scan(docs, KINDS, plain_spans, nested_spans)
