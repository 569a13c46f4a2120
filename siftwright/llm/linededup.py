"""Removal of repeated passages by the digests of their units.

Texts are cut into units: sentences within lines, lines, or paragraphs; together they are the whole text. Each unit is normalised (ASCII
lower case, white space collapsed, its end mark off) and hashed, digests are grouped globally, and an occurrence is repeated if an earlier
one, by document id and position, has the same digest. What goes are runs of repeated units that hold LEAST characters or more together: a
short phrase that recurs by chance stays, while a passage goes wherever in a line it stands. Offsets are those of the source.

Of a digest that a task meets often only the earliest occurrence travels to its group, the others are known to be repeated. So a line that
very many documents share is a few rows for each task, and groups are read as sorted streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import release

#: Characters that a run of repeated units has at least; about twenty words.
LEAST = 100
#: Units that a task holds before it sends what it has found.
FLUSH = 300_000
#: Units, and the marks that end them and are no part of what is compared; what has no mark ends with the text.
UNITS = {
    "sentence": (re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+"), b".!?\n"),
    "line": (re.compile(r"[^\n]*\n|[^\n]+"), b"\n"),
    "paragraph": (re.compile(r"(?:[^\n]|\n(?!\n))*\n\n|(?:[^\n]|\n(?!\n))+"), b"\n"),
}


def units(text: str, unit: str = "sentence") -> list[tuple[int, int, bytes]]:
    """(start, end, normalised bytes) of the units of text; a unit without words is normalised to nothing."""
    out = []
    pattern, marks = UNITS[unit]
    for m in pattern.finditer(text):
        raw = m[0].encode("utf-8", "surrogatepass").lower()
        raw = raw[:-1] if raw[-1:] in marks else raw
        out.append((m.start(), m.end(), b" ".join(raw.split())))
    return out


def runs(own: list[tuple[int, int, bytes]], repeated: set[int], least: int) -> list[tuple[int, int]]:
    """First and last number of the runs of repeated units, blank ones between them included, that have least characters or more."""
    out, first, last, size = [], None, 0, 0

    def close() -> None:
        if first is not None and size >= least:
            out.append((first, last))

    for k, (_, _, norm) in enumerate(own):
        if k in repeated:
            first, last, size = k if first is None else first, k, size + len(norm.decode("utf-8", "surrogatepass"))
        elif norm:
            close()
            first, size = None, 0
    close()
    return out


def digests(docs: DataFrame, unit: str) -> DataFrame:
    """(h1, h2, doc_id, version, k, done) of the units with words of docs (doc_id, text, version); done ones are known to be repeated."""

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, known, version, k = (np.array(x) for x in zip(*held, strict=True))
        order = np.lexsort((k, version, doc, known, h2, h1))
        h1, h2, doc, known, version, k = (x[order] for x in (h1, h2, doc, known, version, k))
        done = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
        first = np.flatnonzero(~done)[np.cumsum(~done) - 1]
        same = (doc == doc[first]) & (known == known[first]) & (version == version[first]) & (k == k[first])  # whole repeated rows count as one
        keep = ~done | ~same
        spread = np.where(done, h1 ^ (doc * 0x9E3779B97F4A7C1 + k), h1)  # what is done goes anywhere
        for a in range(0, len(order), 50_000):
            own = np.flatnonzero(keep[a : a + 50_000]) + a
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread[own]), pa.array(h2[own]), pa.array(doc[own], mask=~known[own]), pa.array(version[own]), pa.array(k[own].astype(np.int32)), pa.array(done[own])],
                ["h1", "h2", "doc_id", "version", "k", "done"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("linededup")
        held: list[tuple] = []
        for batch in batches:
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True):
                for k, (_, _, norm) in enumerate(units(text or "", unit)):
                    if norm:
                        digest = hashlib.blake2b(norm, digest_size=16).digest()
                        held.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc or 0, doc is not None, version, k))
                if len(held) > FLUSH:
                    yield from sent(held)
                    held = []
        if held:
            yield from sent(held)

    return docs.select("doc_id", "version", "text").mapInArrow(run, "h1 long, h2 long, doc_id long, version long, k int, done boolean")


def later_ones(found: DataFrame) -> DataFrame:
    """(doc_id, version, k) of the units of digests() with an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # row of the digest's earliest place, in what was read before
        for batch in batches:
            names = ("h1", "h2", "doc_id", "version", "k")
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(c).fill_null(0).to_numpy() for c in names] + [known]
            done = batch.column("done").to_numpy(zero_copy_only=False)
            if not len(done):
                continue
            wait = np.flatnonzero(~done)
            if len(wait):
                own = [np.r_[[f], c[wait]] if first is not None else c[wait] for f, c in zip(first or columns, columns, strict=True)]
                new = np.r_[True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])]
                at = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = np.any([c != c[at] for c in own[2:]], axis=0)[len(own[0]) - len(wait) :]
                first = [c[at[-1]] for c in own]
                done = done.copy()
                done[wait] = later
            yield batch.filter(pa.array(done)).select(["doc_id", "version", "k"])

    ordered = found.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id", "version", "k")
    return ordered.mapInArrow(run, "doc_id long, version long, k int")


def dedup_units(docs: DataFrame, unit: str = "sentence", least: int = LEAST) -> DataFrame:
    """(doc_id, text, kept_text, n_units, n_removed, spans) of documents (doc_id, text).

    n_units counts all units, n_removed those in runs that go; spans is start:end of the runs in code points, comma-joined, in order. A
    null text has no unit and stays null; an empty one has none either. A null doc_id is before all others; rows that repeat a doc_id with
    another text rank by a hash of it, and whole repeated rows keep the same units. Very long texts are cut like others. Other columns are
    ignored, and an empty table gives an empty one. With least=1 every repeated unit goes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64("text"))
    removed = later_ones(digests(own, unit)).groupBy("doc_id", "version").agg(F.collect_set("k").alias("gone"))
    joined = own.join(removed.withColumnsRenamed({"doc_id": "r_doc", "version": "r_version"}), F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("version") == F.col("r_version")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = units(text or "", unit)
                found = runs(own, set(gone), least) if gone else []
                spans = [(own[a][0], own[b][1]) for a, b in found]
                cuts = [0, *(x for span in spans for x in span), len(text or "")]
                kept = text if not spans else "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((kept, len(own), sum(b - a + 1 for a, b in found), ",".join(f"{a}:{b}" for a, b in spans)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), *(pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                ["doc_id", "text", "kept_text", "n_units", "n_removed", "spans"],
            )

    return joined.select("doc_id", "text", "gone").mapInArrow(remove, "doc_id long, text string, kept_text string, n_units long, n_removed long, spans string")
