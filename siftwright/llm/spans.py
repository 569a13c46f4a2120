"""Texts with a way back to the source, for detectors that read normalised or decoded text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]


@dataclass
class Layer:
    """Character k of text stands for source characters starts[k] to ends[k]; changed[k] if it isn't simply a copy."""

    text: str
    starts: list[int]
    ends: list[int]
    changed: list[bool]

    @classmethod
    def source(cls, text: str) -> Layer:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def replaced(self, edits: Iterable[tuple[int, int, str]]) -> Layer:
        """With each (start, end, new) in place, in order and apart; all of new stands for all that it replaces."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            text.append(new)
            starts += [self.starts[a]] * len(new)
            ends += [max(self.ends[a:b])] * len(new)
            changed += [True] * len(new)
            at = b
        return Layer("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:])

    def origin(self, span: Span, only_changed: bool = True) -> Span | None:
        kind, a, b = span
        return (kind, min(self.starts[a:b]), max(self.ends[a:b])) if any(self.changed[a:b]) or not only_changed else None


def joined(spans: Iterable[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def scan(docs: DataFrame, kinds: list[str], base: Callable[[str], list[Span]], added: Callable[[str], list[Span]]) -> DataFrame:
    """(doc_id, a count per kind, base_sha256, spans) of each row of docs (doc_id, text).

    base finds the plain spans, which counts and base_sha256 are of; added finds more. A null text is empty; repeated rows have a row
    each; texts of any length are scanned whole; an empty table gives an empty one, and other columns are ignored.
    """
    names = [f"n_{k}" for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in kinds], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                plain = base(text)
                more = added(text)
                for k, c in zip(kinds, counts, strict=True):
                    c.append(sum(s[0] == k for s in plain))
                own = joined(plain, kinds)
                digests.append(hashlib.sha256(own.encode()).hexdigest())
                spans.append(joined([*plain, *more], kinds) if more else own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *names, "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string")
