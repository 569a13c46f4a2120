"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the longest known phrase plus one character, LZ78), and the set of phrases is hashed into
a minimum-hash signature: one hash per phrase picks a slot and a value, each slot keeps its least value, and empty slots borrow from the
next filled one. The share of equal slots estimates the overlap of two phrase sets, which is large when one text would compress well
given the other's dictionary.

Documents are compared with the next one in order of doc_id. A range partitioning with boundaries from one pass over the ids deals out
each text once; only the first row of every range is sent twice, to end the range before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import mix64

SLOTS = 128
#: An odd multiplier of polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
EMPTY = np.uint64(2**64 - 1)


def parse(text: str, known: dict[str, None], phrase: str = "") -> str:
    """Adds the phrases of text to known, in order; the phrase that is open at the end, which is known. phrase: one open at the start."""
    for ch in text:
        phrase += ch
        if phrase not in known:
            known[phrase] = None
            phrase = ""
    return phrase


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i < n at least; kept for texts of usual length."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size = max(1 << 17, 1 << n.bit_length())
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE))
    if size <= 1 << 22:
        _powers.update(up=up, down=down)
    return up, down


def phrase_hashes(phrases: list[str]) -> np.ndarray:
    """64-bit hashes of phrases, alike for equal phrases wherever they are."""
    if not phrases:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    points = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = powers(len(points))
    ends = np.cumsum(sizes)
    sums = np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)
    starts = ends - sizes
    return mix64((sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * down[starts])


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit values; without phrases all are 0xFFFF."""
    least = np.full(SLOTS, EMPTY)
    np.minimum.at(least, (hashes & np.uint64(SLOTS - 1)).astype(np.intp), hashes >> np.uint64(7))
    full = np.flatnonzero(least != EMPTY)
    if 0 < len(full) < SLOTS:  # an empty slot takes the next filled one's value, scrambled by the distance
        at = np.arange(SLOTS)
        source = full[np.searchsorted(full, at) % len(full)]
        gap = ((source - at) % SLOTS).astype(np.uint64)
        least = np.where(gap > 0, mix64(least[source] + gap * np.uint64(BASE)), least[source])
    return (mix64(least) >> np.uint64(48)).astype(">u2") if len(full) else np.full(SLOTS, 0xFFFF, ">u2")


def fingerprint(text: str) -> np.ndarray:
    known: dict[str, None] = {}
    parse(text, known)
    return signature(phrase_hashes(list(known)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


class Chain:
    """Rows of results for documents in order; each waits for the next one."""

    def __init__(self):
        self.last: tuple | None = None
        self.rows: list[tuple] = []

    def push(self, doc_id: int | None, text: str, whole: bool) -> None:
        """whole: the row has a result of its own; otherwise it only ends the one before."""
        if self.last is None and not whole:
            return
        known: dict[str, None] = {}
        keep = len(text) - len(text) // 4
        phrase = parse(text[:keep], known)
        head, head_phrase = (known.copy() if len(text) >= 4 else {}), phrase
        parse(text[keep:], known, phrase)
        own = signature(phrase_hashes(list(known)))
        if self.last is not None:
            self.emit(text, own)
        self.last = (doc_id, text, own, head, head_phrase, keep) if whole else None

    def emit(self, after: str, after_print: np.ndarray) -> None:
        doc_id, text, own, known, phrase, keep = self.last
        edit = after[: len(text) - keep]
        edited = text[:keep] + edit
        changed = own
        if edited != text:
            parse(edit, known, phrase)
            changed = signature(phrase_hashes(list(known)))
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        self.rows.append((doc_id, len(text), sha, own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, after_print)))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of SCHEMA for documents (doc_id, text): fingerprints of each text and of the text whose last quarter comes from the next.

    Null texts are empty; a text without phrases has the fingerprint of all f. A null doc_id comes first; repeated ids follow each other
    in the order of their texts; a single document is its own next one. Texts of any length are parsed whole, an empty table gives an empty
    one, and other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("cuts")).first()["cuts"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    def bucket_of(column: pa.Array) -> np.ndarray:
        """The number of cuts below each id; a null is in the first range."""
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, np.searchsorted(cuts, column.fill_null(0).to_numpy()), 0).astype(np.int32)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("doc_id")
            table = pa.table({"bucket": bucket_of(column), "doc_id": column, "none": column.is_null().cast(pa.int64())})
            found = table.group_by("bucket").aggregate([("doc_id", "min"), ("none", "sum")])
            yield from found.select(["bucket", "doc_id_min", "none_sum"]).rename_columns(["bucket", "first", "nulls"]).to_batches()

    # one row per range: at most as many as partitions
    ranges = ids.mapInArrow(summed, "bucket int, first long, nulls long").groupBy("bucket").agg(F.min("first").alias("first"), F.sum("nulls").alias("nulls"))
    firsts = sorted((r["bucket"], r["first"], r["nulls"]) for r in ranges.collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = {b: firsts[k - 1][0] for k, (b, _, _) in enumerate(firsts)}  # that of the first is the last: the order closes
    lead = {b: None if nulls else first for b, first, nulls in firsts}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its range, and those that open a range to the one before as well."""
        for batch in batches:
            bucket = bucket_of(batch.column("doc_id"))
            opens = [k for k, (b, d) in enumerate(zip(bucket.tolist(), batch.column("doc_id").to_pylist(), strict=True)) if lead[b] == d]
            rows = [batch, batch.take(pa.array(opens, pa.int64()))]
            to = [bucket, np.array([before[b] for b in bucket[opens].tolist()], np.int32)]
            for own, b, whole in zip(rows, to, (True, False), strict=True):
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(b), pa.array(np.full(len(b), whole))], ["doc_id", "text", "bucket", "whole"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, "doc_id long, text string, bucket int, whole boolean")
    ordered = dealt.repartitionByRange(len(firsts) if len(firsts) > 1 else 1, "bucket").sortWithinPartitions("bucket", F.desc("whole"), F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, at, closed = Chain(), None, False
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for b, doc_id, text, whole in zip(*(batch.column(c) for c in ("bucket", "doc_id", "text", "whole")), strict=True):
                if at != b.as_py():
                    chain.last, at = None, b.as_py()
                chain.push(doc_id.as_py(), text.as_py(), whole.as_py())
            if chain.rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*chain.rows, strict=True), types, strict=True)], names)
                chain.rows = []

    return ordered.mapInArrow(run, SCHEMA)
