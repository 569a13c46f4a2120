"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every string of `length` bytes has an anchor: the place in it whose next GRAM bytes have the least hash (the first such place). Equal
strings have equal anchors, so strings are dealt to shards by the hash at their anchor and all that could match meet there. The strings
of one anchor lie side by side; together they are its neighbourhood, and only the bounds of neighbourhoods and their hashes travel.

In a shard, a neighbourhood whose bytes all occur before is wholly repeated; of those that repeat within one task only the earliest
travels, so a passage that very many documents share is a few records for each task. Neighbourhoods that share the anchor but not all of
their bytes match in part. Their bytes are sent to the shard's index family: in order of documents, each batch gets a suffix array of its
strings, is scanned against the levels that are there for matches of full length, and becomes a level itself; levels of equal size are
merged, so there are logarithmically many and every string is merged as often. A level is an array of places in the shard's text; strings
are gathered block by block to be compared. Matching strings go back to their documents as ranges.

Shards and buckets follow the counted size of the input, so that each fits a task's memory.

Documents that no range concerns, by a bitmap of bounded size, are never shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import checkpoint, chunks, mix64, release, text_buffer
from siftwright.llm.lzprint import powers

LENGTH, GRAM = 100, 36
#: Bytes hashed at a time, strings that make a batch of the index, notes that a task holds, bits of the bitmap of concerned documents.
CHUNK, BATCH, FLUSH, BITS = 1 << 19, 50_000, 500_000, 1 << 24
#: Bytes of text whose records make a shard, and whose notes make a bucket, on average.
SHARE = 1 << 23
#: Stands for a null doc_id, before all others.
NO_ID = -(2**63)

_bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

RECORD = [("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("ver", "<i4"), ("lo", "<i4"), ("wide", "u1")]
NOTE = [("doc", "<i8"), ("ver", "<i4"), ("lo", "<i4"), ("wide", "<i4"), ("kind", "u1")]
WHOLE, PART = 1, 2


def pack(columns: dict[str, np.ndarray], layout: list) -> bytes:
    """Columns one after the other; they compress better than rows."""
    return b"".join(np.ascontiguousarray(columns[name], kind).tobytes() for name, kind in layout)


def unpack(parts: list[bytes], layout: list) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in layout)
    out = {name: [] for name, _ in layout}
    for raw in parts:
        n, at = len(raw) // width, 0
        for name, kind in layout:
            out[name].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(out[name]) if out[name] else np.zeros(0, kind) for name, kind in layout}


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def neighbourhoods(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first string's start, last's minus it, anchor hash, hash of all bytes) of each neighbourhood; starts from the text's own."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < length:
        return none
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_bytes[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    places = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least((hashes >> np.uint64(32) << np.uint64(32)) | places, length - gram + 1)  # of each string
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    edge = valid.copy()
    edge[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    lo, hi = np.flatnonzero(edge), np.flatnonzero(last)
    if not len(lo):
        return none
    text = np.searchsorted(offsets, lo, "right") - 1
    at = anchor[lo]
    shape = mix64(((at - lo) + 1024 * (hi - lo)).astype(np.uint64))
    whole = mix64((sums[hi + length] - sums[lo]) * down[lo] + shape)
    return text, lo - offsets[text], hi - lo, hashes[at], whole


class SuffixFamily:
    """Levels of suffix arrays: places in one text, in the order of the `length` bytes there, each string once, the older the larger."""

    def __init__(self, text: np.ndarray, length: int = LENGTH):
        self.windows = np.lib.stride_tricks.sliding_window_view(text, length)
        self.levels: list[np.ndarray] = []

    def strings(self, places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.windows[places]).view(f"S{self.windows.shape[1]}").ravel()

    def add(self, places: np.ndarray) -> np.ndarray:
        """Whether the string at each place is in the family or at an earlier one of places; then they are in the family."""
        if not len(places):
            return np.zeros(0, bool)
        keys = self.strings(places)
        array = np.argsort(keys, kind="stable")  # the suffix array of the batch, cut at the length
        ordered = keys[array]
        first = np.ones(len(keys), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        distinct = ordered[first]
        known = np.zeros(len(distinct), bool)
        for level in self.levels:
            known |= self._scan(level, distinct)[1]
        repeated = np.empty(len(keys), bool)
        repeated[array] = ~first | known[np.cumsum(first) - 1]
        self._push(places[array][first][~known])
        return repeated

    def _scan(self, level: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted strings stand in a level, and whether they are there, by a scan of the one along the other."""
        rows, found = np.zeros(len(strings), np.int64), np.zeros(len(strings), bool)
        starts = np.arange(0, len(level), BATCH)
        cuts = np.r_[0, np.searchsorted(strings, self.strings(level[starts[1:]])), len(strings)].tolist()
        for start, a, b in zip(starts.tolist(), cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            block = self.strings(level[start : start + BATCH])
            at = np.searchsorted(block, strings[a:b])
            rows[a:b] = start + at
            found[a:b] = block[np.minimum(at, len(block) - 1)] == strings[a:b]
        return rows, found

    def _push(self, level: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            older = self.levels.pop()
            rows = [self._scan(older, self.strings(level[a : a + BATCH]))[0] for a in range(0, len(level), BATCH)]
            level = np.insert(older, np.concatenate(rows), level) if rows else older
        if len(level):
            self.levels.append(level)


def noted(found: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, payload) of notes, dealt by document."""
    bucket = (mix64(found["doc"].astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([pack({k: v[p] for k, v in found.items()}, NOTE) for p in parts], pa.binary())], ["bucket", "payload"])


def by_place(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((r["lo"], r["ver"], r["doc"], r["f"], r["h"]))
    return {k: v[order] for k, v in r.items()}


def equal_to_last(r: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    same = np.ones(len(r["h"]), bool)
    same[:1] = False
    for name in names:
        same[1:] &= r[name][1:] == r[name][:-1]
    return same


def as_notes(r: dict[str, np.ndarray], kind: np.ndarray | int) -> dict[str, np.ndarray]:
    return {"doc": r["doc"], "ver": r["ver"], "lo": r["lo"], "wide": r["wide"].astype(np.int32), "kind": np.broadcast_to(np.asarray(kind, np.uint8), len(r["doc"]))}


def records(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, done, payload) of the neighbourhoods of all documents, by the hash at their anchors.

    Of equal ones that a task meets, the earliest is a record and the others are notes already (done), dealt anywhere.
    """

    def sent(parts: list[dict[str, np.ndarray]], turn: int) -> Iterator[pa.RecordBatch]:
        r = by_place({name: np.concatenate([p[name] for p in parts]) for name, _ in RECORD})
        again = equal_to_last(r, ("f", "h"))
        others = again & ~equal_to_last(r, ("f", "h", "doc", "ver", "lo"))  # whole repeated rows count as one
        rows = []
        if others.any():
            rows.append((turn % shards, True, pack(as_notes({k: v[others] for k, v in r.items()}, WHOLE), NOTE)))
        r = {k: v[~again] for k, v in r.items()}
        shard = (r["h"] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        r = {k: v[order] for k, v in r.items()}
        cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)].tolist()
        rows += [(int(shard[order[a]]), False, pack({k: v[a:b] for k, v in r.items()}, RECORD)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["shard", "done", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("suffixfamily")
        parts, held, turn = [], 0, 0
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            docs_, vers = batch.column("doc_id").to_numpy(), batch.column("ver").to_numpy()
            turn = int(docs_[0]) & 0x7FFFFFFF if not turn and len(docs_) else turn
            for a, b in chunks(offsets, CHUNK):
                text, lo, wide, h, f = neighbourhoods(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                if len(h):
                    parts.append({name: x.astype(kind) for (name, kind), x in zip(RECORD, (h, f, docs_[a:b][text], vers[a:b][text], lo, wide), strict=True)})
                    held += len(h)
                if held > FLUSH:
                    yield from sent(parts, turn)
                    parts, held, turn = [], 0, turn + 1
        if parts:
            yield from sent(parts, turn)

    return docs.mapInArrow(run, "shard int, done boolean, payload binary")


def by_key(rows: DataFrame, key: str, parts: int, buckets: int, each: Callable[[list[bytes]], Iterator[dict[str, np.ndarray]]]) -> DataFrame:
    """Rows (bucket, payload) of the notes that each(payloads) finds for every key of rows (key, done, payload), and of those already done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("suffixfamily")
        at, held, found = None, [], []

        def sent(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            if found and (all_of_it or sum(len(x["doc"]) for x in found) > FLUSH):
                yield from noted({name: np.concatenate([x[name] for x in found]) for name, _ in NOTE}, buckets)
                found.clear()

        for batch in batches:
            for k, done, payload in zip(batch.column(key).to_pylist(), batch.column("done").to_pylist(), batch.column("payload"), strict=True):
                if k != at:
                    if held:
                        found.extend(each(held))
                        yield from sent(False)
                    at, held = k, []
                if done:
                    found.append(unpack([payload.as_py()], NOTE))
                else:
                    held.append(payload.as_py())
        if held:
            found.extend(each(held))
        yield from sent(True)

    schema = "bucket int, payload binary"
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def classify(payloads: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """Notes of the neighbourhoods that repeat: WHOLE if an earlier one is equal, PART if others share the anchor alone."""
    r = unpack(payloads, RECORD)
    payloads.clear()
    keys, inverse, counts = np.unique(r["h"], return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    if not len(some):
        return
    r = by_place({k: v[some] for k, v in r.items()})
    new_h, new_f = ~equal_to_last(r, ("h",)), ~equal_to_last(r, ("f", "h"))
    first = np.flatnonzero(new_f)[np.cumsum(new_f) - 1]
    later = (r["doc"] != r["doc"][first]) | (r["ver"] != r["ver"][first]) | (r["lo"] != r["lo"][first])
    kinds = np.add.reduceat(new_f, np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
    kind = np.where(later, WHOLE, np.where(kinds > 1, PART, 0)).astype(np.uint8)
    keep = np.flatnonzero(kind)
    if len(keep):
        yield as_notes({k: v[keep] for k, v in r.items()}, kind[keep])


def bitmap(rows: DataFrame) -> np.ndarray:
    """Bits set at the slots of rows (slot); a fixed number of bits."""
    position = F.col("slot") + 1
    found = rows.groupBy(F.bitmap_bucket_number(position).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found:
        at = (r["k"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def marked(slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def slot_of(docs: np.ndarray) -> np.ndarray:
    return (mix64(docs.astype(np.int64).view(np.uint64)) >> np.uint64(8)).astype(np.int64) % BITS


def concerned(notes: DataFrame, kinds: tuple[int, ...]) -> np.ndarray:
    """Bitmap of the documents with notes of these kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = unpack(batch.column("payload").to_pylist(), NOTE)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot_of(n["doc"][np.isin(n["kind"], kinds)])))], ["slot"])

    return bitmap(notes.mapInArrow(run, "slot long"))


def meet(docs: DataFrame, notes: DataFrame, bits: np.ndarray, buckets: int, parts: int, each: Callable, schema: str) -> DataFrame:
    """each() over rows (doc_id, ver, raw bytes, notes of it) of the documents that bits mark, next to the notes of their bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            keep = np.flatnonzero(marked(slot_of(ids), bits))
            if len(keep):
                raw, offsets = text_buffer(batch.column("text"))
                where = (mix64(ids[keep].astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                texts = [zlib.compress(raw[offsets[k] : offsets[k + 1]].tobytes(), 1) for k in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.ones(len(keep), np.int32)), pa.array(ids[keep]), pa.array(batch.column("ver").to_numpy()[keep]), pa.array(texts, pa.binary())], ["bucket", "part", "doc_id", "ver", "payload"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, held, n = None, [], None
        for batch in batches:
            for bucket, part, doc, ver, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "doc_id", "ver", "payload")), strict=True):
                if bucket != at:
                    at, held, n = bucket, [], None
                if part == 0:
                    held.append(payload)
                    continue
                if n is None:
                    n = unpack(held, NOTE)
                    order = np.argsort(n["doc"], kind="stable")
                    n = {k: v[order] for k, v in n.items()}
                a, b = np.searchsorted(n["doc"], [doc, doc], "left")[0], np.searchsorted(n["doc"], doc, "right")
                own = {k: v[a:b] for k, v in n.items()}
                own = {k: v[own["ver"] == ver] for k, v in own.items()}
                yield doc, ver, np.frombuffer(zlib.decompress(payload), np.uint8), own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(met(batches))

    sent = docs.mapInArrow(send, "bucket int, part int, doc_id long, ver int, payload binary")
    theirs = notes.select("bucket", F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("ver"), "payload")
    return sent.unionByName(theirs).repartition(parts, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(run, schema)


def result_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of RESULT for documents (doc_id, text): what is left of their UTF-8 bytes after repeated strings of `length` bytes go.

    A byte goes if a string that covers it also starts earlier, in a smaller doc_id or before in its own document. Null texts are empty;
    a null doc_id is before all others; rows that repeat a doc_id with another text rank by a hash of it, and whole repeated rows count as
    one and have the same result. Texts of any length are read whole; an empty table gives an empty one, and other columns are ignored.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("ver", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("int"))
    share = (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARE
    shards, buckets = max(64, 2 * parts, share), max(64, parts, share)
    notes = checkpoint(spark, by_key(records(own, shards, length), "shard", parts, buckets, classify))
    partly, touched = concerned(notes, (PART,)), concerned(notes, (WHOLE, PART))

    def contexts(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for shard, own_rows in rows.items():
                d, v, a, w, t = zip(*own_rows, strict=True)
                head = pack({"doc": np.array(d, np.int64), "ver": np.array(v), "lo": np.array(a), "wide": np.array(w), "kind": np.full(len(d), PART)}, NOTE)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([False]), pa.array([len(d).to_bytes(4, "little") + head + b"".join(t)], pa.binary())], ["shard", "done", "payload"])
            rows.clear()

        for doc, ver, raw, n in found:
            part = n["kind"] == PART
            for lo, wide in zip(n["lo"][part].tolist(), n["wide"][part].tolist(), strict=True):
                text = raw[lo : lo + wide + length]
                rows.setdefault(int(anchor_shard(text, shards, length)), []).append((doc, ver, lo, wide, text.tobytes()))
                held += len(text)
            if held > 32 * FLUSH:
                yield from sent()
                held = 0
        yield from sent()

    def index(payloads: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
        width = sum(np.dtype(k).itemsize for _, k in NOTE)
        heads, texts = [], []
        for raw in payloads:
            n = int.from_bytes(raw[:4], "little")
            heads.append(raw[4 : 4 + n * width])
            texts.append(np.frombuffer(raw, np.uint8, offset=4 + n * width))
        n, text = unpack(heads, NOTE), np.concatenate(texts)
        payloads.clear()
        heads, texts = [], []
        sizes = n["wide"].astype(np.int64) + length
        at = np.cumsum(sizes) - sizes
        order = np.lexsort((n["lo"], n["ver"], n["doc"]))
        same = np.r_[False, (np.diff(n["doc"][order]) == 0) & (np.diff(n["ver"][order]) == 0) & (np.diff(n["lo"][order]) == 0)]
        order = order[~same]  # whole repeated rows count as one
        family = SuffixFamily(text, length)
        counts = n["wide"][order].astype(np.int64) + 1
        cuts = np.searchsorted(np.cumsum(counts), np.arange(BATCH, counts.sum() + BATCH, BATCH))
        start = 0
        for stop in np.unique(np.minimum(cuts + 1, len(order))).tolist():
            own_order, own_counts = order[start:stop], counts[start:stop]
            which = np.repeat(np.arange(len(own_order)), own_counts)
            step = np.arange(len(which)) - np.repeat(np.cumsum(own_counts) - own_counts, own_counts)
            repeated = family.add(at[own_order][which] + step)
            begin = repeated & (np.r_[True, ~repeated[:-1]] | (step == 0))
            end = repeated & (np.r_[~repeated[1:], True] | (step == own_counts[which] - 1))
            a, b = np.flatnonzero(begin), np.flatnonzero(end)
            if len(a):
                source = own_order[which[a]]
                yield {"doc": n["doc"][source], "ver": n["ver"][source], "lo": n["lo"][source] + step[a], "wide": (b - a).astype(np.int32), "kind": np.full(len(a), WHOLE, np.uint8)}
            start = stop

    def finish(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, _, raw, n in found:
            whole = n["kind"] == WHOLE
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, n["lo"][whole], 1)
            np.add.at(depth, n["lo"][whole] + n["wide"][whole] + length, -1)
            gone = np.cumsum(depth[:-1]) > 0
            spans = int((gone & np.r_[True, ~gone[:-1]]).sum())
            rows.append((None if doc == NO_ID else doc, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            if len(rows) >= 1000:
                yield result_batch(rows)
                rows = []
        if rows:
            yield result_batch(rows)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            raw, offsets = text_buffer(batch.column("text"))
            rows = [
                (None if ids[k] == NO_ID else int(ids[k]), int(offsets[k + 1] - offsets[k]), 0, 0, hashlib.sha256(raw[offsets[k] : offsets[k + 1]]).hexdigest())
                for k in np.flatnonzero(~marked(slot_of(ids), touched)).tolist()
            ]
            if rows:
                yield result_batch(rows)

    partial = meet(own, notes, partly, buckets, parts, contexts, "shard int, done boolean, payload binary")
    ranges = checkpoint(spark, by_key(partial, "shard", parts, buckets, index))
    return meet(own, notes.unionByName(ranges), touched, buckets, parts, finish, RESULT).unionByName(own.mapInArrow(untouched, RESULT))


def anchor_shard(text: np.ndarray, shards: int, length: int, gram: int = GRAM) -> int:
    """The shard of a neighbourhood, from its bytes: any of its strings shows the anchor."""
    up, down = powers(len(text))
    sums = np.zeros(length + 1, np.uint64)
    np.cumsum(_bytes[text[:length]] * up[:length], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:-gram]) * down[: length - gram + 1])
    return int(hashes[np.argmin(hashes >> np.uint64(32))] % np.uint64(shards))
