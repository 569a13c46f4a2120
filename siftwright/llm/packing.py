"""Packing by minimum bin slack.

Each document becomes token ids plus an end id. Its leading whole windows are sequences of their own; what remains, shorter than a
window, is packed whole. The planner sees the histogram of remaining lengths alone (fewer entries than the window has tokens, however
many documents there are). For the longest length left it finds, with a bitset of reachable sums, the multiset of other lengths that
leaves least slack, reads the counts back from the stored bitsets, and repeats that filling as often as the histogram allows, so that
every step uses up a length. Pieces then find their sequence from their rank among the pieces of their length.

Ranks are dealt in salted buckets (hash of the document id), so a length that a third of the documents share is not one task's work.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.llm.common import checkpoint, hold, release

WINDOW = 4096
#: Id that ends every document.
END_ID = 2
#: Words and stems whose ids a worker remembers (about 200 bytes each); beyond it the memory starts anew, so results don't depend on it.
WORD_MEMORY, STEM_MEMORY = 400_000, 400_000
#: ASCII punctuation without the apostrophe, which starts contractions.
TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [shown[b] for b in range(256)]


class WordEncoder:
    """Ids of whole texts for a tokenizer that lower-cases, drops white space and never joins what white space parts.

    Words are encoded once. A word is a stem and a tail of ASCII punctuation; after a letter or digit such a tail is always a token run
    of its own. Stems of Latin letters alone are one word of the model, which skips the normaliser and the splitter.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        if (found := self.stems.get(part)) is None:
            if part.isalpha() and max(part) < "\u0250" and part == part.lower() and unicodedata.is_normalized("NFC", part):
                ids = [x.id for x in self.model.tokenize(part if part.isascii() else "".join([self.letters[b] for b in part.encode()]))]
            else:
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            found = self.stems[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(TAIL)
        if not stem or "<|" in word or stem[-1] >= "\u0100" or not stem[-1].isalnum():  # elsewhere a small letter may end in a mark
            return self._part(word)
        low = stem.lower() if max(stem) < "\u0100" else stem
        return self._part(low) + self._part(word[len(stem) :])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        known, words = self.known, text.replace("\n", " ").split(" ")
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > WORD_MEMORY:
                known.clear()
            if len(self.stems) > STEM_MEMORY:
                self.stems = {"": b""}
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, whichever tasks it runs."""
    return WordEncoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_tokens, full: crc32 of each leading whole window, rest, rest_crc) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("packing")
        encode, end, width = encoder(tokenizer_path).encode, struct.pack("<I", END_ID), 4 * window
        hold("packing", encoder.cache_clear)
        for batch in batches:
            total, full, rest, rest_crc = [], [], [], []
            for value in batch.column("text"):
                ids = encode(value.as_py() or "") + end
                cut = len(ids) // width * width
                total.append(len(ids) // 4)
                full.append([zlib.crc32(ids[i : i + width]) for i in range(0, cut, width)])
                rest.append((len(ids) - cut) // 4)
                rest_crc.append(zlib.crc32(ids[cut:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(rest_crc, pa.int64())],
                ["doc_id", "doc_tokens", "full", "rest", "rest_crc"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, full array<long>, rest int, rest_crc long")


def fill(lengths: list[int], counts: dict[int, int], room: int, exact: set[int]) -> dict[int, int]:
    """Counts of lengths, longest first, whose sum leaves least of room; a sum in exact leaves nothing either.

    Bit s of a layer is set if the layers so far can make the sum s. The search ends with the first layer that makes room itself.
    """
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        most = min(counts[length], room // length)
        step = 1
        while most > 0 and not reach >> room & 1:  # a bounded count as parts of 1, 2, 4, ... and a remainder
            step_now = min(step, most)
            before = reach
            reach |= reach << (step_now * length) & mask
            layers.append((length, step_now, before))
            most -= step_now
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total < room and (free := [s for s in exact if s <= room and reach >> s & 1]):
        total = max(free)
    picked: dict[int, int] = {}
    for length, times, before in reversed(layers):
        if not before >> total & 1:
            picked[length] = picked.get(length, 0) + times
            total -= times * length
    return picked


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, times in a sequence, first sequence, offset in it), and the number of sequences."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    powers = {1 << k for k in range(window.bit_length())}
    rows, sequences = [], 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        picked = fill(lengths, counts, window - longest, {p - longest for p in powers if p >= longest})
        counts[longest] += 1
        picked[longest] = picked.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in picked.items())
        offset = 0
        for length, n in sorted(picked.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, sequences, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequences += times
        lengths = [x for x in lengths if counts[x]]
    return rows, sequences


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A null or empty text is the end id alone, a text of more than a window several pieces. Repeated rows are packed once each. Without
    documents the result is empty. Other columns are ignored, whatever their names. sequence_id is unique but has gaps.
    """
    docs = checkpoint(spark, tokenised(docs, tokenizer_path or default_tokenizer(), window))
    histogram = {r["rest"]: r["count"] for r in docs.filter("rest > 0").groupBy("rest").count().collect()}  # under `window` rows
    rows, sequences = plan(histogram, window)
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 6)
    buckets = max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("rest").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            _, first, _, times, sequence, offset = table[np.searchsorted(key, length << 40 | rank, "right") - 1].T
            tokens = batch.column("doc_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (tokens - length, length)), batch.column("rest_crc"), batch.column("doc_tokens"), *(pa.array(x, pa.int64()) for x in (sequence + (rank - first) // times, offset + (rank - first) % times * length))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    rest = docs.filter("rest > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "rest_crc"), F.lit(buckets)).cast("int"))
    counts = rest.groupBy("rest", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("doc_id", "rest_crc")) - 1
    ranked = rest.withColumn("own", own).join(counts.select("rest", "bucket", "before"), ["rest", "bucket"])
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = ranked.select("doc_id", "doc_tokens", "rest", "rest_crc", (F.col("before") + F.col("own")).alias("rank")).mapInArrow(place, schema)
    whole = (
        docs.select("doc_id", "doc_tokens", F.posexplode("full").alias("k", "ids_crc32"))
        .select(
            "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    return placed.unionByName(whole)
