"""Exact Jaccard join of word shingle sets in metric space, and the groups its links form.

Jaccard distance is a metric, and the pivots of this join are single shingles: a document that holds the shingle is at distance 1 - 1/n
of that pivot, any other at distance 1. Taking pivots in one global order, a document's Voronoi region is that of the first shingle it
holds. The triangle inequality bounds how far a partner's region can be: at distance t at most t * n shingles are missing, so a document
is replicated to the regions of its first n - ceil((1 - t) * n) + 1 shingles and no others, and every pair within t meets in a region.
The order goes by the number of documents that hold a shingle, counted over all, so that chance and common passages open few regions.

Regions with the same members are one. A large region is split again: into shells by the distance from the empty set, with the shell next
to each, and those into blocks that meet in pairs. Within a part, documents run in order of size; what can be shared after the places of
the region's shingle, and counts of shingles by hash part, coarse and then fine, bound the similarity from above. Two documents are
compared in one part only: that of the first region they have in common, as each brings the regions before. What is left is verified on
the whole sets. Regions are joined recursively: at first each document meets its nearest neighbours of other groups, links that hold
merge groups, regions of one group drop out, and what is left is joined in full. So a group of very many near copies costs a few pairs for
each, and still no two documents that link stay apart. Equal sets are one node from the start.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.llm.common import checkpoint, chunks, hold, mix64, release, text_buffer
from siftwright.llm.components import components
from siftwright.llm.lzprint import powers
from siftwright.llm.suffixfamily import bitmap, marked, slot_of

WIDTH = 4
#: Links have 100 * intersection >= LEAST * union.
LEAST = 85
#: Shingles in the lowest part of the hash space, in which nearly all prefixes end, are ordered by how many documents hold them.
LOW_SHARE = 1.2
#: Nearest documents of other groups that each meets in a region, round by round (at last all that may link), out of so many before it.
ROUNDS, RECENT = (3, None), 256
#: Members of a region, or of a part of one, that are compared in one task.
LARGE = 2048
#: Parts of the counts that are compared first, and the fine count that may be larger.
COARSE, FULL = 64, 15

_bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_bytes[0x41:0x5B] = _bytes[0x61:0x7B]
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts between offsets, and the number of its text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_space[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | fresh[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_bytes[raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; one hash of all words if they are fewer than width."""
    words, owner = word_hashes(raw, offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(owner, np.arange(n + 1))
    shingles = mix64(words + np.uint64(width))
    for k in range(1, width):
        shingles = mix64(shingles[: len(words) - k] + mix64(words[k:] + np.uint64(k))) if len(words) > k else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix64(np.array([h + w]))[0]
            out.append(np.array([h]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(batch: pa.RecordBatch, width: int = WIDTH) -> Iterator[np.ndarray]:
    raw, offsets = text_buffer(batch.column("text"))
    for a, b in chunks(offsets):
        yield from shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def prefix_size(n: int, least: int = LEAST) -> int:
    return n - (least * n + 99) // 100 + 1 if n else 0


def parts_of(n: int) -> int:
    """Parts of the hash space that the shingles of a set are counted by, a power of two; one or two shingles each."""
    return 1 << min(15, max(6, (n // 2).bit_length()))


def counted(shingles: np.ndarray, parts: int, most: int) -> np.ndarray:
    counts = np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
    return np.minimum(counts, most).astype(np.uint8)


def profile(shingles: np.ndarray) -> bytes:
    """Counts of shingles by COARSE parts of the hash space, a byte each, and by fine ones, four bits each; the most stands for more, too."""
    fine = counted(shingles, parts_of(len(shingles)), FULL)
    return counted(shingles, COARSE, 255).tobytes() + (fine[0::2] | fine[1::2] << 4).tobytes()


def counts_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The coarse and fine counts of a profile; there are no fine ones if only its first part is given."""
    raw = np.frombuffer(packed, np.uint8)
    return raw[:COARSE], np.column_stack([raw[COARSE:] & 15, raw[COARSE:] >> 4]).ravel()


def folded(counts: np.ndarray, parts: int) -> np.ndarray:
    """Fine counts by fewer parts; one that may be larger stays FULL or more."""
    return np.minimum(counts.reshape(-1, parts).sum(0, dtype=np.int64), 255).astype(np.uint8)


def difference(many: np.ndarray, one: np.ndarray, full: int) -> np.ndarray:
    """At least so many shingles are in one of two sets alone, by their counts; counts of full or more, which may be larger, say nothing."""
    apart = np.abs(many.astype(np.int16) - one.astype(np.int16))
    return np.where((many >= full) | (one >= full), 0, apart).sum(1, dtype=np.int64)


def low_bound(least: int) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(LOW_SHARE * (100 - least) / 100 * 2**64)))


def described(docs: DataFrame, width: int, least: int) -> DataFrame:
    """(doc_id, n, digest, n_low, head, profile): head is the n_low low shingles, and as many others as the prefix may need."""
    low = low_bound(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("jaccardjoin")
        for batch in batches:
            n, digest, n_low, head, counts = [], [], [], [], []
            for s in sets_of(batch, width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                n_low.append(int(np.searchsorted(s, low)))
                head.append(s[: max(n_low[-1], prefix_size(len(s), least))].tobytes())
                counts.append(profile(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(n_low, pa.int64()), *(pa.array(x, pa.binary()) for x in (head, counts))],
                ["doc_id", "n", "digest", "n_low", "head", "profile"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, n_low long, head binary, profile binary")


def memberships(nodes: DataFrame, least: int) -> DataFrame:
    """(region, node, place) of the regions with two nodes or more; regions of the same nodes are one, their first in the order.

    The order of shingles: low ones that one node alone holds, other low ones by the number of nodes that hold them, the rest by hash.
    place is the number of a node's shingles that come before the region's.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("head").to_pylist()], np.int64)
            if not sizes.sum():
                continue
            keys = np.frombuffer(b"".join(batch.column("head").to_pylist()), np.int64)
            index = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            late = np.where(index >= np.repeat(batch.column("n_low").to_numpy(), sizes), index, -1)
            owner = np.repeat(batch.column("node").to_numpy(), sizes)
            for a in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (keys, owner, late.astype(np.int32))], ["key", "node", "late"])

    held = nodes.select("node", "n_low", "head").mapInArrow(explode, "key long, node long, late int")
    often = held.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    shared = held.join(often, "key")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("late", "often", "key"))).withColumn("n_shared", F.sum(F.expr("int(late < 0)")).over(Window.partitionBy("node")))
    prefix = nodes.select("node", "n_low", F.expr(f"n - ceil({least} * n / 100) + 1").alias("size"))
    placed = ranked.join(prefix, "node").select("key", "node", "often", F.expr("late >= 0").alias("high"), F.expr("if(late < 0, n_low - n_shared + rank - 1, late)").cast("int").alias("place"), "size").filter("place < size").drop("size")
    placed = placed.select("key", "node", "place", F.struct("high", F.expr("if(high, 0, often)").alias("often"), "key").alias("order"))
    alike = placed.groupBy("key").agg(F.count("*").alias("count"), F.min("order").alias("order"), *(F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"sum{k}") for k in (1, 2))).filter("count > 1")
    firsts = alike.groupBy("count", "sum1", "sum2").agg(F.min("order").alias("order")).select("order.key")
    return placed.join(firsts, "key").select(F.col("key").alias("region"), "node", "place")


class Region:
    """Members of a region whose counts have the same parts, in order of size; those from first to last may still link with a later one."""

    FIELDS = ("nodes", "sizes", "groups", "places", "visits", "sides", "coarse", "fine")

    def __init__(self, parts: int, low: int, high: int):
        self.parts, self.crossed, self.first, self.last, self.gone = parts, low < high, 0, 0, 0
        self.nodes, self.sizes, self.groups, self.places = (np.zeros(16, np.int64) for _ in range(4))
        self.visits, self.sides = np.zeros(16, bool), np.zeros(16, bool)
        self.coarse, self.fine = np.zeros((16, COARSE), np.uint8), np.zeros((16, parts), np.uint8)
        self.earlier: dict[int, array] = {}  # the members of each region before, counted with those that are gone

    def forget(self, n: int, least: int) -> None:
        self.first += int(np.searchsorted(self.sizes[self.first : self.last], -(-least * n // 100)))

    def met(self, before: list[int], others: np.ndarray) -> np.ndarray:
        """Which of the others are also members of one of the regions before."""
        out = np.zeros(self.last, bool)
        for region in before:
            if region in self.earlier:
                at = np.frombuffer(self.earlier[region], np.int64) - self.gone
                out[at[np.searchsorted(at, self.first) :]] = True
        return out[others]

    def near(self, n: int, label: int, place: int, visit: bool, side: bool, coarse: np.ndarray, fine: np.ndarray, before: list[int], least: int, most: int | None) -> np.ndarray:
        """Nodes of other groups that may share enough shingles; the nearest of recent ones if only `most` are asked for.

        Only those that are compared here: the region is the first that a pair has in common, so the shingles before their places aren't
        shared; two that visit this shell are compared in their own, and two of one block where only that block is.
        """
        start = self.first if most is None else max(self.first, self.last - RECENT)
        own = slice(start, self.last)
        shared = np.minimum(self.sizes[own] - self.places[own], n - place)
        here = (self.groups[own] != label) & ((100 + least) * shared >= least * (self.sizes[own] + n))
        if visit:
            here &= ~self.visits[own]
        if self.crossed:
            here &= self.sides[own] != side
        others = start + np.flatnonzero(here)
        if len(others) and before:
            others = others[~self.met(before, others)]
        apart = np.zeros(0)
        for counts, one, full in ((self.coarse, coarse, 255), (self.fine, fine, FULL)):
            if not len(others):
                return self.nodes[others]
            if not len(one):
                continue
            apart = difference(counts[others], one, full)
            keep = (100 + least) * apart <= (100 - least) * (self.sizes[others] + n)
            others, apart = others[keep], apart[keep]
        if most is not None and len(others) > most:
            others = others[np.argpartition(apart, most - 1)[:most]]
        return self.nodes[others]

    def hold(self, before: list[int], *member) -> None:
        if self.last == len(self.nodes):  # what is forgotten makes room, or the room doubles
            own, size = slice(self.first, self.last), max(16, 2 * (self.last - self.first))
            for name in self.FIELDS:
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), old.dtype)
                new[: self.last - self.first] = old[own]
                setattr(self, name, new)
            self.first, self.last, self.gone = 0, self.last - self.first, self.gone + self.first
        for name, value in zip(self.FIELDS, member, strict=True):
            getattr(self, name)[self.last] = value
        for region in before:
            self.earlier.setdefault(region, array("q")).append(self.gone + self.last)
        self.last += 1


def split(members: DataFrame, least: int) -> DataFrame:
    """members (region, n, node, ...) with the shells and blocks of a region that each is in, so that no part of one is large.

    A region of more than LARGE members is cut into shells by their distance from the empty set, which is their size: partners are in the
    same shell or the next one. A shell that is still large is cut into blocks by hash, and every pair of blocks meets. So every pair that
    may link meets in some part, and parts are regions of their own. visit tells that the shell is not the member's own but the next, and
    side that its block is the higher one of two.
    """
    width = float(np.log(100 / least)) * 1.001
    large = members.groupBy("region").agg(F.count("*").alias("size")).filter(F.col("size") > LARGE)
    shell = F.floor(F.log(F.col("n")) / width).cast("int")
    at = lambda shell, visit: F.struct(shell.alias("shell"), F.lit(visit).alias("visit"))
    shells = F.when(F.col("size").isNull(), F.array(at(F.lit(-1), False))).otherwise(F.array(at(shell, False), at(shell + 1, True)))
    both = members.join(large, "region", "left").withColumn("in", F.explode(shells)).select(*members.columns, "in.shell", "in.visit")
    crowds = both.filter("shell >= 0").groupBy("region", "shell").agg(F.ceil(F.count("*") / LARGE).cast("int").alias("blocks")).filter("blocks > 1")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("low"), F.greatest(k, block).alias("high"), (k < block).alias("side")))
    alone = F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(False).alias("side")))
    return both.join(crowds, ["region", "shell"], "left").withColumn("block", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets))).drop("blocks")


def candidates(members: DataFrame, profiles: DataFrame, least: int, most: int | None) -> DataFrame:
    """(a, b) pairs of members (region, node, place, label) of different labels that may link, by their profiles (node, n, profile, several).

    For each member of a region the `most` nearest by the coarse counts, or all that the fine ones leave. A pair is looked at in the first
    region in common only, so of two nodes of different labels all regions in common must be there; a node of several texts, whose places
    have no one order, is compared in all of its regions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("jaccardjoin")
        regions, seen = [], None
        for batch in batches:
            found_a, found_b = [], []
            columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("region", "shell", "low", "high", "node", "place", "n", "label", "visit", "side")]
            for *key, node, place, n, label, visit, side, before, packed in zip(*columns, batch.column("before").to_pylist(), batch.column("profile").to_pylist(), strict=True):
                if seen != key:
                    regions, seen = [], key
                coarse, fine = counts_of(packed)
                if not regions or regions[-1].parts != len(fine):
                    regions = [*(r for r in regions if r.last > r.first), Region(len(fine), *key[2:])]  # smaller partners have fewer parts
                for region in regions:
                    if region.last > region.first:
                        region.forget(n, least)
                        own = folded(fine, region.parts) if region.parts and region.parts < len(fine) else fine
                        others = region.near(n, label, place, visit, side, coarse, own, before, least, most)
                        found_a.append(np.minimum(others, node))
                        found_b.append(np.maximum(others, node))
                regions[-1].hold(before, node, n, label, place, visit, side, coarse, fine)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    needed = F.col("profile") if most is None else F.substring("profile", 1, COARSE)
    held = members.groupBy("node", "label").agg(F.sort_array(F.collect_list(F.struct("place", "region"))).alias("held"))
    each = held.join(profiles, "node").select("node", "label", "n", "several", needed.alias("profile"), F.col("held.region").alias("regions"), F.posexplode("held").alias("at", "one"))
    brought = each.select("one.region", "node", "one.place", "n", "label", F.expr("if(several, slice(regions, 1, 0), slice(regions, 1, at))").alias("before"), "profile")
    parts = split(brought, least).select("region", "shell", "block.low", "block.high", "block.side", "visit", "node", "place", "n", "label", "before", "profile")
    ordered = parts.repartition("region", "shell", "low", "high").sortWithinPartitions("region", "shell", "low", "high", "n", "node")
    return ordered.mapInArrow(run, "a long, b long")


@functools.lru_cache(256)
def packed_set(text: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(text), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), width)[0]


def verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, width: int, least: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those whose whole sets link.

    The texts of the documents that occur travel to the pairs, compressed, and their sets are made again there; which documents those are
    a bitmap of bounded size tells before anything travels.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slot_of(batch.column("node").to_numpy()))], ["slot"])

    wanted = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")).mapInArrow(slots, "slot long").distinct())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            keep = np.flatnonzero(marked(slot_of(ids), wanted))
            raw, offsets = text_buffer(batch.column("text"))
            texts = [zlib.compress(raw[offsets[k] : offsets[k + 1]].tobytes(), 1) for k in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(texts, pa.binary())], ["node", "packed"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccardjoin", packed_set.cache_clear)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = packed_set(x, width), packed_set(y, width)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                keep.append(both > 0 and 100 * both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), "text").mapInArrow(send, "node long, packed binary")
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def linked_groups(spark: SparkSession, docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    component_id is the least doc_id that links reach. Texts without words, and null ones, have no shingles and link with nothing. Rows
    that repeat a doc_id with another text link as one document does that has both. A null doc_id takes no part and has no component.
    Texts of any length are read whole; an empty table gives an empty one, and other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = checkpoint(spark, described(own, width, least))
    named = rows.filter("n > 0 and doc_id is not null")
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("n_low").alias("n_low"), F.first("head").alias("head"))
    members = checkpoint(spark, memberships(nodes, least))
    several = named.groupBy("doc_id").agg((F.min("digest") < F.max("digest")).alias("several")).filter("several")
    own_profiles = named.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    profiles = own_profiles.join(several, "doc_id", "left").select(F.col("doc_id").alias("node"), "n", "profile", F.coalesce("several", F.lit(False)).alias("several"))
    found = done = None
    for most in ROUNDS:
        labelled = members.withColumn("label", F.col("node"))
        if found is not None:
            labelled = members.join(found, "node", "left").select("region", "node", "place", F.coalesce("component", "node").alias("label"))
        mixed = labelled.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("region")
        pairs = candidates(labelled.join(mixed, "region"), profiles, least, most)
        pairs = checkpoint(spark, pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        done = pairs if done is None else done.unionByName(pairs)
        links = verified(spark, pairs, own, width, least)
        if found is not None:
            links = links.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b")))
        found = components(spark, links)
    classes = named.join(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "digest").select("doc_id", "node")
    groups = classes.join(found, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
