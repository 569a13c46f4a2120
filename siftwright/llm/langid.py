"""Language identification by interpolated Kneser-Ney character language models.

One model of order four per language, counted over all training documents: workers count four-grams of their share, Spark adds them up,
and the driver turns the table of all distinct four-grams, however rare, into probabilities. All languages share one sorted array of
64-bit hashes per order with a column of log probabilities per language; a directory on the leading bits of the hash makes a look-up one
or two steps. A document gets the language of lowest cross-entropy per character. A logistic curve over the evidence (margin times
length), fitted on a fold that was not counted, gives the confidence; documents whose cross-entropy lies far above what that fold shows
for the language are rejected.

Text is lower-cased; every run of other characters than letters is one space. Code points beyond U+FFFF share 6400 codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import CHUNK_BYTES, checkpoint, chunks, mix64, release, text_buffer

ORDER, SPACE, UNKNOWN = 4, 32, 0xFFFF
UND = "und"
#: Steps of the calibration histogram, in log(1 + nats of margin).
BINS, BIN_WIDTH = 64, 0.25
#: Standard deviations above the language's mean cross-entropy at which a document is rejected.
REJECT_AT = 4.0

_codes = np.full(0x110000, UNKNOWN, np.uint16)
_codes[0] = 0


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, three zeros before each and after the last; start and end of each text among them."""
    joined = "\0\0\0".join(["", *(t.replace("\0", " ") if "\0" in t else t for t in texts), ""]).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _codes[points]
    if (new := codes == UNKNOWN).any():
        for p in np.unique(points[new]).tolist():
            _codes[p] = SPACE if not chr(p).isalpha() else p if p < UNKNOWN else 0xE000 + p % 6400
        codes = _codes[points]
    space = codes == SPACE
    space[1:] &= space[:-1].copy()
    space[0] = False
    codes = codes[~space]
    zeros = np.flatnonzero(codes == 0)
    return codes, zeros[2:-1:3] + 1, zeros[3::3]


def windows(codes: np.ndarray) -> np.ndarray:
    """The last four codes at each place, 16 bits each, the latest lowest."""
    c = codes.astype(np.uint64)
    keys = c.copy()
    for k in range(1, ORDER):
        keys[k:] |= c[:-k] << np.uint64(16 * k)
    return keys


class HashArray:
    """Sorted hashes of keys, with a row of values for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix64(keys)
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.values = np.concatenate([values[order], np.zeros((1, values.shape[1]), values.dtype)]).astype(np.float32)
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.size = len(keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key, and whether it is there."""
        hashes = mix64(keys)
        rows = self.first[hashes >> self.shift]
        todo = np.flatnonzero(self.hashes[rows] < hashes)
        while len(todo):
            rows[todo] += 1
            todo = todo[self.hashes[rows[todo]] < hashes[todo]]
        return rows, (self.hashes[rows] == hashes) & (rows < self.size)


@dataclass
class Model:
    langs: list[str]
    grams: list[HashArray]  # by order, 1 first
    backoff: list[HashArray]  # of contexts, by the order above them, 2 first
    floor: np.ndarray  # of characters that no language holds, by language
    slope: float = 1.0
    intercept: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        rows, found = self.grams[-1].find(keys)
        out = self.grams[-1].values[rows]
        lost = np.flatnonzero(~found)
        if len(lost):
            out[lost] = 0
        for order in range(ORDER, 1, -1):  # of those not found in any language yet, `order` characters were looked up
            if not len(lost):
                return out
            own = keys[lost] & np.uint64((1 << 16 * order) - 1) if order < ORDER else keys[lost]
            rows, found = self.backoff[order - 2].find(own >> np.uint64(16))
            out[lost] += np.where(found[:, None], self.backoff[order - 2].values[rows], np.float32(0))
            rows, found = self.grams[order - 2].find(own & np.uint64((1 << 16 * (order - 1)) - 1))
            out[lost] += np.where(found[:, None], self.grams[order - 2].values[rows], np.float32(0))
            lost = lost[~found]
        out[lost] += self.floor
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and its number of letters and spaces (0: no letter)."""
        codes, starts, ends = encode(texts)
        scores = self.log_probabilities(windows(codes))
        sums = np.add.reduceat(scores, np.ravel(np.column_stack([starts, ends])), axis=0, dtype=np.float64)[::2]
        letters = np.append(0, np.cumsum(codes > SPACE))
        sizes = np.where(letters[ends] > letters[starts], ends - starts, 0)
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def evidence(self, nats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if nats.shape[1] < 2:
            return np.zeros(len(nats))
        two = np.partition(nats, 1, axis=1)
        return np.log1p((two[:, 1] - two[:, 0]) * sizes)


def kneser_ney(tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from the four-gram keys and counts of each language."""
    langs = sorted(tables)
    levels: dict[str, list[tuple]] = {}
    for lang, (keys, counts) in tables.items():
        order = np.argsort(keys)
        own = [(keys[order], counts[order].astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters go before
            own.append(tuple(np.unique(own[-1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)))
        levels[lang] = own[::-1]
    alphabet = max(2, len(np.unique(np.concatenate([levels[x][0][0] for x in langs]))) + 1)
    lower_keys, lower = None, None
    grams, backoff = [], []
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[x][n - 1][0] for x in langs]))
        contexts = np.unique(union >> np.uint64(16))
        p = np.zeros((len(union), len(langs)))
        weights = np.ones((len(contexts), len(langs)))
        for k, lang in enumerate(langs):
            keys, counts = levels[lang][n - 1]
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            own, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(inverse, counts, len(own))
            weights[np.searchsorted(contexts, own), k] = discount * np.bincount(inverse, minlength=len(own)) / total
            p[np.searchsorted(union, keys), k] = np.maximum(counts - discount, 0) / total[inverse]
        below = np.full((len(union), len(langs)), 1 / alphabet) if n == 1 else lower[np.searchsorted(lower_keys, union & np.uint64((1 << 16 * (n - 1)) - 1))]
        p += weights[np.searchsorted(contexts, union >> np.uint64(16))] * below
        lower_keys, lower = union, p
        grams.append(HashArray(union, np.log(p)))
        if n > 1:
            backoff.append(HashArray(contexts, np.log(weights)))
        else:
            floor = np.log(weights[0] / alphabet).astype(np.float32)
    return Model(langs, grams, backoff, floor)


def fold(column: str = "doc_id", of: int = 5):
    return F.crc32(F.col(column).cast("string")) % of


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[str]]]:
    """First row and texts of each chunk of a batch; null is empty."""
    column = batch.column(name)
    _, offsets = text_buffer(column)
    for a, b in chunks(offsets, CHUNK_BYTES):
        yield a, [x or "" for x in column.slice(a, b - a).to_pylist()]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, key, n) of the four-grams of documents (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("langid")
        held: dict[str, list] = {}

        def merged(parts: list) -> list:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return [(keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64))]

        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                for _, texts in texts_of(batch.filter(pc.equal(batch.column("lang"), lang))):
                    codes, _, _ = encode(texts)
                    held.setdefault(lang, []).append(np.unique(windows(codes)[codes > 0], return_counts=True))
                    if sum(len(k) for k, _ in held[lang]) > 1_000_000:
                        held[lang] = merged(held[lang])
        for lang, parts in held.items():
            ((keys, n),) = merged(parts)
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(n[a : a + 50_000])], ["lang", "key", "n"])

    counted = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, docs: DataFrame, calibration: DataFrame) -> Model | None:
    """A model of documents (text, lang), calibrated on others; None if no text has a language."""
    grams = checkpoint(spark, count_grams(docs))
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")  # names would weigh more than keys and counts
    table = grams.select(number.alias("lang"), "key", "n").toArrow()
    lang, keys, counts = (table.column(c).to_numpy() for c in ("lang", "key", "n"))
    del table
    model = kneser_ney({x: (keys[lang == k].view(np.uint64), counts[lang == k]) for k, x in enumerate(langs, 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: k for k, x in enumerate(model.langs)}
        bins, right = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        moments = np.zeros((len(model.langs), 3))
        for batch in batches:
            truth = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()])
            for a, texts in texts_of(batch):
                nats, sizes = model.cross_entropies(texts)
                own, some = truth[a : a + len(texts)], sizes > 0
                at = np.minimum(BINS - 1, model.evidence(nats, sizes) / BIN_WIDTH).astype(int)
                bins += np.bincount(at[some], minlength=BINS)
                right += np.bincount(at[some & (nats.argmin(1) == own)], minlength=BINS)
                k = np.flatnonzero((sizes >= 50) & (own >= 0))
                x = nats[k, own[k]]
                for j, v in enumerate((np.ones(len(k)), x, x * x)):
                    moments[:, j] += np.bincount(own[k], v, len(model.langs))
        kind = ["bin"] * BINS + ["lang"] * len(model.langs)
        values = np.concatenate([np.column_stack([bins, right, 0 * bins]), moments])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array([*range(BINS), *range(len(model.langs))]), *(pa.array(values[:, j]) for j in range(3))], ["kind", "k", "a", "b", "c"])

    seen = calibration.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "kind string, k long, a double, b double, c double")
    rows = seen.groupBy("kind", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect()
    bins = np.zeros((BINS, 2))
    model.mean, model.spread = np.full(len(model.langs), np.inf), np.ones(len(model.langs))
    for r in rows:
        if r["kind"] == "bin":
            bins[r["k"]] = r["a"], r["b"]
        elif r["a"] > 1:
            model.mean[r["k"]] = r["b"] / r["a"]
            model.spread[r["k"]] = max(1e-3, r["c"] / r["a"] - model.mean[r["k"]] ** 2) ** 0.5
    model.slope, model.intercept = logistic((np.arange(BINS) + 0.5) * BIN_WIDTH, *bins.T)
    return model


def logistic(x: np.ndarray, n: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and intercept fitted to counts, each bin smoothed by one right and one wrong case at the first bin."""
    x, n, right = np.append(x, x[0]), np.append(n, 2), np.append(right, 1)
    w = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, design.T @ (right - n * p) - 1e-3 * w), -1, 1)
    return max(0.0, float(w[0])), float(w[1])


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """columns of docs, then lang_pred, score, accepted and nats of the whole text.

    lang_pred is und, score 0 and accepted false for a null text, one without letters, or without a model. accepted is false, with the
    nearest language kept, if the text's cross-entropy is more than REJECT_AT deviations above that language's mean.
    """
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean").add("nats", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, accepted, cross = [], [], [], []
            for _, texts in texts_of(batch):
                if model is None:
                    lang += [UND] * len(texts)
                    score += [0.0] * len(texts)
                    accepted += [False] * len(texts)
                    cross += [0.0] * len(texts)
                    continue
                nats, sizes = model.cross_entropies(texts)
                best = nats.argmin(1)
                low, some = nats[np.arange(len(best)), best], sizes > 0
                sure = 1 / (1 + np.exp(-(model.slope * model.evidence(nats, sizes) + model.intercept)))
                lang += [model.langs[k] if ok else UND for k, ok in zip(best, some, strict=True)]
                score += np.where(some, sure, 0).tolist()
                accepted += (some & (low <= model.mean[best] + REJECT_AT * model.spread[best])).tolist()
                cross += np.where(some, low, 0).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_()), pa.array(cross, pa.float64())], schema.names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted, nats) of documents (doc_id, text, lang).

    Fold 0 of five (crc32 of doc_id) is held out, fold 1 calibrates, the others are counted. Null texts and languages teach nothing, a
    null doc_id is in no fold; repeated rows are predicted each; texts of any length are read whole; other columns are ignored. If nothing
    can be learned all are und; an empty table gives an empty one.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("fold", fold())
    model = train(spark, own.filter("fold > 1"), own.filter("fold = 1"))
    return predict(own.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])
