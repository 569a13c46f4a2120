"""Toxicity of texts, read through leetspeak, spacing and repetition.

A noisy-channel decoder restores spaced letters and digits, tokens with signs or digits in them, and tokens with a letter twice: each
source character offers the letters it may stand for (or nothing, for what parts spaced letters and for repetitions), and an exact Viterbi
search over that lattice finds the likeliest letters under a Kneser-Ney character model counted over all learning documents. A lexicon of word beginnings, weighted by how much oftener toxic documents hold them, then
scores the restored text, and a logistic curve turns its strongest hit, their sum and their density into a probability.

The lexicon and the curve are fitted on a bounded sample of labelled rows (SAMPLE), of which near copies count once; the character model
covers all documents outside the held-out fold, and scoring reads whole texts. Each half of the sample has the features that the other
half's lexicon gives it when the curve is fitted, so the curve sees hits as unknown texts show them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import checkpoint, chunks, hold, mix64, release, text_buffer
from siftwright.llm.langid import SPACE, Model, count_grams, kneser_ney

#: Labelled rows that the lexicon and the curve are fitted on, at most.
SAMPLE = 20_000
#: Log-likelihood ratio, times the logarithm of the labelled rows (29.7 at 20,000), from which a word beginning is told from chance.
LEAST_EVIDENCE = 3.0
TOXIC_FROM = 0.7
SHORTEST, LONGEST = 3, 8
FEATURES = 3

# What characters stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l",
}
#: Log probabilities of the channel: a letter written as a sign, a sign or letter that stands for nothing.
AS_SIGN, DROPPED, REPEATED = -1.0, -0.5, -0.5
#: A sign or digit between spaced letters at their start costs this much more to leave out, about what a space costs the model.
BREAK = -4.0
#: Restored tokens that are remembered, look-ups made at a time, characters of a lattice laid out at a time.
MEMORY, LOOKUPS, STRETCH = 50_000, 1 << 14, 2048

_unit = r"(?:[^\W\d_]|[0-9@$!|+€£])"
SPACED = re.compile(rf"(?<![^\W_])(?:{_unit}[ .*_\-]+){{2,}}{_unit}(?![^\W_])")
RUN = re.compile(r"[ .*_\-]{2,}")
#: Kinds of characters: letters; digits and signs that may stand for letters; other digits and the underscore; what parts spaced letters.
LETTER, SIGN, OTHER, PARTS = 1, 2, 4, 8
UNKNOWN = 255

_kinds = np.full(0x110000, UNKNOWN, np.uint8)
_lower = np.arange(0x110000, dtype=np.uint32)


def kind_of(ch: str) -> int:
    if ch in LEET:
        return SIGN
    if ch in " .*_-":
        return PARTS | OTHER * (ch == "_")
    return 0 if not ch.isalnum() else OTHER if ch.isdecimal() else LETTER


def kinds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind and lower-cased code point of each character of texts, one after the other with a zero after each, and where each begins."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _kinds[points]
    if (new := found == UNKNOWN).any():
        for p in np.unique(points[new]).tolist():
            low = chr(p).lower()
            _kinds[p], _lower[p] = kind_of(chr(p)), ord(low) if len(low) == 1 else p
        found = _kinds[points]
    return found, _lower[points], np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)


def spaced_places(texts: list[str]) -> list[list[int]]:
    """Places in each text at which three units stand apart one after the other; spaced words begin at some of them only."""
    kind, _, begins = kinds(texts)
    unit, parts = (kind & (LETTER | SIGN)) > 0, (kind & PARTS) > 0
    at = np.flatnonzero(unit)
    run = np.cumsum(~(unit | parts))  # the same along units and what parts them
    followed = np.r_[parts[1:], False][at]
    first = np.zeros(len(at), bool)
    if len(at) > 2:
        near = (np.diff(at) > 1) & (np.diff(run[at]) == 0) & followed[:-1]
        first[:-2] = near[:-1] & near[1:]
    out: list[list[int]] = [[] for _ in texts]
    starts = at[first]
    for k, p in zip((np.searchsorted(begins, starts, "right") - 1).tolist(), starts.tolist(), strict=True):
        out[k].append(p - int(begins[k]))
    return out


def mixed_tokens(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Start and end of the tokens of each text with a sign before a letter, a digit after one, or a letter twice in a row."""
    kind, low, begins = kinds(texts)
    letter, sign = kind == LETTER, kind == SIGN
    digit = sign & (low >= 0x30) & (low <= 0x39)
    choice = np.zeros(len(kind), bool)
    choice[1:] = letter[1:] & (sign[:-1] | (letter[:-1] & (low[1:] == low[:-1]))) | digit[1:] & letter[:-1]
    token = (kind & (LETTER | SIGN | OTHER)) > 0
    edges = np.flatnonzero(np.diff(token, prepend=False))  # the last character is no part of a token
    starts, ends = edges[::2], edges[1::2]
    own = np.unique(np.searchsorted(starts, np.flatnonzero(choice), "right") - 1)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, a, b in zip((np.searchsorted(begins, starts[own], "right") - 1).tolist(), starts[own].tolist(), ends[own].tolist(), strict=True):
        out[k].append((a - int(begins[k]), b - int(begins[k])))
    return out


def spelled(way: tuple | None) -> str:
    parts = []
    while way is not None:
        way, new = way
        parts.append(new)
    return "".join(reversed(parts)).strip()


class Restorer:
    """Viterbi search for what tokens stand for, many tokens at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[tuple[str, bool], str] = {}

    def restore(self, tokens: set[tuple[str, bool]]) -> dict[tuple[str, bool], str]:
        """What each token (text, whether its letters are spaced) stands for."""
        if len(self.known) > MEMORY:
            self.known.clear()
        new = sorted(tokens - self.known.keys())
        for a in range(0, len(new), 4096):
            self.known.update(zip(new[a : a + 4096], self._search(new[a : a + 4096]), strict=True))
        return {t: self.known[t] for t in tokens}

    def _search(self, tokens: list[tuple[str, bool]]) -> list[str]:
        """The likeliest restoration of each token; look-ups of many tokens are made together."""
        ends = [""] * len(tokens)
        todo = [(i, self._walk(t.lower(), spaced), None) for i, (t, spaced) in enumerate(tokens)]
        waiting, held = [], 0
        while todo or waiting:
            if todo and held < LOOKUPS:
                i, walk, costs = todo.pop()
                try:
                    keys = walk.send(costs)
                except StopIteration as end:
                    ends[i] = end.value
                    continue
                waiting.append((i, walk, len(keys), keys))
                held += len(keys)
                continue
            found = self.model.log_probabilities(np.array([k for *_, keys in waiting for k in keys], np.uint64))[:, 0].tolist()
            at = 0
            for i, walk, n, _ in waiting:
                todo.append((i, walk, found[at : at + n]))
                at += n
            waiting, held = [], 0
        return ends

    def _walk(self, low: str, spaced: bool) -> Generator[list[int], list[float], str]:
        """Asks for the costs of keys and returns the likeliest restoration of a token.

        A state is the last three characters. The lattice is laid out STRETCH characters at a time, whatever the scores will be; as far as
        it has one state and no choice, no score is needed.
        """
        states: dict = {(0, 0, SPACE): (0.0, None)}
        k = 0
        while k <= len(low):
            layers, keys, reach = [], [], list(states)
            till = k + STRETCH
            while k <= len(low) and k < till:
                if len(reach) == 1:
                    a = k
                    while k < len(low) and low[k].isalpha() and (k == 0 or low[k] != low[k - 1]):
                        k += 1
                    if k > a:
                        reach = [(*reach[0], *map(self._code, low[max(a, k - 3) : k]))[-3:]]
                        layers.append((low[a:k], reach[0]))
                    if k == len(low):
                        k += 1
                        break
                options = [(" ", 0.0, SPACE)] if k == len(low) else self._options(low, k, spaced)
                steps, following = [], {}
                for state in reach:
                    x, y, z = state
                    base = x << 48 | y << 32 | z << 16
                    for new, cost, code in options:
                        to = (y, z, code) if new else state
                        steps.append((state, to, new, cost))
                        following[to] = None
                        if new:
                            keys.append(base | code)
                layers.append(steps)
                reach = list(following)
                k += 1
            costs = iter((yield keys) if keys else [])
            for layer in layers:
                if isinstance(layer, tuple):
                    ((score, way),) = states.values()
                    states = {layer[1]: (score, (way, layer[0]))}
                    continue
                best: dict = {}
                for state, to, new, cost in layer:
                    score, way = states[state]
                    total = score + cost + next(costs) if new else score + cost
                    if to not in best or best[to][0] < total:
                        best[to] = total, (way, new) if new else way
                states = best
        return spelled(max(states.values(), key=lambda x: x[0])[1])

    def _options(self, low: str, k: int, spaced: bool) -> list[tuple[str, float, int]]:
        """(letter or nothing, log probability, code) of what character k may stand for."""
        ch = low[k]
        again = k > 0 and ch == low[k - 1]
        if ch.isalpha():
            options = [(ch, 0.0)] + [("", REPEATED)] * again
        elif ch in LEET:
            options = [(x, AS_SIGN) for x in LEET[ch]] + [("", REPEATED)] * again
            if spaced:  # or a sign between words
                options.append((" ", AS_SIGN) if k else ("", AS_SIGN + BREAK))
        else:
            options = [("", DROPPED)] + [(" ", 0.0)] * (spaced and k > 0 and low[k - 1] in " .*_-")  # of several, words may be parted
        return [(new, cost, SPACE if new == " " else self._code(new) if new else 0) for new, cost in options]

    @staticmethod
    def _code(ch: str) -> int:
        p = ord(ch)
        return p if p < 0xFFFF else 0xE000 + p % 6400

    def texts(self, texts: list[str]) -> list[str]:
        """texts with spaced and mixed tokens restored."""
        spaced = []
        for text, places in zip(texts, spaced_places(texts), strict=True):
            own, end = [], 0
            for p in places:
                if p < end or not (m := SPACED.match(text, p)):
                    continue
                end = m.end()
                if any(map(str.isalpha, m[0])):
                    own.append((*m.span(), (RUN.sub("  ", m[0]), True)))
            spaced.append(own)
        texts = self._replaced(texts, spaced)
        mixed = [[(a, a + len(core), (core, False)) for a, b in own if (core := text[a:b].rstrip("@$!|+€£_"))] for text, own in zip(texts, mixed_tokens(texts), strict=True)]
        return self._replaced(texts, mixed)

    def _replaced(self, texts: list[str], found: list[list[tuple]]) -> list[str]:
        restored = self.restore({x for own in found for *_, x in own})
        out = []
        for text, own in zip(texts, found, strict=True):
            parts, at = [], 0
            for a, b, x in own:
                parts += [text[at:a], restored[x]]
                at = b
            out.append("".join([*parts, text[at:]]) if own else text)
        return out


def prefix_keys(words: list[bytes]) -> set[int]:
    return {int.from_bytes(w[:n].ljust(8, b"\0"), "big") for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


WORD = re.compile(rb"[a-z\x80-\xff]+")


class Lexicon:
    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = np.append(keys[order], np.uint64(2**64 - 1)), np.append(weights[order], 0.0)
        self.begins = np.zeros(1 << 24, bool)
        self.begins[(keys >> np.uint64(40)).astype(np.int64)] = True

    def features(self, texts: list[str]) -> np.ndarray:
        """Strongest hit, log(1 + sum of hits) and log(1 + that sum for each hundred words) of each text."""
        raw = np.frombuffer(("\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0").lower().encode("utf-8", "surrogatepass"), np.uint8)
        letter = (raw >= 0x80) | ((raw >= 0x61) & (raw < 0x7B))
        edge = np.flatnonzero(np.diff(letter, prepend=False))
        starts, ends = edge[::2], edge[1::2]  # the last byte is no letter
        zeros = np.flatnonzero(raw == 0)
        words = np.bincount(np.searchsorted(zeros, starts), minlength=len(texts))
        keep = ends - starts >= SHORTEST
        starts, ends = starts[keep], ends[keep]
        three = raw[starts].astype(np.int64) << 16 | raw[starts + 1].astype(np.int64) << 8 | raw[starts + 2]
        keep = self.begins[three]
        starts, sizes = starts[keep], (ends - starts)[keep]
        padded = np.append(raw, np.zeros(8, np.uint8))
        key = three[keep].astype(np.uint64)
        for j in range(SHORTEST, LONGEST):
            key = key << np.uint64(8) | np.where(sizes > j, padded[starts + j], 0).astype(np.uint64)
        best = np.zeros(len(key))
        for n in range(SHORTEST, LONGEST + 1):
            drop = np.uint64(8 * (8 - n))
            own = key >> drop << drop
            at = np.searchsorted(self.keys, own)
            best = np.maximum(best, np.where((self.keys[at] == own) & (sizes >= n), self.weights[at], 0))
        owner = np.searchsorted(zeros, starts)
        top = np.zeros(len(texts))
        np.maximum.at(top, owner, best)
        total = np.bincount(owner, best, len(texts))
        return np.column_stack([top, np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))])


def restored(batch: pa.RecordBatch, restorer: Restorer | None) -> Iterator[tuple[int, list[str]]]:
    """First row and restored texts of each chunk of a batch."""
    release("toxicity")
    column = batch.column("text")
    _, offsets = text_buffer(column)
    for a, b in chunks(offsets):
        texts = [x or "" for x in column.slice(a, b - a).to_pylist()]
        yield a, texts if restorer is None else restorer.texts(texts)


def one_of_copies(rows: list) -> set[int]:
    """Of rows (doc_id, k0, k1, k2: least hashes of three-word shingles), one doc_id of each group that shares two of the keys."""
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict = {}
    for r in rows:
        for i, j in ((0, 1), (0, 2), (1, 2)):
            parent[top(first.setdefault((i, j, r[f"k{i}"], r[f"k{j}"]), r["doc_id"]))] = top(r["doc_id"])
    return {top(r["doc_id"]) for r in rows}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(model, lexicon, coefficients) from docs (doc_id, text) of the learning folds and their labels (doc_id, toxic); None without both classes."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = checkpoint(spark, docs.join(F.broadcast(picked), "doc_id"))
    grams = count_grams(docs.select("text", F.lit("all").alias("lang"))).select("key", "n").toArrow()
    if not grams.num_rows:
        return None
    model = kneser_ney({"all": (grams.column("key").to_numpy().view(np.uint64), grams.column("n").to_numpy())})
    del grams

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = np.fromiter(map(hash_word, WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))), np.uint64)
                keys = mix64(words[2:] + mix64(words[1:-1] + mix64(words[:-2]))) if len(words) > 2 else words
                out.append([int((mix64(keys + np.uint64(j * 0x9E3779B9)).min() if len(keys) else np.uint64(j)) >> np.uint64(1)) for j in range(3)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array([o[j] for o in out], pa.int64()) for j in range(3))], ["doc_id", "toxic", "k0", "k1", "k2"])

    sketches = rows.mapInArrow(sketch, "doc_id long, toxic int, k0 long, k1 long, k2 long").collect()  # `sample` rows
    kept = one_of_copies(sketches)
    if len({r["toxic"] > 0 for r in sketches if r["doc_id"] in kept}) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]  # clean and toxic of the first half, then of the second
        restorer = Restorer(model)
        for batch in batches:
            ids, truth = batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()
            for first, texts in restored(batch, restorer):
                for k, text in enumerate(texts, first):
                    if ids[k] in kept:
                        seen[2 * half(ids[k]) + (truth[k] > 0)].update(prefix_keys(set(WORD.findall(text.lower().encode("utf-8", "surrogatepass")))))
        keys = np.array(list(set().union(*seen)), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array([seen[j][k] for k in keys.tolist()], pa.int64()) for j in range(4))], ["key", "b0", "a0", "b1", "a1"])

    table = rows.mapInArrow(count, "key long, b0 long, a0 long, b1 long, a1 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("b0", "a0", "b1", "a1")))
    sizes = [[sum((r["toxic"] > 0) == t and half(r["doc_id"]) == h for r in sketches if r["doc_id"] in kept) for t in (True, False)] for h in (0, 1)]
    lexicons = lexicons_of(table, sizes)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            ids, truth = batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()
            for first, texts in restored(batch, restorer):
                own = [k for k in range(len(texts)) if ids[first + k] in kept]
                by = np.array([half(ids[first + k]) for k in own], bool)
                x = [lexicon.features(texts)[own] for lexicon in lexicons]
                both = np.column_stack([np.where(by[:, None], x[0], x[1]), x[2]])
                yield pa.RecordBatch.from_arrays([*(pa.array(both[:, j], pa.float64()) for j in range(2 * FEATURES)), pa.array([float(truth[first + k] > 0) for k in own], pa.float64())], [*(f"x{j}" for j in range(2 * FEATURES)), "toxic"])

    points = rows.mapInArrow(design, ", ".join([*(f"x{j} double" for j in range(2 * FEATURES)), "toxic double"])).toPandas().to_numpy(dtype=float)  # `sample` rows
    crossed, whole = points[:, :FEATURES], points[:, FEATURES : 2 * FEATURES]
    return model, lexicons[2], curve(crossed if crossed.any() else whole, points[:, -1])  # halves of a few rows show nothing


def half(doc_id: int) -> int:
    """The half of the sample that a document is in."""
    return zlib.crc32(b"%d" % doc_id) >> 8 & 1


def lexicons_of(table: DataFrame, sizes: list[list[int]]) -> list[Lexicon]:
    """Lexicons of the first half, the second, and both, from the numbers of their toxic (a) and clean (b) rows that hold a key.

    An entry has a likelihood ratio that chance doesn't explain and is commoner in toxic rows. Their number is bounded by the sample's.
    """
    columns = []
    for name, a, b, (toxic, clean) in (("0", F.col("a0"), F.col("b0"), sizes[0]), ("1", F.col("a1"), F.col("b1"), sizes[1]), ("2", F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), [x + y for x, y in zip(*sizes, strict=True)])):
        toxic_rows, clean_rows = max(1, toxic), max(1, clean)
        p = (a + b) / (toxic_rows + clean_rows)
        loglike = lambda x, n, q: x * F.log(F.greatest(q, F.lit(1e-12))) + (n - x) * F.log(F.greatest(1 - q, F.lit(1e-12)))
        evidence = 2 * (loglike(a, F.lit(toxic_rows), a / toxic_rows) + loglike(b, F.lit(clean_rows), b / clean_rows) - loglike(a, F.lit(toxic_rows), p) - loglike(b, F.lit(clean_rows), p))
        weight = F.log((a + 0.5) / (toxic_rows + 1) / ((b + 0.5) / (clean_rows + 1)))
        told = (evidence >= LEAST_EVIDENCE * float(np.log(toxic_rows + clean_rows))) & (weight > 0)
        columns.append(F.when(told, weight).otherwise(0.0).alias(f"w{name}"))
    found = table.select("key", *columns).filter("w0 > 0 or w1 > 0 or w2 > 0").toPandas()
    keys = found["key"].to_numpy().astype(np.int64).view(np.uint64)
    weights = [found[f"w{k}"].to_numpy().astype(float) for k in range(3)]
    return [Lexicon(keys[w > 0], w[w > 0]) for w in weights]


def hash_word(word: bytes) -> int:
    return int.from_bytes(word[:8].ljust(8, b"\0"), "big") ^ (int.from_bytes(word[8:16].ljust(8, b"\0"), "big") * 0x9E3779B97F4A7C15 % 2**64)


def curve(x: np.ndarray, truth: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a ridge logistic regression; the last is the intercept.

    More evidence never lowers a score: a feature whose weight would be negative has none. Features are scaled to unit deviation, and
    Newton steps are halved until the penalised loss falls, so that classes that can be told apart without error have a solution too.
    """
    scale = np.maximum(x.std(0), 1e-9)
    free = [j for j in range(x.shape[1]) if x[:, j].std() > 0]
    while True:
        w = _newton(np.column_stack([x[:, free] / scale[free], np.ones(len(x))]), truth, ridge)
        if not free or w[:-1].min() >= 0:
            break
        free.pop(int(w[:-1].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[free], out[-1] = w[:-1] / scale[free], w[-1]
    return out


def _newton(design: np.ndarray, truth: np.ndarray, ridge: float) -> np.ndarray:
    penalty = ridge * np.diag([1.0] * (design.shape[1] - 1) + [1e-3])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(np.logaddexp(0, z) - truth * z) + w @ penalty @ w / 2)

    w, now = np.zeros(design.shape[1]), np.inf
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (truth - p) - penalty @ w)
        now, share = loss(w), 1.0
        while share > 1e-9 and loss(w + share * step) > now:
            share /= 2
        w = w + share * step
        if share * np.abs(step).max() < 1e-8:
            break
    return w


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 3


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """fit() on the folds that may be learned from."""
    return fit(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(fold() != 1), labels)


def probabilities(batch: pa.RecordBatch, fitted) -> np.ndarray:
    if fitted is None:
        return np.zeros(batch.num_rows)
    model, lexicon, w = fitted
    global _restorer
    if _restorer is None or _restorer.model is not model:
        _restorer = Restorer(model)
        hold("toxicity", forget)
    parts = [lexicon.features(texts) for _, texts in restored(batch, _restorer)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate([*parts, np.zeros((0, FEATURES))]) @ w[:-1] + w[-1], -30, 30)))


_restorer: Restorer | None = None


def forget() -> None:
    global _restorer
    _restorer = None


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text).

    Fold 1 of three (crc32 of doc_id) is held out; a null doc_id is in no fold and teaches nothing. A null text is empty. Labels that
    differ for one doc_id count as toxic. Repeated rows are scored each, texts of any length whole; an empty table gives an empty one, and
    other columns are ignored. Without labels of both classes all scores are 0.
    """
    fitted = learned(spark, docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = probabilities(batch, fitted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= TOXIC_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, which has one column text, without the rows whose text is predicted toxic; all columns, null and empty texts stay."""
    fitted = learned(spark, docs, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            yield batch.filter(pa.array(probabilities(texts, fitted) < TOXIC_FROM))

    return docs.mapInArrow(run, docs.schema)
