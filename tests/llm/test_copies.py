"""Operators on copies against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import components, jaccardjoin, suffixfamily


def brute_dedup(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        runs = int((gone & np.r_[True, ~gone[:-1]]).sum()) if len(raw) else 0
        out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def made_texts():
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdeé"), 5)) for _ in range(60)]
    base = [" ".join(r.choice(words, 60)) for _ in range(12)]
    passage = " ".join(r.choice(words, 30))
    texts = [*base, base[0], base[1][50:], base[2][:150] + "x" + base[2][150:], f"{base[3]} {passage}", f"{passage} {base[4]}", f"q{passage}q", None, "", "Ha " * 200, "ab" * 150, "\x00" * 250, passage[:120], base[5][30:131], base[5][30:129]]
    return [(7 * k % 97, t) for k, t in enumerate(texts)]


def test_substrings_against_brute_force(spark):
    rows = made_texts()
    docs = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, ver string")
    assert sorted(tuple(r) for r in suffixfamily.dedup_substrings(spark, docs).collect()) == sorted(brute_dedup(rows, 100))


def test_substrings_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "n" * 150), (1, "n" * 120), (1, "n" * 120), (2, None)], "doc_id long, text string")
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixfamily.dedup_substrings(spark, docs).collect())
    assert out == [(False, 0, 150, 149), (True, 1, 120, 120), (True, 1, 120, 120), (True, 2, 0, 0)]
    assert suffixfamily.dedup_substrings(spark, docs.limit(0)).count() == 0


def test_substrings_of_long_texts_and_a_passage_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(suffixfamily, "FLUSH", 2000)
    monkeypatch.setattr(suffixfamily, "BATCH", 500)
    r = np.random.default_rng(9)
    letters = lambda n: "".join(r.choice(list("abcdefgh "), n))
    passage, long = letters(400), letters(150_000)
    rows = [(k, f"{letters(120)}{passage if k % 2 else passage[:230]}{letters(60)}") for k in range(60)] + [(60, long), (61, long[70_000:90_000] + letters(50) + long[10:500])]
    docs = spark.createDataFrame([(*x, 1, "h") for x in rows], "doc_id long, text string, lo int, h string")
    assert sorted(tuple(x) for x in suffixfamily.dedup_substrings(spark, docs).collect()) == sorted(brute_dedup(rows, 100))


@given(st.lists(st.binary(min_size=0, max_size=80).map(lambda b: bytes(x % 3 for x in b)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_neighbourhoods_cover_every_string_once(texts):
    length, gram = 12, 5
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    text, lo, wide, h, _ = suffixfamily.neighbourhoods(raw, offsets, length, gram)
    got = sorted((t, a + k) for t, a, w in zip(text.tolist(), lo.tolist(), wide.tolist(), strict=True) for k in range(w + 1))
    assert got == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1)]
    by_string = {}
    for t, a, w, x in zip(text.tolist(), lo.tolist(), wide.tolist(), h.tolist(), strict=True):
        for k in range(w + 1):
            assert by_string.setdefault(texts[t][a + k : a + k + length], x) == x


@given(st.lists(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x % 2 for x in b)), max_size=30), max_size=8), st.sampled_from([3, 100]))
@settings(max_examples=150, deadline=None)
def test_family_finds_what_is_there(batches, block):
    text = np.frombuffer(b"".join(s for batch in batches for s in batch) + b"zzzz", np.uint8)
    at = np.cumsum([0, *map(len, batches)]) * 4
    monkey = suffixfamily.BATCH
    suffixfamily.BATCH = block  # blocks of a scan smaller than the levels
    try:
        family, seen = suffixfamily.SuffixFamily(text, 4), set()
        for batch, a in zip(batches, at.tolist(), strict=False):
            wanted = []
            for s in batch:
                wanted.append(s in seen)
                seen.add(s)
            assert family.add(a + 4 * np.arange(len(batch))).tolist() == wanted
    finally:
        suffixfamily.BATCH = monkey
    for level in family.levels:
        strings = [text[p : p + 4].tobytes() for p in level.tolist()]
        assert strings == sorted(set(strings))
    assert all(len(a) > 2 * len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))


def brute_groups(rows, least=85, width=4):
    sets = []
    for doc, text in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
        sets.append((doc, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= least * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
    return sorted((d, len(s), top(d)) for d, s in sets)


@pytest.mark.parametrize(("rounds", "large"), [((3, None), 2048), ((1, None), 3), ((None,), 3)])
def test_jaccard_groups_against_brute_force(spark, rounds, large, monkeypatch):
    monkeypatch.setattr(jaccardjoin, "ROUNDS", rounds)
    monkeypatch.setattr(jaccardjoin, "LARGE", large)
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    base = [list(r.choice(words, n)) for n in (60, 60, 80, 200, 25, 10, 4, 3, 1)]
    passage = list(r.choice(words, 40))
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(7):
            c = list(b)
            for _ in range(int(r.integers(0, 1 + len(c) // 20))):
                c[int(r.integers(len(c)))] = "new" + str(r.integers(1000))
            texts.append(c)
    texts += [list(r.choice(words, 30)) + passage for _ in range(20)]
    rows = [(int(i), " ".join(t)) for i, t in zip(r.permutation(1000), texts, strict=False)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "A B"), (2004, "a b"), (2005, rows[0][1].upper()), (2006, "É b c d e"), (2007, "é b c d e"), (2008, "w1 " * 20_000)]
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, node string")
    out = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccardjoin.linked_groups(spark, docs).collect())
    assert out == brute_groups(rows)


@pytest.mark.parametrize(("width", "least"), [(5, 80), (2, 30), (1, 100)])
def test_jaccard_groups_at_other_thresholds(spark, width, least):
    r = np.random.default_rng(width)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for n in (400, 150, 60, 12, 5):
        base = list(r.choice(words, n))
        texts += [base[: max(1, int(n * share))] for share in (1, 1, 0.97, 0.9, 0.8, 0.6, 0.34, 0.2)]
    rows = [(int(i), " ".join(t)) for i, t in zip(r.permutation(100), texts, strict=False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccardjoin.linked_groups(spark, docs, width, least).collect())
    assert out == brute_groups(rows, least, width)


def test_jaccard_pairs_are_made_once(spark, monkeypatch):
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    base, rows = list(r.choice(words, 80)), []
    for k in range(45):
        c = base[: 80 - 6 * (k % 3)]
        for _ in range(int(r.integers(1, 4))):
            c[int(r.integers(len(c)))] = f"x{r.integers(1000)}"
        rows.append((k, " ".join(c)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, candidates = [], jaccardjoin.candidates

    def spy(*args):
        with monkeypatch.context() as m:
            m.setattr(type(docs), "distinct", lambda df: df)  # what the parts make, not what is left of it
            pairs = [tuple(p) for p in candidates(*args).collect()]
        made.append(pairs)
        return spark.createDataFrame(sorted(set(pairs)), "a long, b long")

    monkeypatch.setattr(jaccardjoin, "candidates", spy)
    monkeypatch.setattr(jaccardjoin, "ROUNDS", (None,))
    monkeypatch.setattr(jaccardjoin, "LARGE", 12)  # shells and blocks
    out = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccardjoin.linked_groups(spark, docs, 4, 70).collect())
    assert out == brute_groups(rows, 70)
    assert len(made[0]) == len(set(made[0])) > 100


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 300))
@settings(max_examples=150, deadline=None)
def test_counts_never_overstate_a_difference(x, y, cut):
    a, b = (np.array(sorted(s), np.uint64) for s in (x, {*sorted(x)[cut:], *y}))
    p, q = (jaccardjoin.counts_of(jaccardjoin.profile(s)) for s in (a, b))
    apart, parts = len(set(a.tolist()) ^ set(b.tolist())), min(len(p[1]), len(q[1]))
    assert jaccardjoin.difference(p[0][None], q[0], 255)[0] <= apart
    assert jaccardjoin.difference(jaccardjoin.folded(p[1], parts)[None], jaccardjoin.folded(q[1], parts), jaccardjoin.FULL)[0] <= apart


def test_jaccard_groups_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "x y z")], "doc_id long, text string")
    out = sorted((x.doc_id or -1, x.n_shingles, x.component_id) for x in jaccardjoin.linked_groups(spark, docs).collect())
    assert out == [(-1, 1, None), (2, 1, 2), (3, 1, 3), (3, 1, 3)]
    assert jaccardjoin.linked_groups(spark, docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(3, 300), (300, 2)]
    out = {r.node: r.component for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(100, 141)} == {100} and {out[k] for k in range(200, 260)} == {7} and out[3] == out[300] == out[2] == 2
