import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwright.llm import packing

TEXTS = [
    None, "", "Hello, world! It's 3.5%%% the###\nend.", "Ö é éa ſ İ don't <|endoftext|> x", "aé's. 'S 12ab, ... \t z", "a " * 9000,
    "Σας ΣΑΣ. \x1c naïve NAÏVE ﬁn ǅ", "q" * 20000, "Hello, world! It's 3.5%%% the###\nend.",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.default_tokenizer())


@given(st.text(alphabet=st.sampled_from(list("aBé'sST.,%#́ \n\tÄßß1½²Σ中İ​")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_word_encoder_equals_tokenizer(text):
    got = np.frombuffer(packing.encoder(packing.default_tokenizer()).encode(text), "<u4").tolist()
    assert got == packing.encoder(packing.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_tile_documents_and_windows(spark, plain):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(0, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(spark, docs).toPandas()
    ids = {i: np.asarray(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, _ in rows}
    assert got[(got.start == 0) & (got.doc_id == 0)].shape[0] == 2
    for doc, own in got[got.doc_id > 0].groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids[doc]) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[doc][a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096


def test_no_documents(spark):
    assert packing.pack_documents(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    rows, sequences = packing.plan(histogram, 64)
    for length, n in histogram.items():
        spans = sorted((r[1], r[2]) for r in rows if r[0] == length)
        assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]] and spans[-1][1] == n
    filled = {}
    for length, a, b, times, first, offset in rows:
        for s in range((b - a) // times):
            filled.setdefault(first + s, []).append((offset, length * times))
    assert len(filled) == sequences
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_fill_leaves_least_slack(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    picked = packing.fill(sorted(counts, reverse=True), counts, room, set())
    assert sum(k * v for k, v in picked.items()) == max(sums) and all(v <= counts[k] for k, v in picked.items())
