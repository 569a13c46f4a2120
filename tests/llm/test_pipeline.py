"""The pipeline's stages against brute force, on a small corpus with planted cases."""

import numpy as np
import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")
from siftwright.llm import common, packing, pii  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(11)
    words = ["".join(r.choice(["ka", "lo", "mi", "ru", "sen", "ta"], 3)) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words, n))
    item = text(14)
    texts, toxic = [], []
    for k in range(240):
        body = text(60).split()
        if k % 4 == 0:
            body[7] = "vekrubel"
        texts.append(" ".join(body))
        toxic.append(int(k % 4 == 0))
    planted = {"toxic": text(20) + " vekrubel", "copy": texts[1], "near": texts[2].rpartition(" ")[0] + " other", "leak": f"{text(20)} {item} {text(20)}", "private": f"{text(9)} write joe@mail.example.com", "null": None, "empty": ""}
    ids = {name: 1000 + k for k, name in enumerate(planted)}
    rows = [(k, t, "xx", "s", len(t)) for k, t in enumerate(texts)] + [(ids[n], t, None, None, None if t is None else len(t)) for n, t in planted.items()]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {k: t for k, t, *_ in rows}, ids


def test_stages_and_result(spark, corpus):
    folder, texts, ids = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = dict(texts)
    drops = [{k for k, t in texts.items() if t and "vekrubel" in t}, {ids["copy"], ids["near"]}, {ids["leak"]}, set()]
    for (name, stage), gone in zip(pipeline.STAGES[:-1], drops, strict=True):
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        kept = {k: t for k, t in kept.items() if k not in gone}
        if name == "pii":
            kept = {k: None if t is None else pii.masked(t) for k, t in kept.items()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id: r.text for r in docs.collect()} == kept, name
    assert "<EMAIL>" in kept[ids["private"]]
    plain = Tokenizer.from_file(packing.default_tokenizer())
    sizes = {k: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    out = pipeline.run(spark, folder).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == sizes


def test_near_copies_between_the_thresholds(spark):
    words = [f"w{k}" for k in range(200)]
    near = words[:90] + [f"x{k}" for k in range(14)] + words[104:]  # five-word similarity 178 / 214, four-word 180 / 214
    far = words[:90] + [f"y{k}" for k in range(20)] + words[110:]  # five-word similarity 172 / 220
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([words, near, far])], "doc_id long, text string")
    assert {r.doc_id for r in pipeline.one_of_each_group(spark, docs, "").collect()} == {0, 2}


def test_stages_on_odd_tables(spark, corpus, tmp_path):
    folder, texts, _ = corpus
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
    same = "one two three four five six seven"
    rows = [(None, None, 1, "a", 2.0, "h", "w", "g"), (None, same, 1, "a", 2.0, "h", "w", "g"), (5, same, 2, "b", 1.0, "h", "w", "g"), (5, same, 2, "b", 1.0, "h", "w", "g"), (6, same.upper(), 3, "c", 0.5, "h", "w", "g"), (7, long, 4, "d", 0.1, "h", "w", "g"), (8, "", 5, "e", 0.2, "h", "w", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, node string, score double, hits string, words string, gram string")
    kept = {"toxicity": 7, "jaccard_join": 5, "decontamination": 7, "pii": 7}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == kept[name], name
        assert stage(spark, docs.limit(0), folder).count() == 0
    left = sorted((r.doc_id or 0, r.text or "") for r in pipeline.one_of_each_group(spark, docs, folder).collect())
    assert left == sorted([(0, ""), (0, same), (5, same), (7, long), (8, "")])
    pieces = pipeline.pack(spark, docs, folder)
    assert pieces.groupBy("doc_id").count().count() == 5 and pieces.agg({"length": "sum"}).first()[0] > 40_000
    assert pipeline.pack(spark, docs.limit(0), folder).count() == 0


def test_empty_corpus(spark, corpus, tmp_path):
    folder, *_ = corpus
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("step", ["checkpoint", "decontamination", "pii"])
def test_the_driver_gives_freed_native_memory_back(spark, corpus, step):
    folder, *_ = corpus
    docs, jvm = spark.read.parquet(f"{folder}/documents.parquet"), spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid = field.get(None), jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(open(f"/proc/{pid}/statm").read().split()[1]) * 4096 / 1e6
    for _ in range(2):
        jvm.System.gc()  # so that the heap itself has nothing to give
    blocks = [unsafe.allocateMemory(60_000) for _ in range(6_000)]
    for b in blocks:
        unsafe.setMemory(b, 60_000, 1)
    for b in blocks[:-1]:  # the last keeps the C library from returning what lies below it
        unsafe.freeMemory(b)
    full = resident()
    common.checkpoint(spark, docs) if step == "checkpoint" else dict(pipeline.STAGES)[step](spark, docs, folder)
    left = resident()
    unsafe.freeMemory(blocks[-1])
    assert left < full - 100, (full, left)  # of 360 MB; the stages have needs of their own meanwhile


def test_virtual_machines_that_cannot_trim(spark, monkeypatch):
    assert "rim" in common.trim_native_heap(spark)
    monkeypatch.setattr(common, "TRIM_NATIVE", "noSuchOperation")
    assert common.trim_native_heap(spark) is None
    assert common.checkpoint(spark, spark.range(3)).count() == 3
