"""A corpus pipeline of five stages, each one of the training-data operators: toxicity, near duplicates, decontamination, PII, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwright.llm import decontam, jaccardjoin, packing, pii, toxicity
from siftwright.llm.common import give_back, shared_folder, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, all columns.

    The model learns from labels, outside the held-out fold; without both classes nothing is rejected. Null and empty texts stay, repeated
    rows are judged each, a null doc_id is scored but teaches nothing, and texts of any length are read whole. docs needs doc_id and text.
    """
    ship(spark)
    return toxicity.drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more), the document of the least id, all columns.

    Null and empty texts have no shingles and stay. Of rows of one doc_id and text one stays; a doc_id with several texts stays with all of
    them if it is the least of its group. Rows with a null doc_id take no part and stay. Texts of any length are read whole.
    """
    ship(spark)
    groups = jaccardjoin.linked_groups(spark, docs, width=5, least=80)
    kept = groups.filter("component_id = doc_id").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window stands, all columns; null and empty texts, repeated rows and null ids as they are."""
    give_back(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, all columns, with personal data masked; n_chars, if there, follows the new text. A null text stays null."""
    from pyspark.sql import functions as F

    ship(spark)
    give_back(spark)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens; null texts count as empty, repeated rows and null ids have pieces of their own."""
    ship(spark)
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("packing", pack),
]

#: The character model, the Jaccard groups' closure and the tokenizer aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of the documents; each stage is written and read again in the shared folder.

    What a stage has read is removed once its own result is written; the last result that was written stays, as the pieces come from it.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if read:
                remove(spark, read)
            read = f"{folder}/{k}-{name}"
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
