"""The corpus pipeline: documents become clean, distinct, encoded texts, stage by stage.

Each stage takes the documents its predecessor kept and gives documents, the
last one token digests; ``run`` writes every stage as Parquet in the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stateweave.llm import decontaminate, deobfuscate, line_windows, signature_trees
from stateweave.llm.common import staged
from stateweave.llm.queries import byte_bpe_digests, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents scored 0.5 or more by a classifier of the folder's labels; null and empty texts stay."""
    columns = docs.columns
    model = deobfuscate.fit(docs, table(spark, sf_dir, "labels"))
    scored = deobfuscate.score(docs, model, result="__toxicity")
    return scored.where(F.col("__toxicity.predicted") == 0).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut windows of three lines that stood before; a document with nothing left goes, one without lines stays."""
    columns = docs.columns
    found = line_windows.remove_repeated_windows(docs, result="__kept").where("NOT (__kept.n_removed > 0 AND trim(__kept.text) = '')")
    cut = F.col("__kept.n_removed") > 0
    new = {"text": F.col("__kept.text"), "n_chars": F.when(cut, F.length("__kept.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return found.withColumns(new).select(*columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams at a Jaccard similarity of 0.8 or more, the one with the least doc_id stays.

    Rows equal in doc_id and text are one document; a null doc_id stays.
    """
    linked = staged(signature_trees.link_documents(docs, size=5, above=80, below=100), "near")
    dropped = linked.where("component_id <> doc_id").select("doc_id").distinct()
    # The texts are shuffled once: whole documents meet the dropped ones and their own repeats by doc_id.
    kept = docs.where("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold ten words in a row of a benchmark item."""
    columns = docs.columns
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), result="__found")
    return found.where(F.col("__found.n_hit") == 0).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, by byte-level BPE."""
    return byte_bpe_digests(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode),
]

#: A trained classifier is no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
