"""A corpus cleaning pipeline: toxic documents go, near duplicates and leaked benchmark passages go,
personal data is replaced, and what is left is encoded. Each stage reads what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.common import dropping, held_out, saved, shared_folder, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone``; rows with a null id stay. ``docs`` may have columns of any names."""
    ids = gone.select(F.col("doc_id").alias("gone")).where("gone is not null").distinct()
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go. The model learns from the labelled rows that are left in ``docs``.

    Each row is judged by its own text, so repeated rows stay or go together and null ids do not
    matter; null and empty texts stay. Very long texts are read whole. An empty table, or one without
    labelled rows of both classes, stays as it is. All columns are kept.
    """
    from veritide.llm.toxicity import clean_rows, fit

    return clean_rows(docs, fit(docs, table(spark, sf_dir, "labels"), held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked documents the one with the smallest id stays.

    Rows that repeat an id with the same text are one document: one of them stays. Rows with a null
    id are linked with nothing and stay, as do texts without words (null, empty); an id whose rows
    hold different texts stays or goes as a whole. Very long texts are compared whole. An empty table
    gives an empty table. All columns are kept, whatever their names.
    """
    from veritide.llm.jaccard import join_components

    found = join_components(docs, 75)
    kept = _without(docs, saved(found.where("component_id < doc_id").select("doc_id"), "copies"))
    key = F.struct(docs["doc_id"], F.xxhash64(docs["text"]))
    often = saved(kept.where(docs["doc_id"].isNotNull()).groupBy(key.alias("again")).count().where("count > 1").select("again"), "repeats")
    if often.isEmpty():
        return kept
    once = kept.join(often, key == often["again"], "left_anti")
    return once.union(kept.join(often, key == often["again"], "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of their ids with them; rows with a null id stay.

    Null and empty texts hold nothing, and repeated rows stay or go together. Very long texts are
    searched whole. Empty tables change nothing. All columns are kept, whatever their names.
    """
    from veritide.llm.decontaminate import matches

    return _without(docs, saved(matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "leaks"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced; the number of characters follows the text.

    Every row stays, repeated ones and those with null ids included; null texts stay null and empty
    ones empty. Very long texts are read whole. An empty table gives an empty table.
    """
    from veritide.llm.pii import sanitise

    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, their number, and a digest of the text that they decode to.

    One row for every row, repeated ones and those with null ids included; null and empty texts have
    no ids. Very long texts are encoded whole. An empty table gives an empty table.
    """
    import public_tokenizers

    from veritide.llm.bpe import encode_texts

    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", encode),
]

#: SQL cannot express the learned stages; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own intermediates go once it is written, and so does the stage before it."""
    docs = table(spark, sf_dir, "documents")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    for k, (_, stage) in enumerate(STAGES):
        with dropping(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(path(f"{folder}/{k - 1}"), True)
    return docs
