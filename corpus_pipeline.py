"""The corpus pipeline: language filter, near-duplicate removal, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; each
result is written as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``.

Nulls, empties and ties: null and empty texts have no letters and go in the first stage; rows
with a null id are never a near duplicate of another and stay; of equal texts the least id stays;
rows that share an id and a text are judged alike; an empty table goes through all stages and
gives no rows; further columns of ``documents``, of whatever name, pass through unchanged.  Very
long texts are handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, language_id, near_duplicates, packing, substring_dedup
from tallyhouse.llm.tables import long_rows, read, removed, shared_dir

#: Words of a passage that goes when it repeats, and of a shingle; percent of shingles near duplicates share.
PASSAGE_WORDS = 50
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go: foreign texts, letter junk, texts without letters.

    The model learns from labelled rows outside the held-out fold, whatever the document's own label says.
    """
    long_rows(spark)
    labelled = docs.select("doc_id", "text", "lang").where(~language_id.held_out(F.col("doc_id")))
    model = language_id.train(labelled)
    return language_id.keep_languages(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    long_rows(spark)
    return near_duplicates.one_of_each_group(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds too are cut out of the text."""
    long_rows(spark)
    return substring_dedup.without_repeated_words(docs, window=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark occurs go."""
    long_rows(spark)
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their places in as few sequences as can be found."""
    long_rows(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL cannot state the language model, the edit-tolerant search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's table stays."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            removed(spark, f"{base}/{k - 1}")  # what read it is written
    return docs
