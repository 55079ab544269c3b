"""From raw documents to token ids: language ID, near-dedup, repeat removal, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; between stages the rows are
written as Parquet to the shared checkpoint folder and read again.  All stages but the last return the columns of
``documents``.

Edge cases: rows without a text or a letter leave in the first stage; an empty table passes through all of them; a null
doc_id ranks after every other, rows that repeat a doc_id are documents of their own, and of rows equal in doc_id and
text one passes the second stage; of two near copies the one of smaller doc_id stays, of equal doc_ids that of the
smaller hash of the text; extra columns, whatever their names, are kept up to the last stage; a text that repeats
elsewhere throughout goes on as an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from querysieve.llm import bpe, decontaminate, langid, runindex, simhash
from querysieve.llm.common import ensure_checkpoint_dir, table
from querysieve.llm.queries import BYTE_BPE, MANY_LANGUAGES


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least a half."""
    vocabulary = public_tokenizers.path(MANY_LANGUAGES)
    return langid.keep_known(docs, langid.fit(docs, vocabulary), vocabulary)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id; five-word shingles, 0.8 or more alike."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the bytes of 200-byte strings that occur elsewhere."""
    return runindex.strip_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of the ids and of the text that they decode to."""
    return bpe.round_trip_digests(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: SQL has no language model, XXH64 or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before:  # nothing reads it any more
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{k}-{name}"
    return docs
