"""The corpus pipeline: toxic documents, near copies, benchmark leaks and secrets go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a written table, made in batches
of few rows (an executor holds each in Spark and in Python); all but the last
keep the columns of documents, clashing extra ones included.  Rows with a null
doc_id can't be compared by id: they are scored, masked and packed, and neither
near-dedup nor decontamination removes them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklane.llm import decontaminate, minhash, packing, secrets, toxicity
from tracklane.llm.common import Scratch, by_ids, small_batches

#: A document with this probability of being toxic, or more, is rejected.
TOXIC = 0.3
#: Percent of shared five-word shingles from which documents are near copies.
NEAR = 80
TOKENIZER = "byte_bpe_50k.json"
#: Documents that a Python worker gets at once.
DOCUMENTS = 2000


def _written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    with small_batches(spark, DOCUMENTS):
        return Scratch(spark, f"pipeline-{name}").put(rows, "rows")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below TOXIC by the classifier fitted on the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, "toxic")
    return _written(toxicity.reject(docs, model, TOXIC), "toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id."""
    return _written(minhash.keep_one_of_each(docs, NEAR), "near-dedup")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _written(by_ids(docs, leaks.select("doc_id").distinct(), "left_anti").select(docs.columns), "decontamination")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return _written(secrets.mask_secrets(docs), "secrets")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    out = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages learn, sketch and tokenize: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
