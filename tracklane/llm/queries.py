"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, decontaminate, infill, manifest, minhash, packing, pivots, quality, repeats, secrets, toxicity, warc
from .common import Scratch
from .sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["QUERIES", "SQL"]


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.suffix_array_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85)


@_query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(_table(spark, sf_dir, "pages"))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op10_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    bitpack.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return bitpack.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out()), "toxic")
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op3_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def _listing(which: str) -> F.Column:
    chosen = F.filter("spans", lambda s: s["kind"] != "entropy") if which == "base" else F.col("spans")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(_listing("base"), 256).alias("base_sha256"), _listing("all").alias("spans"))


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = manifest.build(_table(spark, sf_dir, "documents"), F.when(tampered, lower).otherwise(F.col("text")))
    out = manifest.verify(made)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@_query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out()), "quality")
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
