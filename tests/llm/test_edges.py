"""Nulls, empty texts, repeated rows, extra columns and empty tables."""

import public_tokenizers
import pytest
from brute import near, repeated_bytes, repeated_words
from pyspark.sql import functions as F

from tracklane.llm import bitpack, decontaminate, minhash, packing, pivots, repeats, secrets, toxicity, warc

LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = {1: None, 2: "", 3: "one two", 4: "one two", 5: LONG, 6: LONG + " more", 7: "a b c d e f g", 8: "A b c d e f G ä ö"}
SCHEMA = "doc_id long, text string, n int, band long, score double"


def frame(spark, texts):
    return spark.createDataFrame([(d, t, 1, 2, 0.5) for d, t in texts.items()] + ([(None, "one two", 1, 2, 0.5), (3, texts.get(3), 1, 2, 0.5)] if texts else []), SCHEMA)


@pytest.fixture(scope="module", params=["some", "none"])
def docs(request, spark):
    return frame(spark, TEXTS if request.param == "some" else {}), TEXTS if request.param == "some" else {}


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.where("doc_id IS NOT NULL").select("doc_id", *columns).collect()}


def test_near(docs):
    df, texts = docs
    assert by_id(minhash.near_duplicates(df), "n_shingles", "component_id") == near(texts, 85)
    assert minhash.keep_one_of_each(df).columns == df.columns


def test_passages(docs):
    df, texts = docs
    words = repeats.substring_dedup(df).withColumn("h", F.sha2("kept", 256))
    assert by_id(words, "n_tokens", "n_removed", "h") == repeated_words(texts)
    raw = repeats.suffix_array_dedup(df).withColumn("h", F.sha2("kept", 256))
    assert by_id(raw, "n_tokens", "n_removed", "n_spans", "h") == repeated_bytes(texts)


def test_per_document(docs):
    df, texts = docs
    n = df.count()
    assert secrets.find_secrets(df).count() == secrets.mask_secrets(df).count() == n
    labels = df.where("doc_id IS NOT NULL").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = toxicity.fit(df, labels, "toxic")
    assert toxicity.reject(df, model, 2.0).columns == df.columns
    assert toxicity.score(df.select("doc_id", "text"), model).where("score BETWEEN 0 AND 1").count() == n
    leaks = decontaminate.contamination(df, df.select(F.col("doc_id").alias("item_id"), "text").where("item_id = 7"))
    assert leaks.count() == n
    assert {r.doc_id for r in leaks.where("contaminated").collect()} == ({7} if texts else set())
    assert packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()


def test_token_files(docs, spark, tmp_path):
    df, texts = docs
    bitpack.write_tokens(df, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    assert bitpack.read_tokens(spark, str(tmp_path / "t")).count() == df.where("doc_id IS NOT NULL").count()


def test_pages(docs):
    df, texts = docs
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert warc.resolve_revisits(pages).count() == pages.count()


def test_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.1])]
    for some in (rows, []):
        out = pivots.near_duplicates(spark.createDataFrame(some, "vec_id long, embedding array<float>"))
        assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {v: ((2, 6) if v > 5 else (0, v)) for v, _ in some}


def test_many_variants_of_one_text(spark):
    """More of a bucket stay apart than are compared freely."""
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for d in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert by_id(minhash.near_duplicates(df), "n_shingles", "component_id") == near(texts, 85)
