"""Very long texts, empty benchmarks, labels that contradict each other, and the FTRL steps one by one."""

import math
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from brute import near
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklane.llm import bitpack, decontaminate, minhash, packing, toxicity

LONG = " ".join(f"word{i % 5000} of {i % 7}, and" for i in range(130_000))  # 2.5 MB: more than a chunk


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(1, LONG), (2, LONG + " more"), (3, "short text"), (4, LONG[: len(LONG) // 2])], "doc_id long, text string")


def test_near_copies(long):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(long).collect()}
    assert got == near({r.doc_id: r.text for r in long.collect()}, 85)


def test_tokens(spark, long, tmp_path):
    name = public_tokenizers.path("word_bpe_49k.json")
    bitpack.write_tokens(long, str(tmp_path / "t"), name)
    tokenizer = Tokenizer.from_file(name)
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in long.collect()}
    assert {r.doc_id: r.n_tokens for r in bitpack.read_tokens(spark, str(tmp_path / "t")).collect()} == want
    name = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(name)
    pieces = packing.pack(long, name).withColumn("crc", F.crc32("ids")).collect()
    for r in long.collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes() and {p.doc_tokens for p in own} == {len(ids)}


def test_empty_benchmark_and_equal_items(spark):
    text = "the first boat carries crates from the harbour to the island every day while the second one sails later"
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(5, text), (6, text)], "item_id long, text string")
    assert {r.doc_id: (r.contaminated, r["items"]) for r in decontaminate.contamination(docs, items).collect()} == {1: (True, [5, 6]), 2: (False, [])}
    assert {r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {False}


def plain_ftrl(rows, labels, p):
    """A coordinate and a row at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= p.l1 else (math.copysign(p.l1, zi) - zi) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    order, bias = np.random.default_rng(7), 1 << p.bits
    for _ in range(p.epochs):
        for d in order.permutation(len(rows)):
            x = {int(i): 8 / math.sqrt(len(rows[d]) + 1) for i in rows[d]} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            prob = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(x[i] * w[i] for i in x)))))
            for i, v in x.items():
                g = (prob - labels[d]) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_steps():
    rng = np.random.default_rng(2)
    p = toxicity.Ftrl(bits=6, l1=0.3, epochs=4)
    rows = [np.sort(rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(80)]
    labels = np.array([float(5 in r or 9 in r) for r in rows])
    at, w = toxicity.train(rows, labels, p)
    want = plain_ftrl(rows, labels, p)
    assert sorted(want) == at.tolist() and np.allclose([want[i] for i in at.tolist()], w)
    assert 0 < len(at) < 65  # sparse


def test_contradicting_labels_and_the_sample(spark):
    docs = spark.createDataFrame([(d, f"{'vile' if d % 2 else 'kind'} words {d % 5}") for d in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)], "doc_id long, toxic int")
    both = labels.unionByName(labels.where("doc_id % 2 = 1").withColumn("toxic", F.lit(0)))
    a, b = toxicity.fit(docs, labels, "toxic"), toxicity.fit(docs, both, "toxic")
    assert all(map(np.array_equal, a, b))  # a document with both labels is 1
    few = toxicity.fit(docs, labels, "toxic", replace(toxicity.Ftrl(), text_bytes=8 * 20))
    assert not (np.array_equal(few[0], a[0]) and np.array_equal(few[1], a[1]))
    assert not len(toxicity.fit(docs, labels, "toxic", replace(toxicity.Ftrl(), text_bytes=8))[0])  # every row is too large
