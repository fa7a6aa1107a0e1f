"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of other than ASCII spaces and punctuation, A-Z lower-cased.  The
features of a document are the distinct hashes of its words, word stems (the
first STEM bytes), bigrams and skip-grams (a word and the next but one).  FTRL
keeps a learning rate for each coordinate and an L1 penalty, which leaves few
weights; they are sent to the tasks as two short arrays.

The model is fitted on a bounded sample of the labelled rows: ``sample`` rows at
most with ``text_bytes`` bytes of text in all, chosen by hash of the id, and none
of more than an eighth of that.  It is the only bounded step; all features of a
sampled row are learned from, and every text is scored whole.

Input: documents with doc_id and text, labels with doc_id and a label column,
others ignored.  Null texts are empty and score as such.  Null doc_ids are
scored but never learned.  A document with both labels is learned as 1.  Repeated
rows get the same score each.  Without any
labelled row every score is the same 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel

U = np.uint64
STEM = 5
#: Bytes of text that are scored at once, or one longer document.
CHUNK = 1 << 19
_BREAK = textkernel._SPACE.copy()
_BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 5
    sample: int = 12_000
    text_bytes: int = 1 << 26


def occurrences(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all documents with their document, repeats included."""
    raw = textkernel.lower(raw)
    plain = np.where(_BREAK[raw], np.uint8(32), raw)
    starts, ends, firsts = textkernel.words(plain, offsets)
    bytes_ = textkernel.byte_spans(raw)
    word = textkernel.word_hashes(raw, starts, ends, bytes_)
    stem = textkernel.mix(bytes_.hash(starts, np.minimum(ends, starts + STEM)) ^ U(0x51E3))
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    long = ends - starts > STEM
    parts, docs = [word, stem[long]], [doc, doc[long]]
    for gap in (1, 2):
        pair = textkernel.mix(word[:-gap] * U(3) + word[gap:] * U(5) + U(gap))
        same = doc[:-gap] == doc[gap:]
        parts.append(pair[same])
        docs.append(doc[:-gap][same])
    return (np.concatenate(parts) >> U(64 - bits)).astype(np.int64), np.concatenate(docs)


def _distinct(feature: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc << bits) | feature)
    return both & ((1 << bits) - 1), both >> bits


def _features(p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                feature, doc = _distinct(*occurrences(raw, offsets, p.bits), p.bits)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                f = feature.astype(np.int32)
                blobs = [f[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), batch["label"].slice(i, j - i), pa.array(blobs, pa.binary())], ["doc_id", "label", "features"])

    return run


def train(features: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, and the weights; the bias is the coordinate 2**bits."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for d in order.permutation(len(features)):
            i = np.append(features[d], 1 << p.bits)
            w = weights(i)
            x = 1 / np.sqrt(len(i))
            g = (1 / (1 + np.exp(-np.clip(x * w[:-1].sum() * 8 + w[-1], -35, 35))) - labels[d]) * np.append(np.full(len(i) - 1, 8 * x), 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    all_ = np.arange(len(z))
    w = weights(all_)
    keep = np.flatnonzero(w)
    return keep, w[keep]


def _trained(p: Ftrl):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label"])
        at, w = train([np.frombuffer(x, np.int32) for x in rows["features"]], rows["label"].to_numpy(float), p)
        del rows
        textkernel.give_back()
        return pd.DataFrame({"at": at, "weight": w})

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the documents that ``labels`` covers; returns coordinates and weights."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    chance = min(1.0, 0.9 * p.sample / max(total, 1))
    place = F.xxhash64("doc_id", F.lit(11))
    picked = known.where(F.pmod(place, F.lit(1_000_000)) < int(chance * 1_000_000)).orderBy(place, "doc_id").limit(p.sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most p.sample ids
    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).where(F.col("size") <= p.text_bytes // 8)
    so_far = F.sum("size").over(Window.orderBy(place, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # at most p.sample rows
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= p.text_bytes)
    docs = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = docs.mapInArrow(_features(p), "doc_id long, label int, features binary")
    model = rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_trained(p), "at long, weight double").toPandas()  # one bounded group
    return model["at"].to_numpy(np.int64), model["weight"].to_numpy(float)


def _score(at: np.ndarray, weight: np.ndarray, p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << p.bits) + 1)
        dense[at] = weight
        bias = dense[-1]
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                feature, doc = occurrences(raw, offsets, p.bits)
                count = np.bincount(_distinct(feature, doc, p.bits)[1], minlength=j - i)
                some = dense[feature] != 0
                feature, doc = _distinct(feature[some], doc[some], p.bits)
                total = np.bincount(doc, weights=dense[feature], minlength=j - i)
                margin = 8 * total / np.sqrt(count + 1) + bias
                yield pa.record_batch([pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35)))), *batch.slice(i, j - i).columns], ["score", *batch.schema.names])

    return run


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], p: Ftrl = Ftrl()) -> DataFrame:
    """All columns of ``documents`` and score, the probability of the label, in front."""
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(_score(*model, p), f"score double, {fields}")


def reject(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float, p: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``documents`` with a score below ``threshold``, columns unchanged (one named score included)."""
    at, weight = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scored in _score(at, weight, p)(batches):
            rest = pa.RecordBatch.from_arrays(scored.columns[1:], schema=pa.schema(list(scored.schema)[1:]))
            yield rest.filter(pa.compute.less(scored.column(0), threshold))

    return documents.mapInArrow(run, documents.schema)
