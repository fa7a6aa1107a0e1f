"""Quality: a support vector machine over n-gram indicators scaled by naive Bayes.

A document is the set of its n-grams: words and pairs of words as they are, and one
to three shapes of words in a row.  A shape has one letter for each run of upper-case
letters, lower-case ones (all beyond ASCII among them) or digits, and punctuation as
it is, and tells whether the word is the one before it again.  N-grams are hashed to 2**bits features.

The log-count ratio of a feature, log((a + p) / |a + p|) - log((a + q) / |a + q|), has p
and q, the numbers of documents of either label with it, counted over all labelled
rows.  Indicators are multiplied by it, each document is brought to length one, and
dual coordinate descent fits a linear model with hinge loss.  That, and the sigmoid
that turns margins into probabilities, sees a bounded sample of the labelled rows:
``sample`` rows at most, chosen by hash of the id, none of more than ``row_bytes``
bytes and together of about ``text_bytes``.  It is the only bounded step; every text is scored whole.

Input: documents with doc_id and text, labels with doc_id and a label column, others
ignored.  Null texts are empty and score as such.  Null doc_ids are scored but never
learned.  A document with both labels is learned as 0.  Repeated rows get the same
score each.  Without rows of both labels every score is their common label, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import SENT_IDS

U = np.uint64
#: Bytes of text that are looked at at once, or one longer document.
CHUNK = 1 << 19
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_RUNS = np.isin(np.arange(256), [ord(c) for c in "Aa0"])


@dataclass(frozen=True)
class Nbsvm:
    bits: int = 18
    alpha: float = 1.0
    cost: float = 1.0
    epochs: int = 10
    sample: int = 12_000
    text_bytes: int = 1 << 26
    row_bytes: int = 1 << 23


@dataclass(frozen=True)
class Model:
    """ratio and weight by feature, the bias, and slope and offset of the sigmoid."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all documents in order of document and feature, and their documents."""
    starts, ends, firsts = textkernel.words(raw, offsets)
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    word = textkernel.word_hashes(raw, starts, ends)
    after = doc[1:] == doc[:-1]
    again = np.concatenate(([False], after & (word[1:] == word[:-1]))) if len(word) else np.zeros(0, bool)
    kind = _CLASS[raw]
    kept = np.ones(len(raw), bool)
    kept[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[kind[1:]]
    kept[starts] = True
    at = np.concatenate(([0], np.cumsum(kept)))
    shape = textkernel.word_hashes(kind[kept], at[starts], at[ends]) ^ (again.astype(U) * U(0x9E3779B97F4A7C15))
    parts, docs = [word, textkernel.mix(shape ^ U(0xA5A5))], [doc, doc]
    for values, gap, salt in ((word, 1, 1), (shape, 1, 2)):
        parts.append(textkernel.mix(values[:-gap] * U(3) + values[gap:] * U(5) + U(salt))[after])
        docs.append(doc[1:][after])
    three = after[1:] & after[:-1]
    parts.append(textkernel.mix(shape[:-2] * U(3) + shape[1:-1] * U(5) + shape[2:] * U(7) + U(3))[three])
    docs.append(doc[2:][three])
    hashed = (np.concatenate(parts) >> U(64 - bits)).astype(np.int64)
    both = np.unique((np.concatenate(docs) << bits) | hashed)
    return both & ((1 << bits) - 1), both >> bits


def _counted(p: Nbsvm):
    """Numbers of documents of either label by feature, those of a task together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << p.bits), np.int64)
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                feature, doc = features(raw, offsets, p.bits)
                good = label[i:j][doc] == 1
                counts[1] += np.bincount(feature[good], minlength=1 << p.bits)
                counts[0] += np.bincount(feature[~good], minlength=1 << p.bits)
        some = np.flatnonzero(counts.any(0))
        yield pa.record_batch([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], ["feature", "p", "q"])

    return run


def ratios(p: np.ndarray, q: np.ndarray, alpha: float) -> np.ndarray:
    p, q = p + alpha, q + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the least hinge loss: dual coordinate descent, a row at a time."""
    signs = np.where(labels == 1, 1.0, -1.0)
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    lengths = [np.sqrt((ratio[r] ** 2).sum()) or 1.0 for r in rows]
    squares = np.array([2.0 if len(r) and ratio[r].any() else 1.0 for r in rows])  # length one and the bias
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for d in order.permutation(len(rows)):
            r, x = rows[d], ratio[rows[d]] / lengths[d]
            gradient = signs[d] * (x @ weight[r] + bias) - 1
            now = min(max(dual[d] - gradient / squares[d], 0.0), cost)
            if now != dual[d]:
                step = (now - dual[d]) * signs[d]
                weight[r] += step * x
                bias += step
                dual[d] = now
    return weight, bias


def margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    return np.array([ratio[r] @ weight[r] / (np.sqrt((ratio[r] ** 2).sum()) or 1.0) + bias for r in rows])


def sigmoid_fit(margin: np.ndarray, labels: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton's method on targets drawn in from 0 and 1."""
    n1, n0 = (labels == 1).sum(), (labels != 1).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.stack((margin, np.ones(len(margin)))), np.array([1.0, 0.0])
    for _ in range(turns):
        prob = 1 / (1 + np.exp(-np.clip(at @ x, -35, 35)))
        curve = (x * (prob * (1 - prob) + 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x @ (prob - target) + 1e-6 * at)
        at = at - step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    return max(float(at[0]), 1e-3), float(at[1])


def train(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, p: Nbsvm) -> Model:
    """The model of all rows; its sigmoid is that of margins of each fifth by a model of the rest."""
    if not len(labels) or labels.min() == labels.max():
        sure = 0.0 if not len(labels) else 35.0 * (1 if labels[0] == 1 else -1)
        return Model(ratio, np.zeros(len(ratio)), 0.0, 1.0, sure)
    fold, margin = np.arange(len(rows)) % 5, np.zeros(len(rows))
    for k in range(5):
        rest = [r for r, f in zip(rows, fold, strict=True) if f != k]
        w, b = descend(rest, labels[fold != k], ratio, p.cost, max(1, p.epochs // 3))
        margin[fold == k] = margins([r for r, f in zip(rows, fold, strict=True) if f == k], ratio, w, b)
    return Model(ratio, *descend(rows, labels, ratio, p.cost, p.epochs), *sigmoid_fit(margin, labels))


def _featured(p: Nbsvm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                feature, doc = features(raw, offsets, p.bits)
                at, f = np.searchsorted(doc, np.arange(j - i + 1)).tolist(), feature.astype(np.int32)
                blobs = [f[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), batch["label"].slice(i, j - i), pa.array(blobs, pa.binary())], ["doc_id", "label", "features"])

    return run


def _trained(ratio: np.ndarray, p: Nbsvm):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label", "features"])
        m = train([np.frombuffer(x, np.int32) for x in rows["features"]], rows["label"].to_numpy(), ratio, p)
        at = np.append(np.flatnonzero(m.weight), [-1, -2, -3])
        textkernel.give_back()
        return pd.DataFrame({"at": at, "value": np.append(m.weight[at[:-3]], [m.bias, m.slope, m.offset])})

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str, p: Nbsvm = Nbsvm()) -> Model:
    """Fit on the documents that ``labels`` covers."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    total = known.count()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known) if total <= SENT_IDS else known, "doc_id")
    counted = docs.mapInArrow(_counted(p), "feature long, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas()  # 2**bits rows at most
    counts = np.zeros((2, 1 << p.bits))
    counts[:, counted["feature"].to_numpy(np.int64)] = counted[["p", "q"]].to_numpy(float).T
    ratio = ratios(*counts, p.alpha)

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    fair = docs.where(size <= p.row_bytes)
    n, held = fair.agg(F.count("*"), F.sum(size)).first()
    share = min(1.0, 0.9 * p.sample / max(n, 1), 0.9 * p.text_bytes / max(held or 0, 1))
    picked = fair.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(p.sample)
    rows = picked.mapInArrow(_featured(p), "doc_id long, label int, features binary").withColumn("part", F.lit(0))
    found = rows.groupBy("part").applyInPandas(_trained(ratio, p), "at long, value double").toPandas()  # one bounded group
    if not len(found):
        return train([], np.zeros(0), ratio, p)
    at, value = found["at"].to_numpy(np.int64), found["value"].to_numpy()
    weight = np.zeros(1 << p.bits)
    weight[at[at >= 0]] = value[at >= 0]
    return Model(ratio, weight, *(float(value[at == -k][0]) for k in (1, 2, 3)))


def score(documents: DataFrame, model: Model, p: Nbsvm = Nbsvm()) -> DataFrame:
    """All columns of ``documents`` and score, the probability of label 1, in front."""
    gain, square = (model.ratio * model.weight).astype(np.float32), (model.ratio**2).astype(np.float32)
    bias, slope, offset = model.bias, model.slope, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in textkernel.texts(batch["text"], CHUNK):
                feature, doc = features(raw, offsets, p.bits)
                length = np.sqrt(np.bincount(doc, weights=square[feature], minlength=j - i))
                margin = np.bincount(doc, weights=gain[feature], minlength=j - i) / np.where(length > 0, length, 1.0) + bias
                yield pa.record_batch([pa.array(1 / (1 + np.exp(-np.clip(slope * margin + offset, -35, 35)))), *batch.slice(i, j - i).columns], ["score", *batch.schema.names])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"score double, {fields}")
