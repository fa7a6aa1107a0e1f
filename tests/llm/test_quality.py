"""The quality classifier: its parts against plain versions, held-out accuracy and odd inputs."""

import zlib
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracklane.llm import quality, textkernel
from tracklane.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def of(texts, bits=18):
    raw, offsets = textkernel.flat(pa.array(texts, pa.string()))
    feature, doc = quality.features(raw, offsets, bits)
    return [set(feature[doc == d].tolist()) for d in range(len(texts))]


def test_features():
    """Documents share features where they share words, pairs or shapes, whatever stands around them."""
    a, b, c, none, empty = of(["Aber nicht", "Ober Nicht", "aber nicht Aber nicht", None, ""])
    assert not none and not empty
    assert len(a) == 2 + 2 + 1 + 1  # words, shapes (Aa, a), a pair of words, a pair of shapes
    assert len(b) == 2 + 1 + 1 + 1
    assert len(a & b) == 1  # the shape of the first word
    assert len(c) == 3 + 2 + 3 + 3 + 2
    again, other = of(["das das", "das die"])
    assert len(again - other) == 3 and len(again & other) == 2  # the pair, and that it is the same word; the word and its shape


def test_features_do_not_depend_on_neighbours():
    texts = ["x" * 100_000, "one two", "ONE!! two##", "äö ü", " \n", "a 1 22 b"] * 3
    assert of(texts) == [of([t])[0] for t in texts]


def test_ratios():
    got = quality.ratios(np.array([3.0, 0, 1]), np.array([0.0, 5, 1]), 1.0)
    p, q = np.array([4, 1, 2]) / 7, np.array([1, 6, 2]) / 9
    assert np.allclose(got, np.log(p / q))


def test_descent_reaches_the_least_loss():
    """Against subgradient steps on the primal problem."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(60)]
    labels = np.array([1 if 3 in r or (5 in r and 7 not in r) else 0 for r in rows])
    ratio, signs = rng.normal(size=20), np.where(labels == 1, 1.0, -1.0)
    x = np.zeros((60, 21))
    for d, r in enumerate(rows):
        x[d, r] = ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) or 1)
    x[:, 20] = 1
    loss = lambda w: 0.5 * w @ w + 2.0 * np.maximum(0, 1 - signs * (x @ w)).sum()
    w, b = quality.descend(rows, labels, ratio, 2.0, 300)
    at, best = np.zeros(21), np.inf
    for t in range(1, 20_000):
        wrong = signs * (x @ at) < 1
        at = at - (at - 2.0 * (signs[wrong] @ x[wrong])) / (t + 50)
        best = min(best, loss(at))
    assert loss(np.append(w, b)) <= best * 1.001


def test_sigmoid():
    rng = np.random.default_rng(5)
    margin = rng.normal(size=20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * margin - 0.5)))).astype(int)
    slope, offset = quality.sigmoid_fit(margin, labels)
    assert abs(slope - 2) < 0.1 and abs(offset + 0.5) < 0.1


def test_held_out(spark):
    got = QUERIES["op13_quality"](spark, SF).toPandas()
    assert set(got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]) == {True}
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    held = got[got["held_out"] & got["doc_id"].isin(good.keys())]
    truth = held["doc_id"].map(good) == 1
    ranks, n = held["score"].rank(), truth.sum()
    assert (ranks[truth].sum() - n * (n + 1) / 2) / (n * (len(held) - n)) > 0.995
    assert (held["predicted"] == truth).mean() > 0.99


ROWS = [(d, "GOOD text of words %d" % d if d % 2 else "bad## words%% %d" % d, 1, "s") for d in range(40)]
SCHEMA = "doc_id long, text string, label int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(None, "GOOD text", 1, "s"), (100, None, 1, "s"), (101, "", 1, "s"), (102, "word " * 50_000, 1, "s")]
    return spark.createDataFrame(ROWS + ROWS[:3] + odd, SCHEMA)


def test_odd_inputs(spark, docs):
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)] + [(3, 0), (None, 1), (101, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality")
    out = quality.score(docs.select("doc_id", "text"), model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[100] == score[101]  # null is empty
    assert min(score[d] for d in range(1, 40, 2) if d != 3) > max(score[d] for d in range(0, 40, 2))
    assert quality.score(docs, model).columns == ["score", "doc_id", "text", "label", "score"]
    assert quality.score(docs.limit(0).select("doc_id", "text"), model).isEmpty()


def test_one_label_or_none(spark, docs):
    only = spark.createDataFrame([(d, 1) for d in range(40)], "doc_id long, quality int")
    two = docs.select("doc_id", "text")
    assert all(r.score > 0.99 for r in quality.score(two, quality.fit(docs, only, "quality")).collect())
    none = quality.fit(docs, only.limit(0), "quality")
    assert {r.score for r in quality.score(two, none).collect()} == {0.5}


def test_sample_is_bounded(spark, docs):
    """The counts are of all rows, the descent sees the sample."""
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, quality int")
    few = replace(quality.Nbsvm(), sample=20)
    assert np.array_equal(quality.fit(docs, labels, "quality", few).ratio, quality.fit(docs, labels, "quality").ratio)
