"""Recall of the pivot index on planted pairs, and vectors of several lengths, against all pairs."""

import numpy as np
import pytest
from brute import cosine_links

from tracklane.llm import pivots


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(n, cosine, seed, dim=64):
    """n vectors, each with a partner at that cosine."""
    rng = np.random.default_rng(seed)
    x = unit(rng.normal(size=(n, dim)))
    away = rng.normal(size=(n, dim))
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * away


@pytest.mark.parametrize(("count", "cosine", "least"), [(128, 0.9, 0.93), (128, 0.92, 0.95), (128, 0.95, 0.98), (512, 0.9, 0.92), (2048, 0.9, 0.92)])
def test_recall_of_the_lists(count, cosine, least):
    """As many pivots as some 65,000, a million and 16 million vectors have."""
    rng = np.random.default_rng(count)
    x, y = planted(1500, cosine, 1)
    chosen = pivots._choose(unit(rng.normal(size=(pivots.SAMPLE, 64))), count)
    a, b = pivots.lists(x, chosen), pivots.lists(y, chosen)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= least


def test_against_all_pairs(spark):
    x, y = planted(400, 0.93, 2)
    hub = np.vstack([np.full((1, 64), 0.125)] * 3 + [0.125 + 0.02 * np.random.default_rng(4).normal(size=(700, 64))])  # more than a block of one another's links
    vectors = dict(enumerate(np.vstack([x, y, hub]).astype(np.float32).tolist()))
    vectors |= {5000: [1.0, 0.1], 5001: [1.0, 0.0], -1: [0.0, 1.0], 5002: [3.0, 0.0, 0.0], 5003: [2.0, 0.1, 0.0], 5004: [0.0], 5005: [2.0], 5006: [7.0]}
    got = pivots.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"), 0.9)
    got = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    want = cosine_links(vectors, 0.9)
    wrong = [v for v in want if got[v] != want[v]]
    assert all(got[v][0] <= want[v][0] for v in want)
    assert all(v < 800 for v in wrong) and len(wrong) <= 0.1 * 800
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 6), (1, [0.0, 1.0], 7), (2, [0.1, 1.0], 8), (3, [1.0, 0.1], 9), (None, [1.0, 0.0], 10)]
    out = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out.collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_components_of_any_size(spark):
    """Squares of these are infinite or zero; cosines are not."""
    rows = [(k, [10.0**e * x for x in v]) for k, (e, v) in enumerate([(200, (1.0, 2.0)), (200, (1.0, 2.0000001)), (-200, (1.0, 2.0)), (0, (1.0, 2.0)), (300, (2.0, -1.0)), (-300, (2.0, -1.0))])]
    out = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {**{k: (3, 0) for k in range(4)}, 4: (1, 4), 5: (1, 4)}
