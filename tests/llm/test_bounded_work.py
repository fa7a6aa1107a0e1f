"""Work that must stay bounded: rows of shingles, and windows by blocks."""

import random

import numpy as np
import pyarrow as pa

from tracklane.llm import minhash, repeats, textkernel


def test_shingles_of_near_copies():
    """A shingle that many documents of a run have is one row; of a rare one each document is named."""
    rng = random.Random(4)
    body = [f"w{i}" for i in range(200)]
    texts = []
    for d in range(300):
        own = list(body)
        own[rng.randrange(200)] = f"own{d}"
        texts.append(" ".join(own))
    ids = np.arange(300) * 7
    (out,) = minhash._elements(iter([pa.record_batch([pa.array(ids), pa.array(texts)], ["doc_id", "text"])]))
    h, firsts = minhash.shingle_sets(*textkernel.flat(pa.array(texts)))
    having = {}
    for x, a, b in zip(ids.tolist(), firsts[:-1], firsts[1:], strict=True):
        for e in h[a:b].tolist():
            having.setdefault(e, []).append(x)
    assert out.num_rows == len(having) < len(h) // 20
    for e, c, xs in zip(out["h"].to_numpy().view(np.uint64).tolist(), out["c"].to_pylist(), out["xs"].to_pylist(), strict=True):
        assert c == len(having[e]) and sorted(xs) == (having[e] if c <= minhash.RARE else [])


def test_windows_by_blocks(monkeypatch):
    """Blocks of documents give the runs that a document by itself gives, and no block holds more than it may."""
    rng = np.random.default_rng(2)
    firsts = np.r_[0, np.cumsum(rng.integers(0, 90, 40) * (rng.random(40) < 0.7))]
    raw = rng.integers(97, 100, int(firsts[-1])).astype(np.uint8)
    seen, owners = [], textkernel.owners
    monkeypatch.setattr(textkernel, "BLOCK", 200)
    monkeypatch.setattr(textkernel, "owners", lambda grams, width: seen.append(len(grams)) or owners(grams, width))
    got = textkernel.owned_windows(textkernel.byte_spans(raw), firsts, 20, 7)
    assert 0 < max(seen) <= 200
    want = []
    for d, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        own = textkernel.byte_spans(raw[a:b]).grams(7)
        for w in range(b - a - 19):
            at = a + w + int(np.argmin(own[w : w + 14] >> np.uint64(textkernel.POSITION_BITS)))
            if want and want[-1][0] == d and want[-1][3] == at:
                want[-1][2] = a + w
            else:
                want.append([d, a + w, a + w, at])
    assert np.column_stack(got).tolist() == want


def test_grouped():
    rng = np.random.default_rng(8)
    h, x, y = (rng.integers(0, n, 500) for n in (200, 5, 1000))
    assert (repeats._grouped(h) == np.argsort(h, kind="stable")).all()
    assert (repeats._grouped(h, y, x) == np.lexsort((y, x, h))).all()
    assert (repeats._among(h, x) == np.isin(h, x)).all() and not repeats._among(h, x[:0]).any()
