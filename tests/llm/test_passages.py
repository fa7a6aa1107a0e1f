"""Passages: words that collide in a polynomial hash, repeated doc_ids, long texts and common windows, against plain versions."""

import random

import numpy as np
import pytest
from brute import near, repeated_bytes, repeated_words
from pyspark.sql import functions as F

from tracklane.llm import minhash, repeats, textkernel
from tracklane.llm.fm_index import FMIndex

WORD = "a"
while len(WORD) < 2048:
    WORD += WORD.translate(str.maketrans("ab", "ba"))
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def both(spark, rows):
    words = repeats.substring_dedup(frame(spark, rows)).withColumn("h", F.sha2("kept", 256))
    raw = repeats.suffix_array_dedup(frame(spark, rows)).withColumn("h", F.sha2("kept", 256))
    pick = lambda df, *c: sorted(map(tuple, df.select("doc_id", *c).collect()))
    return pick(words, "n_tokens", "n_removed", "h"), pick(raw, "n_tokens", "n_removed", "n_spans", "h")


def plain(texts, *ids):
    flat = lambda found: sorted((ids[0][d] if ids else d, *found[d]) for d in found)
    return flat(repeated_words(texts)), flat(repeated_bytes(texts))


def test_words_that_collide(spark):
    a, b = (np.frombuffer(w.encode(), np.uint8) for w in (WORD, OTHER))
    ends = np.array([len(WORD)])
    assert textkernel.byte_spans(a).raw(ends * 0, ends) == textkernel.byte_spans(b).raw(ends * 0, ends)
    assert textkernel.word_hashes(a, ends * 0, ends) != textkernel.word_hashes(b, ends * 0, ends)
    same = " ".join(f"w{i}" for i in range(19))
    texts = {1: f"{same} {WORD}", 2: f"{same} {OTHER}", 3: WORD, 4: OTHER, 5: f"{same} {WORD}"}
    assert both(spark, list(texts.items())) == plain(texts)
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, list(texts.items()))).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == near(texts, 85)


def test_numbers_with_equal_hashes(monkeypatch):
    raw = np.frombuffer(b"ab cd ab ef", np.uint8)
    starts = np.array([0, 3, 6, 9])
    monkeypatch.setattr(textkernel, "word_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    n = textkernel.numbers(raw, starts, starts + 2)
    assert n[0] == n[2] and len(set(n.tolist())) == 3


def test_repeated_ids(spark):
    """Each text of a doc_id is a document of its own; equal rows are one."""
    rng = random.Random(2)
    a, b, c = (" ".join(f"{rng.choice('xyz')}{rng.randrange(50)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " " + c), (None, a), (4, None), (4, "")]
    texts = {10: a, 20: a, 21: b, 30: b + " " + c, 40: ""}
    ids = {10: 1, 20: 2, 21: 2, 30: 3, 40: 4}
    words, raw = plain(texts, ids)
    got = both(spark, [r for r in rows if r[0] is not None])
    again = lambda found: sorted(found + [r for r in found if r[0] == 2 and r[-1] == [x for x in found if x[0] == 2 and not x[2]][0][-1]] + [r for r in found if r[0] == 4])
    assert got == (again(words), again(raw))
    near_ = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).where("doc_id IS NOT NULL").select("doc_id", "component_id", "kept").collect()))
    assert near_ == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True)]
    kept = minhash.keep_one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, a), (1, a), (2, b), (2, b), (3, b + " " + c), (4, ""), (4, "")])


@pytest.mark.parametrize("seen", [1_000_000, 3])
def test_common_windows_and_long_texts(spark, monkeypatch, seen):
    """Split owners, in tasks with many runs of texts, ids not in order."""
    monkeypatch.setattr(repeats, "SEEN", seen)
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(24))
    texts = {}
    for d in range(60):
        own = " ".join(rng.choice(("red", "blue", "tea")) + str(rng.randrange(30)) for _ in range(80))
        texts[d] = f"{own[: rng.randrange(200)]} {line} {own} {line if d % 3 else ''} {line[:70]}"
    texts[60] = " ".join(f"{rng.randrange(40)}" for _ in range(60_000)) + " " + line
    rows = list(texts.items())
    rng.shuffle(rows)
    monkeypatch.setattr(textkernel.texts, "__defaults__", (2000,))
    for spec, pick in ((repeats.Spec("word", 20, 8, split_over=3), 0), (repeats.Spec("byte", 50, 18, split_over=3, within=False), 1)):
        out = repeats.remove_repeats(frame(spark, rows).coalesce(2), spec).withColumn("h", F.sha2("kept", 256))
        columns = ("n_tokens", "n_removed", "h") if pick == 0 else ("n_tokens", "n_removed", "n_spans", "h")
        assert sorted(map(tuple, out.select("doc_id", *columns).collect())) == plain(texts)[pick]


def test_owners_in_pieces(monkeypatch):
    grams = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    whole = textkernel.owners(grams, 13)
    monkeypatch.setattr(textkernel, "POSITION_BITS", 7)
    pieces = textkernel.owners(grams, 13)
    assert (grams[pieces] >> np.uint64(7) == grams[whole] >> np.uint64(7)).all() and len(pieces) == len(whole)


def test_matching_statistics():
    rng = np.random.default_rng(3)
    indexed, stream = np.append(rng.integers(1, 4, 300), 0), rng.choice([-1, 1, 2, 3], 200)
    index = FMIndex(indexed, 12)
    length, lo, hi = index.matching_statistics(stream, np.arange(1, 201), 12)
    held = lambda s: [i for i in range(len(indexed) - len(s) + 1) if (indexed[i : i + len(s)] == s).all()]
    for end, n, a, b in zip(range(1, 201), length.tolist(), lo.tolist(), hi.tolist(), strict=True):
        assert n == max(k for k in range(min(12, end) + 1) if k == 0 or held(stream[end - k : end]))
        if n:
            assert sorted(index.order[a:b].tolist()) == held(stream[end - n : end])


def test_statistics_decide_what_is_alone():
    """Windows whose words the shard has elsewhere share a number; of the others statistics end before the window does."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in rng.integers(0, 30, 400)]
    passages = [" ".join(words[a : a + 60]) for a in range(0, 340, 20)] + [" ".join(f"own{k}" for k in range(45))]
    spec = repeats.Spec("word", 20, 5)
    of, offset, group = repeats._equal_windows(pa.array([p.encode() for p in passages], pa.binary()), spec)
    texts = [tuple(passages[d].split()[o : o + 20]) for d, o in zip(of, offset)]
    assert len(texts) == sum(len(p.split()) - 19 for p in passages)
    by_text, by_number = {}, {}
    for t, g in zip(texts, group.tolist()):
        by_text.setdefault(t, set()).add(g)
        by_number.setdefault(g, set()).add(t)
    assert all(len(x) == 1 for x in (*by_text.values(), *by_number.values()))
    symbols = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for p in passages for w in p.split()))}
    flat = np.array([s for p in passages for s in (*(symbols[w] for w in p.split()), 0)])
    ends = np.array([i + 20 for i in range(len(flat) - 20) if 0 not in flat[i : i + 20]])
    length, _, _ = FMIndex(flat, 20).matching_statistics(flat, ends, 20, 2)
    times = {t: texts.count(t) for t in set(texts)}
    assert [n == 20 for n in length] == [times[t] > 1 for t in texts] and 0 < (length < 20).sum() < len(length)


def test_copies_cost_no_passages(spark, monkeypatch):
    """Of equal texts one takes part; passages meet in turns; copies shorter than a window stay."""
    monkeypatch.setattr(repeats, "LEAST", 1)
    rng, sent = random.Random(9), {}
    put = repeats.Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        if name.startswith("passages"):
            sent[rows] = sent.get(rows, 0) + out.count()
        return out

    monkeypatch.setattr(repeats.Scratch, "put", counted)
    texts = [" ".join(rng.choice("abc") + str(rng.randrange(40)) for _ in range(90)) for _ in range(6)]
    texts += [texts[0][:150] + " other " + texts[1][50:], " ".join(f"short{i}" for i in range(19)), "tiny", ""]
    for rows in (1, 5):
        of = {10 * k + d: t for d, t in enumerate(texts) for k in range(rows)}
        assert both(spark, list(of.items())) == plain(of)
    assert sent[1] == sent[5] > 0
