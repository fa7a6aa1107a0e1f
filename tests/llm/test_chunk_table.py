"""Tokenizer work that must stay small: chunks share texts, and a full table keeps what recurs."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from tracklane.llm import bitpack, tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LETTERS = "abcdefghijklmnopqrstuvwxyzABCé中'.,-7"


def ids_of(texts, path):
    data = [t.encode() for t in texts]
    ids, firsts = tokens.encode_flat(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])], path)
    return [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def library(texts, path):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def words(rng, n):
    return ["".join(rng.choices(LETTERS, k=rng.randrange(1, 9))) for _ in range(n)]


@pytest.fixture
def seen(monkeypatch):
    """The texts that the tokenizer gets, from an empty table on."""
    out, encode = [], tokens.ChunkTable.encode
    monkeypatch.setattr(tokens.ChunkTable, "encode", lambda self, texts: out.extend(texts) or encode(self, texts))
    tokens.chunk_table.cache_clear()
    yield out
    tokens.chunk_table.cache_clear()


@pytest.mark.parametrize("name", NAMES)
def test_chunks_share_texts(seen, name):
    rng, path = random.Random(3), public_tokenizers.path(name)
    texts = [" ".join(words(rng, 300)) for _ in range(20)] + ["", " \n\n x", "y "]
    assert ids_of(texts, path) == library(texts, path)
    assert tokens.chunk_table(path).size > 3000 and len(seen) < 500


@pytest.mark.parametrize("name", NAMES)
def test_full_table_keeps_what_recurs(seen, monkeypatch, name):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 400)
    rng, path = random.Random(5), public_tokenizers.path(name)
    common = [f"common{chr(97 + i)}" for i in range(26)]
    for _ in range(12):
        texts = [" ".join(["x", *rng.sample(common, 26), *words(rng, 60)]) for _ in range(2)]
        assert ids_of(texts, path) == library(texts, path)
        assert tokens.chunk_table(path).size <= 400
    assert sum("commona" in t for t in seen) == 1
    many = [" ".join(words(rng, 2000))]  # more than the table keeps, in one call
    assert ids_of(many, path) == library(many, path)
    assert ids_of(["few " + texts[0]], path) == library(["few " + texts[0]], path)
    assert tokens.chunk_table(path).size <= 400


@pytest.mark.parametrize("token", [AddedToken("zz<|end", normalized=False), AddedToken("q", single_word=True)])
def test_other_added_tokens(seen, tmp_path, token):
    """A chunk's end and the separator's start may be a token too; so may a word."""
    tokenizer, path = Tokenizer.from_file(public_tokenizers.path(NAMES[0])), str(tmp_path / "t.json")
    tokenizer.add_tokens([token])
    tokenizer.save(path)
    texts = ["a zz b fizz", "zz", "c q qq, zz<|end d zz", "zz<|e"]
    assert ids_of(texts, path) == library(texts, path)


def test_no_token_that_separates(seen, tmp_path):
    tokenizer, path = Tokenizer.from_file(public_tokenizers.path(NAMES[0])), str(tmp_path / "t.json")
    tokenizer.save(path)
    texts = ["some words, and more words", "", "apart"]
    tokens.chunk_table(path).separator = None
    assert ids_of(texts, path) == library(texts, path)
    assert len(seen) == tokens.chunk_table(path).size
    assert not tokens._borderless("abxab") and tokens._borderless("<|x|>")


def test_token_files_rows(seen):
    """The rows that op10 writes: batches share one table, and their new chunks share texts."""
    rng, path = random.Random(7), public_tokenizers.path(NAMES[1])
    known = words(rng, 2000)
    batches = [[" ".join(rng.choices(known, k=200)) for _ in range(30)] + [None, ""] for _ in range(3)]
    made = list(bitpack._ids(path, 2)(pa.record_batch([pa.array(range(len(b))), pa.array(b, pa.string())], ["doc_id", "text"]) for b in batches))
    got = [np.frombuffer(x, "<u4").tolist() for out in made for x in out["ids"].to_pylist()]
    assert got == [[*x, 2] for x in library([t or "" for b in batches for t in b], path)]
    assert len(seen) < tokens.chunk_table(path).size / 10
