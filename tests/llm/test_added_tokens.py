"""Ids of texts that hold the content of added tokens, against the library's."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracklane.llm import tokens

TEXTS = ["one <|endoftext|> two", "", "plain words", "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|EndOfText|>", "<|endoftext", "|> apart", "x <|endoftext|> y", "last, one!"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens(name):
    path = public_tokenizers.path(name)
    data = [t.encode() for t in TEXTS]
    ids, firsts = tokens.encode_flat(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])], path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == want
