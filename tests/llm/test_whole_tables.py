"""The registered queries against plain versions, over whole small tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import base_secrets, cosine_links, near, repeated_bytes, repeated_words
from tokenizers import Tokenizer

from tracklane.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SF_SECRETS = "/root/testdata/sf0.01"


def table(name, columns, sf=SF):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf}/{name}.parquet')").fetchall()


@pytest.fixture(scope="module")
def docs():
    return dict(table("documents", "doc_id, text"))


def rows(spark, name, *columns, sf=SF):
    return {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, sf).select(*columns).collect()}


def sql(name, *columns, sf=SF):
    """The SQL twin's rows, in the same form."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return {r[0]: tuple(r[1:]) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()}


def test_toxicity_held_out(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    assert set(got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]) == {True}
    assert got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    toxic = dict(table("labels", "doc_id, toxic", "/root/testdata/sf0.1"))
    held = got[got["held_out"] & got["doc_id"].isin(toxic.keys())]
    truth = held["doc_id"].map(toxic) == 1
    ranks = held["score"].rank()
    n = truth.sum()
    area = (ranks[truth].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    assert area > 0.94  # a few labels are wrong on purpose
    assert (held["predicted"] == truth).mean() > 0.96


def test_minhash(spark, docs):
    columns = ("op2_minhash_near_dedup", "doc_id", "n_shingles", "component_id", "kept")
    assert rows(spark, *columns) == sql(*columns) == {d: (n, c, c == d) for d, (n, c) in near(docs, 85).items()}


def test_embeddings(spark):
    vectors = dict(table("embeddings", "vec_id, embedding", SF_SECRETS))
    columns = ("op3_pivot_near_dedup", "vec_id", "n_links", "component_id", "kept")
    got = rows(spark, *columns, sf=SF_SECRETS)
    want = cosine_links(vectors, 0.9)
    assert sql(*columns, sf=SF_SECRETS) == {v: (n, c, c == v) for v, (n, c) in want.items()}
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[v][0] <= want[v][0] for v in want)
    assert sum(got[v] == (n, c, c == v) for v, (n, c) in want.items()) >= 0.95 * len(want)


def test_word_passages(spark, docs):
    columns = ("op4_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(spark, *columns) == sql(*columns) == repeated_words(docs)


def test_byte_passages(spark, docs):
    columns = ("op5_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(spark, *columns) == sql(*columns) == repeated_bytes(docs)


def test_warc(spark):
    import base64

    pages = table("pages", "page_id, html")
    first = {}
    for p, h in sorted(pages):
        first.setdefault(h or "", p)
    want = {}
    for p, h in pages:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        f = first[h or ""]
        want[p] = (len(data), digest, "response" if f == p else "revisit", None if f == p else f)
    columns = ("op6_warc_revisits", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(spark, *columns) == sql(*columns) == want


def encoded(docs, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for d, t in docs.items()}


def test_packing(spark, docs):
    ids = encoded(docs, "byte_bpe_50k.json", 1)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op7_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    total = sum(map(len, ids.values()))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) * 2048 - total < 9 * 2048


def test_secrets(spark):
    texts = dict(table("documents", "doc_id, text", SF_SECRETS))
    got = rows(spark, "op8_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", sf=SF_SECRETS)
    assert sum(sum(v[:3]) for v in got.values()) > 0
    for d, t in texts.items():
        counts, digest = base_secrets(t or "")
        assert got[d] == (*counts, digest)


def test_token_files(spark, docs):
    ids = encoded(docs, "word_bpe_49k.json", 2)
    at, want = 0, {}
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert rows(spark, "op10_token_bits", "doc_id", "start", "n_tokens", "ids_crc32") == want
