"""Each stage of the pipeline and all of them, against the operators' plain versions."""

import re
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import base_secrets, near
from pyspark.sql import functions as F
from tokenizers import Tokenizer

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.01"
ITEM = "the first boat carries crates from the harbour to the island every day while the second one sails later"
KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, score double, n long, band string, item_id long, ids binary"


def rows(texts):
    return [(d, t, "en", "web", 1, 0.5, 2, "b", 3, b"x") for d, t in texts]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with nulls, empty texts, repeated rows and ids, and columns whose names clash."""
    folder = tmp_path_factory.mktemp("small")
    body = " ".join(f"word{i}" for i in range(60))
    texts = [(1, None), (2, ""), (3, body), (4, body + " more"), (5, body.replace("word30", "other")), (6, f"x {ITEM} y"), (7, f"the key is {KEY} here"), (8, "token=abcdefgh12 it"), (9, "one"), (9, "one"), (10, "vile rude nasty " * 5), (None, body)]
    spark.createDataFrame(rows(texts), COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, 0) for k in range(2, 9)] + [(10, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, body)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_keeps_the_columns_and_clean_rows(spark, small, name):
    folder, texts = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    every = sorted((d or 0, t or "") for d, t in texts)
    gone = {"toxicity": [], "near_dedup": [4, 5], "decontamination": [6], "secrets": []}[name]
    if name == "secrets":
        every = sorted((d, t.replace(KEY, "[SECRET]").replace("token=abcdefgh12", "[SECRET]")) for d, t in every)
    if name == "toxicity":
        got, every = ([r for r in x if r[0] != 10] for x in (got, every))
    assert got == [r for r in every if r[0] not in gone]
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0


def test_packed_ids(spark, small):
    folder, texts = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert packed(STAGES["packing"](spark, docs, folder)) == encoded(texts)


def packed(out):
    """doc_id and ids of each document, repeated ones included; offsets without gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    found = []
    for d, own in pieces.items():
        times = sum(s == 0 for s, _, _ in own)
        for copy in range(times):
            ids = [x for _, part, _ in sorted(own)[copy::times] for x in part]
            assert len(ids) == own[0][2]
            found.append((d or 0, ids))
    return sorted(found)


def encoded(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    return sorted((d or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts)


def test_whole_run(spark, monkeypatch):
    """Over whole tables: every stage's effect on what its predecessor kept."""
    seen = {}

    def noted(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(n, f)) for n, f in corpus_pipeline.STAGES])
    out = packed(corpus_pipeline.run(spark, SF))
    assert list(seen["toxicity"]) and len(seen["near_dedup"]) < len(seen["toxicity"])
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    clean = [d for d in seen["toxicity"] if labels.get(d) == 0]
    assert sum(d in seen["near_dedup"] for d in clean) >= 0.95 * len(clean)
    groups = near(seen["near_dedup"], corpus_pipeline.NEAR)
    assert set(seen["decontamination"]) == {d for d, (_, c) in groups.items() if c == d}
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    plain = lambda t: " ".join(re.findall("[a-z]+", (t or "").lower()))
    for d, t in seen["decontamination"].items():
        if any(plain(i) and plain(i) in plain(t) for i in items):
            assert d not in seen["secrets"]
    assert len(seen["secrets"]) > 0.8 * len(seen["decontamination"])
    assert seen["packing"].keys() == seen["secrets"].keys()
    assert all(base_secrets(t or "")[0] == (0, 0, 0) for t in seen["packing"].values())
    assert out == encoded(seen["packing"].items())


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_of_few_rows(spark, monkeypatch):
    """Stages that send texts through Python do so while few rows are asked for, and in the end the session is as before."""
    monkeypatch.setattr(corpus_pipeline, "DOCUMENTS", 7)
    monkeypatch.setattr(corpus_pipeline.packing, "ROWS", 7)
    monkeypatch.setattr(corpus_pipeline.packing, "CHUNK", 100)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, asked, runs = spark.conf.get(name), [], []
    put, texts = corpus_pipeline.Scratch.put, corpus_pipeline.packing.textkernel.texts
    monkeypatch.setattr(corpus_pipeline.Scratch, "put", lambda self, df, table: asked.append((table, spark.conf.get(name))) or put(self, df, table))
    docs = spark.createDataFrame(rows([(k, f"text {k} of a few words") for k in range(40)]), COLUMNS)
    docs = STAGES["secrets"](spark, docs, "")
    out = STAGES["packing"](spark, docs, "")
    assert asked == [("rows", "7"), ("pieces", "7")] and spark.conf.get(name) == before
    assert packed(out) == encoded([(k, f"text {k} of a few words") for k in range(40)])
    monkeypatch.setattr(corpus_pipeline.packing.textkernel, "texts", lambda column, most=0: runs.append(most) or texts(column, most))
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(40)), pa.array(["text of a few words"] * 40)], ["doc_id", "text"])
    made = list(corpus_pipeline.packing._pieces(public_tokenizers.path(corpus_pipeline.TOKENIZER), 1, 2048)(iter([batch])))
    assert runs == [100] and len(made) > 1 and sum(b.num_rows for b in made) == 40
