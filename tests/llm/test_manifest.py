"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracklane.llm import manifest
from tracklane.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, i string, leaf double, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Levels of nodes from the bottom to the last one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k : k + 16]) for k in range(0, len(below), 16)])
    return levels


def walk(levels, i, digest):
    """(siblings, what the digest leads to)."""
    siblings = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        left, right = nodes[first:i], nodes[i + 1 : first + 16]
        siblings += left + right
        digest = H(*left, digest, *right)
        i //= 16
    return siblings, digest


def plain(rows, tampered):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) for (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(climb([leaf(r) for r in groups[s]]))
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(groups[s]):
            claimed = row
            if tampered(row) and row[4] is not None:
                claimed = (*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))
            below, digest = walk(trees[k], i, leaf(claimed))
            above, digest = walk(top, k, digest)
            out.append((row[0], leaf(row), trees[k][-1][0], top[-1][0], "".join(below + above), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def fifth(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


def found(df, sent=None):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = manifest.build(df, F.when(tampered, lower).otherwise(F.col("text")))
    return sorted((tuple(r) for r in manifest.verify(made, sent).collect()), key=repr)


def rows_of(sizes):
    rows, d = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            d += 1
            rows.append((d * 7919 % 100_003, s, "en" if d % 3 else None, None if d % 11 == 0 else d, None if d % 13 == 0 else "" if d % 17 == 0 else f"Text {d} ä\n"))
    return rows


CASES = {
    "one": {"a": 1},
    "lone sources": {"a": 1, "b": 1, None: 1},
    "edges of runs": {None: 16, "": 17, "a": 256, "ab": 257, "é": 33, "z": 1, "Z": 15},
    "many sources": {f"s{k}": 1 + k % 3 for k in range(300)},
    "a hot source": {"hot": 5000, **{f"s{k}": 2 for k in range(40)}},
}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", CASES)
def test_trees(spark, name):
    rows = rows_of(CASES[name])
    assert found(frame(spark, rows)) == plain(rows, fifth)


@pytest.mark.parametrize("sent", [0, 20])
def test_levels_joined_by_shuffle(spark, sent):
    rows = rows_of({"hot": 5000, **{f"s{k}": 2 for k in range(40)}})
    assert found(frame(spark, rows), sent) == plain(rows, fifth)


def test_repeated_and_null_ids(spark):
    rows = rows_of({"a": 40, None: 5})
    rows += rows[:10] + [(*r[:4], "other") for r in rows[:10]] + [(None, "a", None, None, t) for t in ("x", "x", None)]
    assert found(frame(spark, rows)) == plain(rows, fifth)


def test_no_rows(spark):
    made = manifest.build(frame(spark, []))
    assert made.root is None and manifest.verify(made).isEmpty()


def test_long_texts(spark):
    rows = [(d, "a", "en", 3_000_000, "Long " * 600_000) for d in (1, 2, 13)]
    assert found(frame(spark, rows)) == plain(rows, fifth)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    want = sorted((*r[:4], H(r[4]), *r[5:]) for r in plain(rows, fifth))
    assert sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, SF).collect())) == want
    assert sorted(con.execute(SQL["op12_merkle_manifest"]).fetchall()) == want
