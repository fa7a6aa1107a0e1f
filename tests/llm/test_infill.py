"""Fill-in-middle against a plain version that keeps lists of units."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracklane.llm import infill
from tracklane.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ODD = {
    1: None, 2: "", 3: "a", 4: "ab cd", 5: "has <P> in it", 6: "has <M>", 7: "<S>", 8: "almost <P <S< M> <", 9: "ä\U0001f600b́c\r\n\tx", 10: "\n\n\n",
    11: "x" * 300_000, 12: "a1" * 100_000, 13: ">S><", 14: "<", **{d: "one two<three> four" for d in range(15, 80)},
}


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "n", "x") for d, t in ODD.items()], "doc_id long, text string, n string, form string")


def test_odd_texts(odd):
    out = infill.fill_in_middle(odd)
    got = out.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == {d: plain(d, t) for d, t in ODD.items()}
    assert {r.doc_id: r.again for r in got} == {d: t or "" for d, t in ODD.items()}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_id_repeated_rows_and_no_rows(spark, odd):
    twice = odd.unionByName(odd).unionByName(odd.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    out = infill.fill_in_middle(twice)
    assert out.distinct().count() == len(ODD) + out.where("doc_id IS NULL").distinct().count() and out.count() == 2 * len(ODD) + 5
    assert {r.form for r in out.where("doc_id IS NULL").collect()} == {"plain"}
    assert infill.fill_in_middle(odd.limit(0)).isEmpty()


def test_shares(odd):
    assert {r.form for r in infill.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    cut = infill.fill_in_middle(odd, rate=100, spm_rate=100)
    assert {r.form for r in cut.where("doc_id > 14").collect()} == {"spm"}


def test_lazy(monkeypatch):
    """The second pass stops at the later cut."""
    seen = 0

    class Unit:
        @staticmethod
        def finditer(text):
            nonlocal seen
            for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text):
                seen += 1
                yield m

    monkeypatch.setattr(infill, "UNIT", Unit)
    assert infill.cuts("a b c d e f g h", 2, 3) == (15, 2, 3) and seen == 15 + 3


def test_query(spark):
    import duckdb

    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    want = {}
    for d, t in docs.items():
        *rest, output = plain(d, t)
        want[d] = (*rest, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op11_fill_in_middle"](spark, SF).collect()} == want
    sql = SQL["op11_fill_in_middle"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")
    assert {r[0]: tuple(r[1:]) for r in duckdb.sql(sql).fetchall()} == want
