"""The registered queries against their SQL on the smallest tables, and what the operators define for odd input."""

import glob
import os

import duckdb
import pytest

from quillon.functions import identity, text
from quillon.operators import chunks, retrieval
from quillon.plans import registry
from tools.compare import canonical

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(con.sql(ORACLES[name]).df())


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["id", "key", "n_sources", "rrf"]


def test_keys(spark):
    rows = [("https://doi.org/10.1/AB", "x", "T"), ("10.48550/arXiv.2401.00001v2", "x", "T"), ("", "2401.00001v3", "T"), (None, "x", " The, Title! "), (None, None, "?!")]
    df = spark.createDataFrame(rows, "doi string, id string, title string")
    got = [r[0] for r in df.select(identity.paper_key([df.id], df.doi, df.title)).collect()]
    assert got == ["doi:10.1/ab", "arxiv:2401.00001", "arxiv:2401.00001", "title:the title", ""]


def test_duplicates_keep_the_first_of_equals(spark):
    rows = [("k", 0, "a", "i0", None, "", "", ""), ("k", 1, "b", "i1", None, "", "2401.1", "u"), ("l", 2, "a", "i2", 5, "d", "", "")]
    df = spark.createDataFrame(rows, "key string, ord int, source string, id string, cited_by int, doi string, arxiv_id string, pdf_url string")
    got = {r.key: r for r in retrieval.merged_duplicates(df).collect()}
    assert got["k"].id == "i0" and got["k"].sources == ["a", "b"] and got["k"].arxiv_id == "2401.1" and got["k"].pdf_url == "u"


def test_bracket_citations(spark):
    df = spark.createDataFrame([("a [p1] [12] [x](u) [todo] [p1] [10.1/b-c] [q]",)], "t string")
    assert df.select(text.bracket_citations(df.t)).first()[0] == ["p1", "10.1/b-c"]


def test_packed_chunks(spark):
    df = spark.createDataFrame([(1, "a\n\nbb\n" + "c" * 20), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk, r.content) for r in chunks.packed(df, most=6).collect()]
    assert got == [(1, 0, "a\nbb"), (1, 1, "c" * 20)]
