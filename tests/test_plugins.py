"""The search data source: three providers' responses, filters in the plan, pages left unread, odd records."""

import json
import os

import pytest

from quillon.sources import plugins


def put(root, provider, page, first, last, body):
    at = f"{root}/provider={provider}/page={page}/first={first}/last={last}"
    os.makedirs(at)
    with open(f"{at}/part-0.txt", "w") as f:
        f.write(body)


FEED = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.1v2</id><title> A &amp;
 B </title><published>2003-05-01</published><summary>s</summary></entry><entry><id>x</id><title> </title></entry></feed>"""


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "openalex", 0, 1999, 2004, json.dumps({"results": [{"id": "W1", "title": "one", "publication_year": 1999, "doi": "10.1/a", "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, {"id": "W2", "title": None}, {"id": "W3", "title": "three", "publication_year": "2004"}]}))
    put(tmp_path, "openalex", 1, "none", "none", json.dumps({"results": [{"id": "W4", "title": "four", "publication_year": None}]}))
    put(tmp_path, "semantic_scholar", 0, 2002, 2002, json.dumps({"data": [{"paperId": "s1", "title": "t", "year": 2002, "citationCount": 1, "externalIds": {"DOI": "10.1/A", "ArXiv": "2401.2"}}, {"title": "no id"}], "token": "more"}))
    put(tmp_path, "arxiv", 0, 2003, 2003, FEED)
    put(tmp_path, "arxiv", 7, 1980, 1990, "not read, or it fails")
    return str(tmp_path)


def read(spark, root, **options):
    plugins.register(spark)
    return spark.read.format("recorded_search").option("root", f"file://{root}").options(**options).load()


def test_three_providers(spark, root):
    os.remove(f"{root}/provider=arxiv/page=7/first=1980/last=1990/part-0.txt")
    got = {r.id: r for r in read(spark, root).collect()}
    assert set(got) == {"W1", "W3", "W4", "s1", "2401.1v2"}
    assert got["W1"].abstract == "a b a" and got["W3"].year == 2004 and got["W4"].year is None
    assert (got["s1"].doi, got["s1"].arxiv_id, got["s1"].cited_by) == ("10.1/A", "2401.2", 1)
    assert (got["2401.1v2"].title, got["2401.1v2"].year, got["2401.1v2"].place) == ("A & B", 2003, 0)
    assert {r.id for r in read(spark, root, providers="arxiv, semantic_scholar").collect()} == {"s1", "2401.1v2"}


@pytest.mark.parametrize(
    ("where", "ids", "pages"),
    [
        ("year >= 2000 AND year <= 2003", {"s1", "2401.1v2"}, 3), ("year = 2004", {"W3"}, 1), ("year > 2002 AND year < 2004", {"2401.1v2"}, 2), ("year IS NOT NULL AND year > 1998", {"W1", "W3", "s1", "2401.1v2"}, 3),
        ("year > 2050", set(), 0), ("provider = 'openalex' AND year < 2000", {"W1"}, 1), ("provider = 'openalex'", {"W1", "W3", "W4"}, 2), ("provider = 'nobody'", set(), 0), ("year > 2000 AND title = 't'", {"s1"}, 3),
    ],
)
def test_filters_reach_the_source(spark, root, where, ids, pages, capsys):
    """Page 7 of arxiv isn't XML: reading it would fail. Its years leave it out of each of these."""
    df = read(spark, root).where(where)
    assert {r.id for r in df.collect()} == ids
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
    assert df.rdd.getNumPartitions() == max(pages, 1) or pages == 0


def test_other_providers_can_be_added(spark, tmp_path):
    @plugins.connector("own")
    def own(body):
        for line in body.splitlines():
            yield line, line.upper(), 2001, None, None, None, ""

    try:
        put(tmp_path, "own", 0, 2001, 2001, "a\nb")
        assert [(r.id, r.title, r.place) for r in read(spark, str(tmp_path)).orderBy("place").collect()] == [("a", "A", 0), ("b", "B", 1)]
    finally:
        del plugins.CONNECTORS["own"]


def test_files_and_tasks_grow_with_bytes(spark, tmp_path):
    """500 pages are recorded in a few files, and read by a few tasks also when each is a file of its own."""
    papers = spark.range(1500).selectExpr(
        "id AS ord", "CASE id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'openalex' ELSE 'semantic_scholar' END AS source", "'p' || id AS id", "'a\tb < ' || id AS title", "'one two one' AS abstract",
        "CASE WHEN id % 7 > 0 THEN CAST(2000 + id % 3 AS INT) END AS year", "'10.1/' || id AS doi", "'2401.' || id AS arxiv_id", "CAST(id AS INT) AS cited_by",
    )
    plugins.record_pages(papers, f"file://{tmp_path}/lines", size=3)
    assert len([f for _, _, files in os.walk(tmp_path) for f in files if f.startswith("part-")]) <= 8 * 9
    df = read(spark, f"{tmp_path}/lines")
    got = {r.id: r for r in df.collect()}
    assert set(got) == {f"p{i}" for i in range(1500)} and {r.page for r in got.values()} == set(range(167))
    for i in (0, 1, 2, 1499):
        assert (got[f"p{i}"].page, got[f"p{i}"].title.replace("\t", " "), got[f"p{i}"].year) == (i // 9, f"a b < {i}", 2000 + i % 3 if i % 7 else None)
    assert [got[f"p{i}"].place for i in (0, 3, 6, 9)] == [0, 1, 2, 0]
    assert df.where("year = 2001").count() == sum(i % 3 == 1 and i % 7 > 0 for i in range(1500))
    for i in range(300):
        put(tmp_path / "files", "openalex", i, 2000, 2000, json.dumps({"results": [{"id": f"W{i}", "title": "t", "publication_year": 2000}]}))
    df = read(spark, f"{tmp_path}/files")
    assert df.rdd.getNumPartitions() < 300 and {(r.id, r.page, r.place) for r in df.collect()} == {(f"W{i}", i, 0) for i in range(300)}


def test_shares():
    """Nothing is left out or twice; a task takes no more files once it has its bytes."""
    of = lambda *sizes: plugins.shares([("arxiv", None, str(i), s) for i, s in enumerate(sizes)])
    for sizes in ((), (5,), (1,) * 256, (1,) * 257, (0,) * 5000, (100 << 20, 1) * 300, (1 << 20,) * 20_000):
        assert [f[2] for s in of(*sizes) for f in s.files] == [str(i) for i in range(len(sizes))]
    assert len(of(*(1,) * 256)) == 256 and len(of(*(1,) * 30_000)) < 300 and len(of(*(100 << 20, 1) * 300)) <= 600
    assert max(len(s.files) for s in of(*(1 << 20,) * 20_000)) <= 32


def test_no_pages(spark, tmp_path):
    assert read(spark, f"{tmp_path}/nothing").count() == 0
