"""The catalogue of papers from real folders, broken ones too, and where a wanted paper lies."""

import json

from quillon.sources import catalog

GOOD = {"deep_read.json": {"source": "fulltext"}, "chunk.json": {"version": 10, "chunks": [{"content": "text"}]}}


def put(root, place, **kinds):
    at = root / place
    at.mkdir(parents=True)
    for kind, value in kinds.items():
        (at / catalog.FILES[kind]).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def paper(**fields):
    return {"paper": fields}


def test_folders_of_files(spark, tmp_path):
    report, chunks = GOOD["deep_read.json"], GOOD["chunk.json"]
    put(tmp_path, "a+b %20ü", report=report, chunks=chunks, metadata=paper(doi="10.1/AB", title="T", year="2001", paperId="x"))
    put(tmp_path, "deep/er/b", report=report, chunks=chunks, metadata=paper(doi="https://doi.org/10.1/ab"))
    put(tmp_path, "c", report="{", chunks=chunks, metadata=paper(doi="10.1/c"))
    put(tmp_path, "d", chunks=chunks, metadata=paper(doi="10.1/d"))
    put(tmp_path, "e", report={"source": "abstract"}, chunks=chunks, metadata=paper(doi="10.1/e"))
    put(tmp_path, "f", report=["no object"], chunks=chunks, metadata="")
    put(tmp_path, "g", report=report, chunks={"version": 9, "chunks": [{"content": "x"}]}, metadata=paper(doi="10.1/g"))
    put(tmp_path, "h", report=report, chunks={"version": 10, "chunks": [{"content": "x"}, {"content": "y" * 4001}]}, metadata=paper(doi="10.1/h"))
    put(tmp_path, "i", report=report, chunks={"version": 10, "chunks": [{"content": "x"}, {}]}, metadata=paper(doi="10.1/i"))
    put(tmp_path, "j", report=report, chunks="broken", metadata=paper(doi="10.1/j"))
    put(tmp_path, "k", report=report, chunks=chunks, metadata={"paper": {}})
    put(tmp_path, "l", report=report, chunks=chunks, metadata={"paperId": " 2401.00001v2 "})
    put(tmp_path, "m", report=report, chunks=chunks, metadata=paper(title="Only a title", year="n.d."))
    put(tmp_path, "n", report=report, chunks=chunks)
    (tmp_path / "n" / "paper.md").write_text("not read")
    found = catalog.files(spark, str(tmp_path))
    assert {r.file for r in found.collect()} == set(catalog.FILES.values())
    got = {r.folder: r for r in catalog.catalogue(found).collect()}
    want = {"a+b %20ü": "ok", "b": "duplicate", "c": "broken_report", "d": "no_report", "e": "not_full_text", "f": "broken_report", "g": "no_usable_chunks", "h": "no_usable_chunks",
            "i": "no_usable_chunks", "j": "no_usable_chunks", "k": "no_metadata", "l": "ok", "m": "ok", "n": "no_metadata"}
    assert {k: r.status for k, r in got.items()} == want
    assert got["a+b %20ü"].key == got["b"].key == "doi:10.1/ab" and got["a+b %20ü"].year == 2001 and "a+b %20ü" in got["a+b %20ü"].aliases
    assert got["l"].key == "arxiv:2401.00001" and got["m"].year is None and got["n"].key == "n"
    assert catalog.catalogue(found.limit(0)).count() == 0
    assert {r.folder: r.status for r in catalog.catalogue(found, version=9).collect()}["g"] == "ok"


def test_located(spark):
    rows = [("r/one", "one", 2000, ["doi:10.1/a", "one"], True), ("r/two", "two", None, ["doi:10.1/a", "two"], True), ("r/three", "three", 2001, ["title:t", "three"], True), ("r/bare", "bare", None, ["bare"], False), ("s/two", "two", None, ["two"], True)]
    places = spark.createDataFrame(rows, "place string, folder string, year int, aliases array<string>, has_file boolean")
    wanted = [(1, "two", ["doi:10.1/a"], None), (2, "x", ["three", "doi:10.1/a"], None), (3, "x", ["doi:10.1/a"], None), (4, "bare", ["title:t"], 1999), (5, "bare", ["title:t"], 2001), (6, "x", ["title:t"], None), (7, None, [], None), (8, "x", None, 1), (9, "one", ["two", "two"], 1)]
    got = {r.wid: (r.place, r.by) for r in catalog.located(spark.createDataFrame(wanted, "wid int, name string, aliases array<string>, year int"), places).collect()}
    assert got == {1: ("r/two", "name"), 2: ("r/three", "alias"), 3: ("r/one", "identity"), 4: ("r/bare", "empty"), 5: ("r/three", "identity"), 6: ("r/three", "identity"), 9: ("r/one", "name")}


def test_names_of_many_places_are_never_paired(spark):
    """Every wanted paper and every place share a name, and a title by year: 400 million pairs, if they were paired."""
    n = 20_000
    places = spark.range(n).selectExpr("concat('r/', lpad(id, 6, '0')) AS place", "concat('f', id) AS folder", "cast(2000 + id % 10 AS int) AS year", "array('title:t', 'doi:10.1/a', concat('f', id)) AS aliases", "true AS has_file")
    wanted = spark.range(n).selectExpr("id AS wid", "'none' AS name", "array(if(id % 2 = 0, 'doi:10.1/a', 'title:t')) AS aliases", "cast(if(id % 3 = 0, null, 2000 + id % 12) AS int) AS year")
    got = {r.wid: (r.place, r.by) for r in catalog.located(wanted, places).collect()}
    want = {i: 0 if i % 2 == 0 or i % 3 == 0 else i % 12 for i in range(n)}
    assert got == {i: (f"r/{at:06d}", "identity") for i, at in want.items() if at < 10}
