"""The library's operators and text functions on odd rows: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import chunks, library, ranks
from quillon.sources import payloads


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_ranks_of_ties_nulls_and_nothing(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", None), (None, 7.0), ("b", -1e300), ("b", 1e300), ("b", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((r.g or "", r.v, r["rank"]) for r in ranks.with_rank(df, ["g"], "v").collect())
    assert got == [("", 7.0, 1), ("a", 1.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("b", -1e300, 1), ("b", 0.0, 2), ("b", 1e300, 3)]
    assert ranks.with_rank(df.limit(0), ["g"], "v").count() == 0


def test_percentiles_against_sorting(spark):
    import random

    rng = random.Random(1)
    data = [("a", rng.lognormvariate(0, 3)) for _ in range(501)] + [("b", float(rng.randrange(3))) for _ in range(200)] + [("c", None), ("d", 5.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in ranks.percentiles(df, ["g"], {"p50": ("v", 0.5, "linear"), "p95": ("v", 0.95, "nearest")}).collect()}
    for g in "abcd":
        v = sorted(x for k, x in data if k == g and x is not None)
        if not v:
            assert (got[g].p50, got[g].p95) == (0.0, 0.0)
            continue
        at = (len(v) - 1) * 0.5
        low = v[int(at)]
        assert got[g].p50 == pytest.approx(low + (v[min(int(at) + 1, len(v) - 1)] - low) * (at - int(at)))
        assert got[g].p95 == v[min(int(len(v) * 0.95), len(v) - 1)]
    assert ranks.percentiles(df.limit(0), [], {"p": ("v", 0.5, "linear")}).count() == 0


def test_nearest_and_overlapping(spark):
    left = spark.createDataFrame([(1, "f", 5.0), (1, "g", 100.0), (2, "h", 1.0), (1, "n", None)], "page int, fig string, y double")
    right = spark.createDataFrame([(1, "b", 4.0), (1, "a", 6.0), (1, "c", 4.0), (3, "d", 1.0)], "page int, cap string, cy double")
    got = {(r.fig, r.cap, r.distance) for r in chunks.nearest(left, right, ["page"], "fig", "y", "cap", "cy").collect()}
    assert got == {("f", "a", 1.0), ("g", "a", 94.0)}
    boxes = [(1, i, x, x + 40.0, y, y + 3.0) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 1.0), (39.0, 0.0), (-20.0, 2.0)])]
    df = spark.createDataFrame(boxes, "page int, box int, x0 double, x1 double, y0 double, y1 double")
    for least in (0.5, 20.0, 60.0):
        want = set()
        for _, i, a0, a1, b0, b1 in boxes:
            for _, j, c0, c1, d0, d1 in boxes:
                if i < j and max(0, min(a1, c1) - max(a0, c0)) * max(0, min(b1, d1) - max(b0, d0)) >= least:
                    want.add((i, j))
        assert {(r.a, r.b) for r in chunks.overlapping(df, ["page"], "box", least).collect()} == want


def test_snippets_paths_and_pages(spark):
    head = lambda x: text.neighbour_snippet(x, False)
    tail = lambda x: text.neighbour_snippet(x, True)
    assert values(spark, head, "One. Two! Three?", None, " ", "甲。乙。丙", "a" * 300) == ["One. Two!", "", "", "甲。 乙。", "a" * 240]
    assert values(spark, tail, "One. Two! Three?", "a" * 100 + "." + "b" * 300) == ["Two! Three?", "b" * 240]
    assert values(spark, text.collapsed_path, "http://h/a/a/b/a?x=/c/c", "http://h", "/2401.00001/2401.00001//q") == ["http://h/a/a/b/a?x=/c/c", "http://h", "/2401.00001//q"]
    seen = lambda link: values(spark, lambda x: text.resolved_url(x, F.lit(link)), "https://h.org/a/b/c.html?q#f")[0]
    links = ("d.png", "../d", "/d/./e", "//k/l", "mailto:x", "../../../d", "e/")
    assert [seen(x) for x in links] == ["https://h.org/a/b/d.png", "https://h.org/a/d", "https://h.org/d/e", "https://k/l", "mailto:x", "https://h.org/d", "https://h.org/a/b/e/"]
    assert values(spark, text.page_text, "a \t\r\nb\x00\r\n\n\n\nc\n", None) == ["a\nb\n\nc", ""]


def test_latex(spark):
    rows = [r"\textbf{A \emph{b}} 5\% of $\textbf{x}_i$", r"\href{http://a}{here} and \url{http://b}", "plain $5 and {x}", None, r"\unknown{x} \textbf{" + "y" * 250 + "}"]
    assert values(spark, text.plain_latex, *rows) == [r"A b 5% of $\textbf{x}_i$", "here and http://b", "plain $5 and {x}", "", rows[4]]


def test_appending_twice_changes_nothing(spark):
    old = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "session string, id string, seq_no long")
    new = spark.createDataFrame([("s", "b"), ("s", "d"), ("t", "e"), ("s", "c"), ("s", "d")], "session string, id string")
    once = library.appended(old, new, "session", "id", "id")
    want = [("s", "a", 1), ("s", "b", 2), ("s", "c", 3), ("s", "d", 4), ("t", "e", 1)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, library.appended(once, new, "session", "id", "id").collect())) == want


def test_sections_and_budgets(spark):
    rows = [(1, i, str(i) * 50) for i in range(5)] + [(2, 0, "z" * 500), (3, 0, None)]
    df = spark.createDataFrame(rows, "g int, n int, text string")
    got = sorted((r.g, r.n, len(r.text or "")) for r in library.previous_sections(df, "g", "n", "text", 40, 10, 100).collect())
    assert got == [(1, 3, 41), (1, 4, 41), (1, 2, 11)][2:] + [(1, 3, 41), (1, 4, 41), (2, 0, 41), (3, 0, 0)]
    kept = {(r.g, r.n, r.omitted) for r in library.within_budget(df.where("g < 3"), ["g"], "n", F.length("text"), 120).collect()}
    assert kept == {(1, 0, 3), (1, 1, 3)}


def test_repaired_calls(spark):
    kinds = "g int, n int, role string, call_ids array<string>, call_id string, content string"
    rows = [
        (1, 0, "user", None, None, "q"), (1, 1, "assistant", ["a", "b"], None, ""), (1, 2, "tool", None, "a", "r"), (1, 3, "tool", None, "a", "again"), (1, 4, "tool", None, "z", "orphan"),
        (1, 5, "assistant", ["c"], None, "text"), (1, 6, "assistant", ["d"], None, " "), (2, 0, "tool", None, "e", "too early"), (2, 1, "assistant", ["e"], None, None), (2, 2, "assistant", None, None, "plain"),
    ]
    got = sorted((r.g, r.n, r.role, r.call_ids, r.call_id) for r in library.call_pairs(spark.createDataFrame(rows, kinds), "g", "n").collect())
    assert got == [
        (1, 0, "user", None, None), (1, 1, "assistant", ["a"], None), (1, 2, "tool", None, "a"), (1, 3, "tool", None, "a"), (1, 5, "assistant", [], None), (1, 6, "assistant", [], None),
        (2, 1, "assistant", ["e"], None), (2, 2, "assistant", None, None),
    ]


def test_html_blocks(spark):
    html = "<title>T &amp; U</title><script>no()</script><h2> A  b<br>c</h2>loose<p>x <b>y</b><p>z</p><ul><li>i<li>j</ul><table><tr><th>h<td>1</tr></table><style>p{}</style><blockquote>q</blockquote>tail"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>never closed"), (5, "plain < text")], "page_id long, html string")
    got = {}
    for r in payloads.html_blocks(df).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.text))
    assert got[1] == [("title", "T & U"), ("heading", "A b c"), ("text", "loose"), ("paragraph", "x y"), ("paragraph", "z"), ("item", "i"), ("item", "j"), ("row", "| h | 1"), ("quote", "q"), ("text", "tail")]
    assert got[4] == [("paragraph", "never closed")] and got[5] == [("text", "plain < text")] and 2 not in got and 3 not in got


def test_matches_without_pairs(spark):
    """By brute force over the pairs; copies of one title are never paired."""
    schema = "ord long, id string, title string, doi string, arxiv_id string, year int"
    rows = [(i, f"p{i}", "Same title" if i % 4 else f"Other {i}", f"10.1/{i % 13}" if i % 5 == 0 else "", "2401.00001v2" if i % 17 == 0 else None, None if i % 6 == 0 else 1990 + i % 7) for i in range(60)]
    asks = [(0, f"q{i}", "same  TITLE!" if i % 3 else f"other {i}", f"10.1/{i % 15}" if i % 4 == 0 else None, None, None if i % 9 == 0 else 1990 + i % 9) for i in range(40)]
    catalog, wanted = spark.createDataFrame(rows, schema), spark.createDataFrame(asks, schema).drop("ord")
    hits = library.alias_hits(wanted, catalog).collect()
    fit = lambda h: None in (h.wyear, h.year) or h.wyear == h.year
    first, best = {}, {}
    for h in sorted(hits, key=lambda h: h.ord):
        if h.strong or fit(h):
            first.setdefault(h.wid, h.id)
    for wid in {h.wid for h in hits}:
        own = sorted((h for h in hits if h.wid == wid), key=lambda h: (not h.strong, h.ord))
        if own[0].strong or fit(own[0]):
            best[wid] = own[0].id
    assert dict(library.first_match(wanted, catalog).collect()) == first and dict(library.best_hit(wanted, catalog).collect()) == best
    assert first != best and len(first) == 30

    copies = spark.range(20_000).selectExpr("id AS ord", "concat('p', id) AS id", "'one title' AS title", "'' AS doi", "'' AS arxiv_id", "cast(1990 + id % 30 AS int) AS year")
    assert library.first_match(copies, copies).where("id = concat('p', (cast(substr(wid, 2) AS int)) % 30)").count() == 20_000  # 400 million pairs
    assert library.best_hit(copies, copies).count() == 20_000


def test_inverted_index_moves_no_words(spark):
    """Also of a text without any, which has a row."""
    rows = [(1, ["b", "a", "b", "", "a", "b"]), (2, []), (3, None), (4, [""]), (5, [str(i % 977) for i in range(20_000)])]
    found = spark.createDataFrame(rows, "i int, words array<string>").select("i", text.inverted_index(F.col("words")).alias("m"))
    got = {r.i: r.m for r in found.collect()}
    assert got[1] == {"b": [0, 2, 5], "a": [1, 4], "": [3]} and got[2] == {} and got[3] is None and got[4] == {"": [0]}
    assert got[5] == {str(k): list(range(k, 20_000, 977)) for k in range(977)}


def test_inverted_index_query(spark, tmp_path):
    from quillon.plans import texts

    spark.createDataFrame([(1, " a b  a "), (2, None), (3, "")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = texts.inverted(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.abstract for r in found.collect()} == {1: "a b a", 2: None, 3: ""}
