"""The queries over whole tables, on texts whose marks lie past every prefix."""

import re

import pandas as pd
import pytest

from quillon.plans import registry

FILL = "words " * 120


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """Documents that differ or match only far from their start."""
    at = tmp_path_factory.mktemp("late")
    head = "The same first forty characters of a title"
    texts = {22: f"{head} one\n{FILL}", 35: f"{head} two\n{FILL}", 10: f"x\n{FILL}the und ment", 12: f"x\n{FILL}the und ment ###"}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(at / "documents.parquet")
    return str(at)


def rows(spark, sf, name):
    return {r.id: r for r in registry.queries()[name](spark, sf).collect()}


def test_terms_after_the_prefix(spark, late):
    hits = rows(spark, late, "p07_concept_hits")
    assert (hits["p10"].hits, hits["p12"].hits) == (3, 3)
    assert set(rows(spark, late, "p03_p04_p06_filters")) == {"p10"}
    assert set(rows(spark, late, "t01_t02_u01_federated_search")) == {"p10"}
    assert [r.id for r in registry.flagship(spark, late).collect()] == ["p10"]


def test_titles_are_not_cut(spark, late):
    keys = rows(spark, late, "f01_doi_f02_preprint_f03_title_f04_key")
    assert keys["p22"].title_key != keys["p35"].title_key
    assert all(r.value != keys["p22"].title_key for r in registry.queries()["a05_duplicate_violations"](spark, late).collect())


def test_citations_and_words_after_the_prefix(spark, tmp_path):
    texts = {3: f"[ab12] first {FILL} [zz9] and [link](u) [7] end", 4: f"{FILL}last"}
    pd.DataFrame([(i, t) for i, t in texts.items()], columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(3, "new"), (5, "other")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    queries = registry.queries()
    got = {(r.doc_id, r.cited) for r in queries["f07_j07_bracket_citations"](spark, str(tmp_path)).collect()}
    want = set()
    for i, t in texts.items():
        t += f" [p{i % 50}] and [10.1000/x{i % 9}] [12] [todo] [link](http)"
        want |= {(i, x) for x in re.findall(r"\[([^\[\]]+)\](?!\()", t) if not x.isdigit() and x != "todo"}
    assert got == want and {(3, "ab12"), (3, "zz9")} <= got
    index = {r.doc_id: r.abstract for r in queries["f27_inverted_index"](spark, str(tmp_path)).collect()}
    assert index == {i: " ".join(t.split()) for i, t in texts.items()}
    up = {(r.id, r.text, r.is_new) for r in queries["k10_a04_upsert"](spark, str(tmp_path)).collect()}
    assert up == {(3, texts[3], False), (4, texts[4], False), (5, "other", True)}
