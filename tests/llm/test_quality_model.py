"""op2: held-out accuracy, and the compiled rules against plain Python."""

import math
import random
import re
import unicodedata
import zlib

import pytest

from quillon.llm import quality_model as qm
from tests.llm import awkward


def corpus():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        w = awkward.words(rng, rng.randint(20, 200)).lower().split(" ")
        if not good:
            w = [x + rng.choice(["###", "!!", "***"]) for x in w] if i % 2 else [x.upper() for x in w]
        docs.append((i, " ".join(w), None, None, None, None, None, None, None, None, None))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    got = qm.classify(awkward.frame(spark, docs + awkward.rows()), table).collect()
    assert len(got) == len(docs) + len(awkward.rows())
    right = [g.predicted == dict(labels)[g.doc_id] for g in got if g.held_out and g.doc_id is not None and g.doc_id >= 40]
    assert sum(right) >= 0.95 * len(right)
    for g in got:
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7)
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2)
    kept = qm.keep_predicted(awkward.frame(spark, docs), table)
    assert kept.columns == awkward.frame(spark).columns and 0 < kept.count() < len(docs)


def test_no_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {g.score for g in qm.classify(awkward.frame(spark), none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert min(g.score for g in qm.classify(awkward.frame(spark), ones).collect()) > 0.9
    assert qm.classify(awkward.frame(spark, []), ones).count() == 0


def test_paths_and_expression(spark):
    debug = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.5)\n     If (feature 0 <= 1.5)\n      Predict: 0.0\n     Else (feature 0 > 1.5)\n      Predict: 1.0\n    Else (feature 0 > 2.5)\n     Predict: 1.0\n"
    a = "log_words"
    assert qm.paths(debug) == [((a, "<=", 2.5),), ((a, "<=", 1.5),), ((a, "<=", 2.5), (a, ">", 1.5)), ((a, ">", 2.5),)]
    model = qm.RuleModel(0.5, [(2.0, ((a, "<=", 1.5),)), (-1.0, ((a, ">", 1.0), (a, "<=", 3.0)))])
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.2, 2.0, 9.0)], f"{a} double")
    want = [2.5, 1.5, -0.5, 0.5]
    for (got,), w in zip(rows.select(model.score()).collect(), want, strict=True):
        assert got == pytest.approx(1 / (1 + 2.718281828459045**-w))


def statistics(t):
    """The twelve statistics of a text in plain Python."""
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    per = lambda a, b: a / b if b else 0.0
    many = lambda chars: sum(c in chars for c in t)
    return (
        math.log1p(len(w)), per(sum(map(len, w)), len(w)), per(sum(unicodedata.category(c) == "Lu" for c in t), len(t)), per(many("0123456789"), len(t)),
        per(many("#*$%&|<>~^=_{}[]@"), len(w)), per(many("!?"), len(w)), per(many("."), len(w)), per(len(set(w)), len(w)),
        math.log1p(len(lines)), per(len(set(lines)), len(lines)), per(many(" \t\n\r"), len(t)), per(sum(len(x) > 15 for x in w), len(w)),
    )


def test_statistics_against_plain_python(spark):
    texts = [r[1] for r in awkward.rows()] + ["word " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in qm.with_statistics(rows, "text", [qm.F.col("i")]).collect():
        assert [r[k] for k in qm.STATISTICS] == pytest.approx(list(statistics(texts[r.i] or ""))), r.i


def test_held_out_labels_of_the_given_documents(spark):
    """Trained on the other rows' labels, the model tells the held-out ones apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = qm.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.9 * len(good) * len(bad)
