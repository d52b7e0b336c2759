"""The pipeline's stages, each against plain Python on its own input."""

import random
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import quality_rules, vocab
from quillon.llm.common import stored
from tests.llm import awkward
from tests.llm.test_near import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    (_, quality), (_, exact), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    path = vocab.default_ranks()

    good = stored(quality(spark, docs, SF))
    paths = {x: vocab.tokenizer_path(x) for x in (quality_rules.ENGLISH, quality_rules.MANY, quality_rules.PIECES)}
    rows = [r for r in rows if quality_rules.judged(r[1], r[2], paths, quality_rules.BANDS)[6]]
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r[0] for r in rows)

    unique = stored(exact(spark, good, SF))
    last = {}
    for r in sorted(rows):
        last[r[1]] = r
    rows = sorted(last.values())
    assert sorted(r.doc_id for r in unique.collect()) == [r[0] for r in rows]

    apart = stored(near(spark, unique, SF))
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    assert sorted(r.doc_id for r in apart.collect()) == [r[0] for r in rows]

    mixed = stored(mix(spark, apart, SF))
    assert mixed.columns == docs.columns
    size = lambda t: len(quality_rules.WORDS.findall(t or ""))
    by = defaultdict(int)
    for r in rows:
        by[r[3]] += size(r[1])
    got = Counter(r.doc_id for r in mixed.collect())
    assert max(got.values()) <= 3
    taken = defaultdict(int)
    for r in rows:
        taken[r[3]] += got[r[0]] * size(r[1])
    assert abs(sum(taken.values()) - sum(by.values())) < 0.2 * sum(by.values())

    out = encode(spark, mixed, SF).collect()
    text = {r[0]: r[1] for r in rows}
    enc = vocab.encoding(path)
    assert Counter(r.doc_id for r in out) == got
    for r in out:
        assert r.ids == enc.encode_ordinary(text[r.doc_id]) and r.text == text[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "text"]


def awkward_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(6)
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in awkward.rows()]
    long = " ".join(f"word{rng.randrange(10**6)}" for _ in range(250_000))
    rows += [(200, long, "en", "s1", 1), (201, long + " tail", "en", None, 1), (202, "x" * 2_000_000, None, "s2", 1), (203, "same line\n" * 200_000, "en", "s0", 1), (None, None, None, None, None)]
    names = ("i", "j", "d", "k", "_id", "rules", "text_digest", "text_key", "mix_copies", "mix_copy", "copies", "shard", "cls", "ord", "tkey")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.withColumns({c: F.lit(c) for c in names}), rows


def test_stages_on_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    (_, quality), (_, exact), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    paths = {x: vocab.tokenizer_path(x) for x in (quality_rules.ENGLISH, quality_rules.MANY, quality_rules.PIECES)}
    good = quality(spark, docs, SF)
    assert good.columns == docs.columns
    want = Counter(r[0] for r in rows if quality_rules.judged(r[1], r[2], paths, quality_rules.BANDS)[6])
    assert Counter(r.doc_id for r in good.collect()) == want

    unique = exact(spark, docs, SF)
    assert unique.columns == docs.columns
    last = {}
    for i, t, *_ in rows:
        t = t or ""
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in unique.collect()) == sorted(last.values())

    apart = near(spark, docs, SF)
    ids = Counter(r.doc_id for r in apart.collect())
    assert apart.columns == docs.columns and ids[200] == 1 and ids[201] == 0 and ids[202] == 1 and max(ids[i] for i in ids if i is not None) == 1

    mixed = mix(spark, docs, SF)
    taken = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert mixed.columns == docs.columns and all(n <= 3 * sum(r[0] == i for r in rows) for i, n in taken.items())

    out = {r.doc_id: r for r in encode(spark, docs, SF).select("doc_id", "n_tokens", "text").where("doc_id >= 200 OR doc_id < 4").collect()}
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.text == text[i] for i, r in out.items()) and out[0].n_tokens == 0


def test_stages_on_empty_tables(spark):
    docs, _ = awkward_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0, name
        assert name == "byte_bpe" or out.columns == docs.columns
