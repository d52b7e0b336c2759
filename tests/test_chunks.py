"""Markdown into blocks and chunks, against plain Python on awkward texts."""

import random
import re

from quillon.operators import chunks

TEXTS = [
    None, "", " \n\n", "7", "# Only a heading", "# A\n## B\ntext\n# C\nmore", "para one\nstill one\n\npara two",
    "| h | i |\n|---|---|\n| 1 | 2 |\n\ntext between\n\n| 3 | 4 |", "$$\na = b\n\nc\n$$\nafter", "$$\nnever closed\n# not a heading",
    "x" * 5000, "words and more. " * 700, "# T\n" + "\n\n".join(f"paragraph {i} " + "w " * 200 for i in range(9)),
    "| h | i |\n|:--|--:|\n" + "\n".join(f"| {i} | {'v' * (i % 50)} |" for i in range(400)), "$$\n" + "\n".join(f"x_{{{i}}} = {i}" for i in range(900)) + "\n$$",
    "| wide | row |\n|---|---|\n| " + "y" * 6000 + " |", "漢字。" * 1500, "- item\n- item two\n1. first\n```\ncode\n```\n![f](x.png)",
    "0. before\n\n<!-- page: 3 -->\nIV. Results\n\nthree\n\n<!-- page:4 -->\n\n7\n\n<!-- page: 5 -->\n2. Methods\n\n![f](u)\n\n$a$\n\n$$x$$", "II. Head\nsecond line\n\n 3. not a heading", "1. Head\n\n2. Head\n\ntext\n\n3. Next",
]


def plain_blocks(text):
    """(page, kind, text) by empty lines and page marks."""
    out, page = [], 0
    for part in re.split(r"(<!--\s*page:\s*\d+\s*-->)", text or ""):
        if re.match(r"<!--\s*page:", part):
            page = int(re.search(r"\d+", part)[0])
            continue
        for raw in part.split("\n\n"):
            t = raw.strip()
            if t:
                one = len(t.splitlines()) == 1 and re.match(r"(?:[IVXLC]{1,8}\.\s+\S|\d+\.\s+[A-Z])", t)
                kinds = [("display_formula", t[:2] == "$$"), ("table", t[0] == "|"), ("figure", t[:2] == "!["), ("heading", one), ("inline_formula", re.fullmatch(r"\$[^$\n]+\$", t))]
                out.append((page, next((k for k, yes in kinds if yes), "paragraph"), t))
    return out


def test_blocks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in chunks.blocks(df).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.kind, r.text))
        assert r.block == len(got[r.doc_id])
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == plain_blocks(t), (i, t)
    assert chunks.blocks(df.limit(0)).count() == 0


def test_packed_blocks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got, full = {}, {}
    for r in chunks.packed_blocks(df).orderBy("doc_id", "chunk").collect():
        assert r.chunk == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.section, r.content))
        full.setdefault(r.doc_id, []).append((r.chunk_id, r.page_start, r.page_end))
    assert all(i not in got for i in (0, 1, 2, 3)) and got[4] == [("正文", "# Only a heading")]
    assert got[7] == [("正文", "| h | i |\n|---|---|\n| 1 | 2 |\n\ntext between\n\n| h | i |\n|---|---|\n| 3 | 4 |")]
    assert got[18] == [("正文", "0. before"), ("IV. Results", "IV. Results\n\nthree\n\n7"), ("2. Methods", "2. Methods\n\n![f](u)\n\n$a$\n\n$$x$$")]
    assert full[18] == [("18:c0000", None, None), ("18:p0003:s0001", 3, 4), ("18:p0005:s0001", 5, 5)]
    assert got[20] == [("1. Head", "1. Head\n\n2. Head\n\ntext"), ("3. Next", "3. Next")]
    squeeze = lambda s: "".join(s.split())
    for i, found in got.items():
        assert all(len(c) <= 4000 + chunks.TAIL for _, c in found), i
        kinds = {k for _, k, _ in plain_blocks(TEXTS[i])}
        if not kinds & {"table", "display_formula"} and i < 18:
            assert squeeze("".join(c for _, c in found)) == squeeze(TEXTS[i])
    assert all(c.startswith("| h | i |\n|:--|--:|\n| ") and len(c) <= 1200 for _, c in got[13]) and sum(c.count("\n") - 1 for _, c in got[13]) == 400
    assert all(c.startswith("$$\n") and c.endswith("\n$$") and len(c) <= 1200 for _, c in got[14])
    assert chunks.packed_blocks(df.limit(0)).count() == 0


def test_batches(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 10, 400, 700, 701, 5000])) for g in range(30) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "g int, i int, n int")
    got = {(r.g, r.i): r.batch for r in chunks.batches_within(df, "g", "i", df.n, 700).collect()}
    want, state = {}, {}
    for g, i, n in rows:
        batch, held = state.get(g, (-1, 0))
        batch, held = (batch, held + n) if batch >= 0 and held + n <= 700 else (batch + 1, n)
        state[g], want[(g, i)] = (batch, held), batch
    assert got == want


def test_packed_blocks_hold_few_texts_at_once(spark, monkeypatch):
    """Of a batch of any size a worker has the blocks of few texts as Python values; the chunks are the same."""
    import pyarrow as pa

    from quillon.operators import chunks as module

    parts = list(module.few_at_once(iter([pa.RecordBatch.from_pydict({"i": list(range(150))}), pa.RecordBatch.from_pydict({"i": [150]})])))
    assert [p.num_rows for p in parts] == [64, 64, 22, 1] and [i for p in parts for i in p.column(0).to_pylist()] == list(range(151))
    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "concat('# Head ', id, '\\n\\n', repeat(concat('word', id, ' '), 300), '\\n\\nlast line of text ', id) AS text")
    rows = module.packed_blocks(docs).collect()
    assert {r.doc_id for r in rows} == set(range(200)) and all(any(f"{w}{r.doc_id}" in r.content for w in ("Head ", "word", "text ")) for r in rows)
    assert len({(r.doc_id, r.chunk) for r in rows}) == len(rows)
