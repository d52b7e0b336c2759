"""op5 and op8 against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import bpe, quality_rules, vocab
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 2_048), (40, 15), (7, 3)])
def test_encoding(spark, chunk, overlap):
    docs = awkward.frame(spark)
    enc = vocab.encoding(vocab.default_ranks())
    want = Counter()
    for r in awkward.rows():
        t = r[1] or ""
        ids = enc.encode_ordinary(t)
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(docs, chunk=chunk, overlap=overlap).collect())) == want
    assert bpe.digests(awkward.frame(spark, [])).count() == 0


def test_rules(spark):
    got = {r.doc_id: r for r in quality_rules.judge(awkward.frame(spark)).collect()}
    for row in awkward.rows():
        t = row[1] or ""
        w = WORD.findall(t)
        n = len(w)
        seen = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        cover = {j for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[row[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (n < 50 or 100 * len(cover) > 50 * n)
        assert not (g.base_failed and g.kept)
        if t:
            ids = vocab.encoding(vocab.tokenizer_path(quality_rules.BANDS[g.band].ranks)).encode_ordinary(t)
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert g.token_entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
            assert g.chars_per_token == pytest.approx(len(t) / len(ids))
    assert quality_rules.judge(awkward.frame(spark, [])).count() == 0
    assert quality_rules.keep_good(awkward.frame(spark)).columns == awkward.frame(spark).columns
    assert len(quality_rules.judge(awkward.frame(spark)).collect()) == len(awkward.rows())


def test_short_prose_is_kept(spark):
    """Entropy is bounded by the number of tokens: short clean prose lies under the bound of long texts."""
    prose = (
        "The river rises in the hills to the north of the town and runs to the sea in the south. In the spring the water is high, "
        "and the people of the town walk along the bank in the evening to look at the boats. In the summer the water is low, and "
        "the children of the town play on the stones in the river until it is dark."
    )
    few = " ".join("river hill town boat"[i : i + 4].strip() or "sea" for i in (0, 6, 11, 16, 0, 11, 6, 16, 6, 0, 16, 11) * 5)
    salad = " ".join(np.random.default_rng(1).choice(prose.split()[:16], 60))
    docs = spark.createDataFrame([(1, prose, "en"), (2, few, "en"), (3, salad, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert 50 <= got[1].n_words <= 70 and got[1].token_entropy < quality_rules.BANDS["en"].entropy
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[3].base_failed


def test_byte_fallback_is_measured(spark):
    """Pieces and single bytes of every word by the model itself, and a text that only falls back."""
    model = vocab.pieces(vocab.tokenizer_path(quality_rules.PIECES))
    got = {r.doc_id: r for r in quality_rules.judge(awkward.frame(spark)).collect()}
    for row in awkward.rows():
        w = WORD.findall(row[1] or "")
        ids = [i for x in w for i in model.encode(x)]
        assert got[row[0]].fallback_share == pytest.approx(sum(map(model.is_byte, ids)) / max(len(ids), 1))
        assert got[row[0]].chars_per_piece == pytest.approx(sum(map(len, w)) / max(len(ids), 1))
    runes = " ".join(chr(0x16A0 + i % 70) * (2 + i % 3) for i in range(80))
    mixed = "The " + " ".join(f"word{i} stone{i} river{i}" if i % 3 else chr(0x16A0 + i % 70) * 4 for i in range(60))
    rows = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame([(1, runes, None), (2, mixed, "en")], "doc_id long, text string, lang string")).collect()}
    assert rows[1].fallback_share > 0.85 and rows[1].band == "other"
    assert 0.05 < rows[2].fallback_share < 0.9 and not rows[2].base_failed and not rows[2].kept


def test_pieces_by_ranks():
    """Counts by ranks are the model's own: every piece of the vocabulary, words of many scripts, long words, marks of spaces."""
    path = vocab.tokenizer_path(quality_rules.PIECES)
    model = vocab.pieces(path)
    rng = np.random.default_rng(2)
    ranges = [range(33, 0x250), range(0x370, 0x530), range(0x4E00, 0x4F00), range(0xAC00, 0xAC40), range(0x1F600, 0x1F640), [0xA0, 0x1C, 0x85, 0x2581]]
    codes = np.concatenate([np.array(r) for r in ranges])
    words = [w for w in ("".join(map(chr, rng.choice(codes, k))) for k in rng.integers(1, 30, 800)) if w]
    words += [w for w in (model.id_to_piece(i).replace(vocab.SPACE, "") for i in range(259, model.get_piece_size())) if w]
    words += ["x" * 3000, "\u6f22" * 1500, "ab\u2581cd", "\u2581", "a\u2581\u2581b"]
    words = [x for w in words for x in WORD.findall(w)]
    for w in words:
        ids = model.encode(w)
        assert vocab.piece_counts(path, [w]) == (len(ids), sum(map(model.is_byte, ids))), w
    each = [model.encode(w) for w in words]
    assert vocab.piece_counts(path, words) == (sum(map(len, each)), sum(sum(map(model.is_byte, ids)) for ids in each))
    assert vocab.piece_counts(path, []) == (0, 0)


def test_bands_against_labels_that_they_were_not_set_from(spark):
    """Of the held-out documents that pass the base rules, those labelled good stay and those labelled bad go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality_rules.judge(docs).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 AND NOT base_failed").join(labels, "doc_id")
    rows = held.select("quality", "kept").collect()
    assert sum(r.kept for r in rows if r.quality) >= 0.98 * sum(r.quality for r in rows)
    assert sum(r.kept for r in rows if not r.quality) <= 0.05 * sum(not r.quality for r in rows)
    bands = {r.band: r for r in quality_rules.measured_bands(docs, labels).collect()}
    for name, r in bands.items():
        b = quality_rules.BANDS[name]
        assert b.chars_per_token <= r.chars_per_token and b.tokens_per_word >= r.tokens_per_word and b.entropy <= r.token_entropy and b.fallback >= r.fallback_share
