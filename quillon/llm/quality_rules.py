"""Quality rules: base counts, and bands on how a public vocabulary breaks a text up."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import vocab
from quillon.llm.common import WORD, ship_package, unused

#: Symbols that the base counts (fixed value).
SYMBOLS = "#*$%&|<>"
WORDS = re.compile(WORD)


@dataclass(frozen=True)
class Band:
    """What a text of one language or script must keep to; outside any bound it is rejected."""

    ranks: str  # byte-level vocabulary that measures characters per token, bare tokens and entropy
    chars_per_token: float  # at least: below it the vocabulary finds no words
    tokens_per_word: float  # at most
    chars_per_piece: float  # at least, of the words under the vocabulary with byte fallback
    fallback: float  # at most: share of its pieces that are single bytes
    bare: float  # at most: share of tokens with neither letter nor digit
    entropy: float  # at least, in bits: below it a few tokens repeat; less for short texts, see `least_entropy`


ENGLISH, MANY, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
#: Bands by language, then by script for texts of another or no language. The languages' are the extremes of `measured_bands` over
#: every labelled table at hand (sf0.01, sf0.1 and check_s), rounded outwards; the scripts' are wider, as no labels cover them.
BANDS = {
    "en": Band(ENGLISH, 2.0, 3.2, 1.65, 0.05, 0.2, 5.0),
    "de": Band(MANY, 2.1, 3.4, 1.75, 0.05, 0.2, 5.0),
    "fr": Band(MANY, 1.9, 3.7, 1.6, 0.05, 0.2, 5.1),
    "es": Band(MANY, 2.0, 3.2, 1.55, 0.05, 0.2, 5.0),
    "latin": Band(MANY, 1.7, 4.0, 1.3, 0.2, 0.2, 5.0),
    "other": Band(MANY, 0.3, 1e9, 0.24, 0.98, 0.3, 4.5),
}
#: A text with fewer letters of a-z than this share of all its letters is of another script.
LATIN_SHARE = 0.5
#: A short text needs no more than this share of the entropy that its tokens would have if all were different.
ENTROPY_SHARE = 0.7

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, tokens_per_word double, chars_per_piece double, fallback_share double, bare_share double, token_entropy double, band string"


def repeat_words(words: list[str]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    size = np.int64(len(seen))
    _, pair = np.unique(a[:-1] * size + a[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * size + a[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)


def band_of(lang: str | None, text: str, bands: dict[str, Band]) -> str:
    if lang in bands:
        return lang
    letters = sum(map(str.isalpha, text))
    latin = sum(c.isascii() and c.isalpha() for c in text)
    return "latin" if latin >= LATIN_SHARE * letters else "other"


def measures(text: str, words: list[str], n_chars: int, ranks: str, model: str) -> tuple[float, float, float, float, float, float]:
    """(characters per token, tokens per word, word characters per piece, fallback share, share of bare tokens, entropy
    in bits) of a text with these words of `n_chars` code points."""
    if not text:
        return (0.0,) * 6
    bare = vocab.bare_tokens(ranks)
    ids = vocab.encoding(ranks).encode_to_numpy(text, disallowed_special=())
    _, counts = np.unique(ids, return_counts=True)
    p = counts / len(ids)
    n, fallen = vocab.piece_counts(model, words)
    return len(text) / len(ids), len(ids) / max(len(words), 1), n_chars / max(n, 1), fallen / max(n, 1), float(bare[ids].mean()), float(-(p * np.log2(p)).sum())


def least_entropy(band: Band, n_tokens: int) -> float:
    """The band's bound, or what a text of so few tokens can be asked for."""
    return min(band.entropy, ENTROPY_SHARE * math.log2(max(n_tokens, 1)))


def judged(text: str | None, lang: str | None, paths: dict[str, str], bands: dict[str, Band]) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    base = base_counts(text, words)
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    name = band_of(lang, text, bands)
    b = bands[name]
    m = measures(text, words, base[1], paths[b.ranks], paths[PIECES])
    fits = m[0] >= b.chars_per_token and m[1] <= b.tokens_per_word and m[2] >= b.chars_per_piece and m[3] <= b.fallback and m[4] <= b.bare
    return *base, failed, not failed and fits and m[5] >= least_entropy(b, round(len(text) / m[0])), *m, name


def with_rules(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", paths: dict[str, str] | None = None, bands: dict[str, Band] | None = None, name: str = "rules") -> DataFrame:
    """`docs` with a struct column `name` of the base counts, the verdict and the measures; no shuffle.

    Null or empty text: no words, every count 0, base_failed true. A language without a band, or null, is judged by
    script. paths: where the files of the vocabularies named in the bands lie. Repeated rows and ties are judged alike, as each row is judged by itself; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    bands = bands or BANDS
    paths = paths or {x: vocab.tokenizer_path(x) for x in {PIECES, *(b.ranks for b in bands.values())}}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SCHEMA.split(', '))}>")
    def rules(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in parts:
            rows = [judged(t.as_py(), x.as_py(), paths, bands) for t, x in zip(texts, langs, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({name: rules(F.col(text_col), lang)})


def judge(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    measures."""
    name = unused(docs, "rules")
    return with_rules(docs, name=name, **options).select(id_col, f"{name}.*")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns, whatever their names; rows that repeat go or stay together,
    null and empty texts go."""
    name = unused(docs, "rules")
    return with_rules(docs, name=name, **options).where(F.col(f"{name}.kept")).drop(name)


def measured_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", slack: float = 0.08) -> DataFrame:
    """What BANDS are set from: by band, the extremes of the measures over documents labelled good that pass the base
    rules, loosened by `slack` (the share of bare tokens by a half, and no bound on byte fallback below 0.05); only rows whose crc32(id as text) mod 4 is not 2, so that the others can test it."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("labelled"))
    learnable = docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)
    rows = judge(learnable.join(good, F.col(id_col) == F.col("labelled")).drop("labelled"), id_col).where("NOT base_failed")
    down = lambda c: (F.min(c) * (1 - slack)).alias(c)
    up = lambda c: (F.max(c) * (1 + slack)).alias(c)
    return rows.groupBy("band").agg(F.count("*").alias("rows"), down("chars_per_token"), up("tokens_per_word"), down("chars_per_piece"), F.greatest(up("fallback_share"), F.lit(0.05)).alias("fallback_share"), (F.max("bare_share") * 1.5).alias("bare_share"), down("token_entropy"))
