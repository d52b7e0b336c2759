"""Public byte-level vocabularies as tiktoken encodings, one copy per worker process."""

from __future__ import annotations

import base64
import functools

import numpy as np

#: The pattern that splits text into pre-tokens before merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str) -> str:
    """Path of a public tokeniser file; they lie on every machine, like an installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_ranks() -> str:
    return tokenizer_path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def bare_tokens(path: str) -> np.ndarray:
    """By token id: is it text, but neither letter nor digit?"""
    table = ranks(path)
    bare = np.zeros(max(table.values(), default=0) + 1, bool)
    for raw, i in table.items():
        text = raw.decode("utf-8", "replace")
        bare[i] = bool(text.strip()) and "\ufffd" not in text and not any(c.isalnum() for c in text)
    return bare


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """The sentencepiece processor of a model file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def byte_pieces(path: str) -> frozenset[int]:
    """Ids of the pieces that are single bytes."""
    model = pieces(path)
    return frozenset(i for i in range(model.get_piece_size()) if model.is_byte(i))


#: The mark of a space in pieces, and the longest word in code points whose pieces are counted by ranks.
SPACE, LONGEST_WORD = "\u2581", 1_000


@functools.lru_cache(maxsize=2)
def piece_ranks(path: str):
    """(the merges of a piece model as a byte-level encoding of words that follow a space, pieces by token, single bytes by token).

    Such a model merges neighbouring symbols, the likeliest piece first, as byte-level vocabularies merge by rank. Its symbols are
    characters, so the bytes of each character it knows are merged before all else; a token that is none of its pieces stands for the
    bytes of an unknown character, which the model gives singly."""
    import tiktoken

    model = pieces(path)
    known = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    known.sort(key=lambda i: -model.get_score(i))
    texts = [model.id_to_piece(i).replace(SPACE, " ") for i in known]
    order = {bytes([i]): i for i in range(256)}
    for raw in [t.encode() for t in texts if len(t) == 1]:
        for n in range(2, len(raw) + 1):
            order.setdefault(raw[:n], len(order))
    for t in texts:
        order.setdefault(t.encode(), len(order))
    own = {t.encode() for t in texts}
    single = np.array([0 if raw in own else len(raw) for raw in order], np.int64)
    return tiktoken.Encoding(path, pat_str=r" [^ ]+", mergeable_ranks=order, special_tokens={}), np.maximum(single, 1), single


def piece_counts(path: str, words: list[str]) -> tuple[int, int]:
    """(pieces, pieces that are single bytes) of a text's words under a model with byte fallback, whose pieces never cross white
    space. The model itself breaks up words that are very long or hold its mark of a space."""
    encoding_, pieces_of, single = piece_ranks(path)
    odd = [w for w in words if len(w) > LONGEST_WORD or SPACE in w]
    if odd:
        words = [w for w in words if len(w) <= LONGEST_WORD and SPACE not in w]
    ids = encoding_.encode_to_numpy(" " + " ".join(words), disallowed_special=()) if words else np.zeros(0, np.int64)
    n, fallen = int(pieces_of[ids].sum()), int(single[ids].sum())
    for w in odd:
        own = pieces(path).encode(w)
        n, fallen = n + len(own), fallen + sum(i in byte_pieces(path) for i in own)
    return n, fallen
