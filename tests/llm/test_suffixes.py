"""Suffix arrays and common prefixes against plain sorting."""

import random

import numpy as np
import pytest

from quillon.llm import suffixes


@pytest.mark.parametrize("base", [2, 7, 2048])
@pytest.mark.parametrize("seed", range(40))
def test_against_sorting(seed, base, monkeypatch):
    monkeypatch.setattr(suffixes, "BASE", base)
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 10, 50, 400])
    alphabet = rng.choice(["a", "ab", "abc", "abcdefgh"])
    s = "".join(rng.choice(alphabet) for _ in range(n))
    if seed % 3 == 0:
        s = (s[: n // 3 + 1] * 5)[:n]
    text = np.frombuffer(s.encode(), np.uint8).astype(np.int64) - 96
    sa = suffixes.suffix_array(text)
    assert sa.tolist() == sorted(range(n), key=lambda i: s[i:])
    got = suffixes.permuted_common_prefixes(text, sa)
    for r in range(1, n):
        a, b = s[sa[r - 1] :], s[sa[r] :]
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[sa[r]] == k


def test_many_names_take_no_passes_of_their_own(monkeypatch):
    """A reduced text of many names isn't induced bucket by bucket: before, it took passes over 2,048 buckets a level."""
    passes, rng = [], random.Random(9)
    plain = suffixes.induced
    monkeypatch.setattr(suffixes, "induced", lambda *a: passes.append(len(a[0])) or plain(*a))
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    s = " ".join(rng.choice(words) for _ in range(6000)).encode()
    sa = suffixes.suffix_array(np.frombuffer(s, np.uint8).astype(np.int64))
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert passes == [len(s), len(s)]


@pytest.mark.parametrize("names", [[0], [1, 0], [0] * 70, [0, 1] * 50, [2, 0, 1] * 40 + [2, 0], [5, 4, 3, 2, 1, 0]])
def test_doubling(names):
    assert suffixes.doubled(np.array(names)).tolist() == sorted(range(len(names)), key=lambda i: names[i:])
