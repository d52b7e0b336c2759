"""op3, op6, op9 and op10 against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import exact, mixing, secrets, sharding
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def permuted(n, total):
    import math

    a = max(1, math.isqrt(max(total - 1, 0)) + 1)
    b = max(1, -(-total // a))
    while True:
        l, r = divmod(n, b)
        for i, (add, mul) in enumerate(sharding.ROUNDS):
            f = lambda x: ((x + add) % sharding.PRIME) ** 2 % sharding.PRIME + mul * (x % sharding.PRIME)  # noqa: B023, E731
            if i % 2 == 0:
                l = (l + f(r) % sharding.PRIME) % a
            else:
                r = (r + f(l) % sharding.PRIME) % b
        n = l * b + r
        if n < total:
            return n


def test_sharding(spark):
    data = awkward.rows()
    got = sharding.shard(awkward.frame(spark), 5).collect()
    key = lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    want = Counter()
    for n, r in enumerate(sorted(data, key=key)):
        at = permuted(n, len(data))
        want[(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), "rows", at % 5, at // 5, None)] += 1
    assert Counter(map(tuple, got)) == want
    assert sharding.shard(awkward.frame(spark, []), 5).collect() == []


@pytest.mark.parametrize("total", [1, 2, 3, 24, 1000, 1023])
def test_permutation(spark, total):
    got = [r[0] for r in spark.range(total).select(sharding.permuted(sharding.F.col("id"), total)).collect()]
    assert sorted(got) == list(range(total))
    assert got[:50] == [permuted(n, total) for n in range(min(50, total))]


def test_exact(spark):
    data = awkward.rows()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    got = exact.exact_dedup(awkward.frame(spark)).collect()
    assert len(got) == len(data)
    for r in got:
        t = next(x for x in groups if hashlib.sha256(x.encode()).hexdigest() == r.text_sha256)
        most = max((x for x in groups[t] if x is not None), default=None)
        assert (r.keep_id, r.group_size) == (most, len(groups[t])) and r.doc_id in groups[t]
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    docs = awkward.frame(spark)
    out = exact.keep_distinct(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted(groups)
    assert exact.exact_dedup(awkward.frame(spark, [])).count() == 0


def test_mixing(spark):
    got = mixing.mix_sources(awkward.frame(spark)).collect()
    data = awkward.rows()
    size = lambda r: len(WORD.findall(r[1] or ""))
    by = defaultdict(int)
    for r in data:
        by[r[3]] += size(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(by.values()))
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * by[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * by[s]
        free -= set(over)
        left = sum(by.values()) - sum(target.values())
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    ids = {r[0]: r for r in data}
    taken = defaultdict(int)
    for g in got:
        s = ids[g.doc_id][3]
        assert g.size == size(ids[g.doc_id]) and g.source_size == by[s]
        assert g.target == pytest.approx(target[s])
        assert g.taken <= 3 * g.size and g.taken == g.size * g.copies
        taken[s] += g.taken
    for s in names:
        largest = max((g.size for g in got if ids[g.doc_id][3] == s), default=0)
        assert abs(taken[s] - target[s]) <= largest
    again = mixing.mix_sources(awkward.frame(spark).repartition(5)).collect()
    assert Counter((g.doc_id, g.taken) for g in got) == Counter((g.doc_id, g.taken) for g in again)
    out = mixing.mixed_documents(awkward.frame(spark))
    assert out.columns == awkward.frame(spark).columns
    assert sum(size(r) for r in out.collect()) == sum(taken.values())
    assert mixing.mix_sources(awkward.frame(spark, [])).count() == 0


def base_spans(t):
    low = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in low.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def random_looking(s, ratios, least_total):
    total = sum(ratios[secrets.ALPHABET.index(a) * len(secrets.ALPHABET) + secrets.ALPHABET.index(b)] for a, b in zip(s, s[1:], strict=False))
    both = re.search("[0-9]", s) and re.search("[A-Za-z]", s)
    return total >= least_total and total >= (secrets.LEAST_MEAN if both else secrets.LEAST_MEAN_PLAIN) * (len(s) - 1)


def test_secrets(spark):
    docs = awkward.frame(spark)
    ratios = secrets.train(docs)
    texts = {r[0]: r[1] or "" for r in awkward.rows()}
    got = secrets.scan(docs).collect()
    assert len(got) == len(awkward.rows())
    added = 0
    for g in got:
        t = texts[g.doc_id]
        base = base_spans(t)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(b[1] == x for b in base) for x in range(3)), t
        write = lambda s: ",".join(f"{secrets.KINDS[b]}:{a}:{c}" for a, b, c in sorted(s))
        assert g.base_sha256 == hashlib.sha256(write(base).encode()).hexdigest()
        more = []
        for m in re.finditer(secrets.CANDIDATE, t):
            if random_looking(m[0], ratios, secrets.LEAST_TOTAL):
                met = sorted((b[0], b[2]) for b in base if b[0] < m.end() and m.start() < b[2])
                at, rests = m.start(), []
                for x, y in met:
                    rests.append((at, x))
                    at = max(at, y)
                rests.append((at, m.end()))
                more += [(x, 3, y) for x, y in rests if not met or y - x >= secrets.LEAST_REST and random_looking(t[x:y], ratios, 0)]
        added += len(more)
        assert g.spans == write(base + more)
    assert secrets.scan(awkward.frame(spark, [])).count() == 0
    many = [(1, "x token=abcdef1 " * 3000, None, None, 1, 1, 1, None, None, None, None)]
    g = secrets.scan(awkward.frame(spark, many)).collect()[0]
    assert g.n_assign == 3000 and g.base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{c}" for a, _, c in base_spans(many[0][1])).encode()).hexdigest()
    redacted = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert "hunter22" not in redacted[28] and redacted[0] is None


def test_random_strings_in_whole_texts(spark):
    """Recall and false positives over labelled texts: random keys of several alphabets, some of letters only, some around
    a long hexadecimal run, among prose, names and paths."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(4)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(a) for _ in range(n)) for a, n in ((base62, 20), (base62, 32), (base62 + "+/", 40), (base62[:52], 32)) for _ in range(50)]
    names = [f"the_{a}_of_{b}" for a in ("configuration", "administration", "documentation") for b in ("international_standards", "machine_learning", "environments")]
    names += ["https//www-example-org/articles/archive/index-html", "getElementsByClassName", "AbstractSingletonProxyFactory", "2024-11-28-15-30-00", "----------------", "================"]
    rows = [(10**6 + i, f"some words {k} and more words") for i, k in enumerate(keys)] + [(2 * 10**6 + i, f"some words {k} and more words") for i, k in enumerate(names)]
    around = "".join(rng.choice(base62) for _ in range(14)) + "Z" + "0123456789abcdef" * 2 + "Z" + "".join(rng.choice(base62) for _ in range(14))
    rows.append((3 * 10**6, f"key {around} end"))
    got = {r.doc_id: r.spans for r in secrets.scan(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id >= 1000000").collect()}
    hit = lambda i: "markov" in got[i]
    assert sum(hit(10**6 + i) for i in range(150)) >= 147
    assert sum(hit(10**6 + i) for i in range(150, 200)) >= 45
    assert not [n for i, n in enumerate(names) if hit(2 * 10**6 + i)]
    assert got[3 * 10**6] == "markov:4:19,hex:19:51,markov:51:66"
    rows = [(1, "token = 'abc$1def\\2' x"), (2, f"a {around} b"), (3, None)]
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame([*rows, (4, "password: abcdef1")], "doc_id long, text string"), mark="$1\\").collect()}
    assert clean[3] is None and clean[4] == "password: $1\\"
