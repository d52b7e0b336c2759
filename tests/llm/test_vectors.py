"""op12 and op13 against brute force, and vectors that are null, empty, zero, not finite, repeated or of other lengths."""

import math

import numpy as np
import pytest

from quillon.llm import bidiagonal, forest, neighbours, whitening

SF = "/root/testdata/sf0.01"
ODD = [None, [], [None, 1.0, 2.0], [math.nan, 1.0, 2.0], [math.inf, 0.0, 0.0], [1.0], [1.0, 2.0]]


def frame(spark, rows):
    """Rows of (id, vector) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(a, b, 9, "x", 1.5, 7) for a, b in rows], "vec_id long, embedding array<double>, id int, row string, score double, n int").repartition(3)


def matrices():
    rng = np.random.default_rng(5)
    yield rng.normal(size=(40, 12))
    yield np.diag(10.0 ** -np.arange(8))
    yield np.eye(9)
    yield np.zeros((3, 4))
    yield np.outer(rng.normal(size=9), rng.normal(size=6))
    yield np.hstack([rng.normal(size=(30, 4))] * 2)
    yield rng.normal(size=(2, 7))
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    yield q @ np.diag([3.0] * 5 + [2.0] * 5 + [2.0 * (1 + 1e-9)] * 5 + [1e-5] * 5)
    yield rng.normal(size=(64, 64)) + 1e5
    yield np.tril(np.ones((30, 30)))


@pytest.mark.parametrize("m", list(matrices()), ids=lambda m: "x".join(map(str, m.shape)))
def test_values_and_vectors(m):
    d = m.shape[1]
    want = np.sort(np.linalg.svd(m, compute_uv=False))[::-1] ** 2
    want = np.concatenate([want, np.zeros(d - len(want))])
    values, v = bidiagonal.decomposed(m, d)
    top = max(want[0], 1e-300)
    assert np.allclose(values, want, rtol=1e-11, atol=1e-13 * top)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    assert np.allclose(m.T @ (m @ v), v * values, atol=1e-11 * top)


def test_small_values_are_relatively_accurate():
    """A graded bidiagonal: the smallest value is 1e-40 of the largest, and right to 13 digits."""
    a, b = 10.0 ** -np.arange(0, 21, 2), 10.0 ** -np.arange(1, 21, 2) * 1e-3
    values = bidiagonal.squared_values(a, b)
    from decimal import Decimal, getcontext

    getcontext().prec = 120
    n = len(a)
    low, size = Decimal(0), [Decimal(float(x)) for x in a]
    off = [Decimal(float(x)) for x in b]

    def below(x):  # eigenvalues of B'B under x, by Sylvester's law
        d, count = size[0] ** 2 - x, 0
        for i in range(n):
            count += d < 0
            if i < n - 1:
                d = size[i + 1] ** 2 + off[i] ** 2 - x - (size[i] * off[i]) ** 2 / d
        return count

    low, high = Decimal(0), size[-1] ** 2 * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if below(mid) else (mid, high)
    assert abs(Decimal(float(values[-1])) / high - 1) < Decimal("1e-13")


def whitened(rows, components=8):
    x = np.floor(1024 * np.array(rows, float)) + 100000
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return x, e, (x - x.mean(axis=0)) @ u / np.sqrt(np.maximum(e, 1e-300)), np.cov(x.T, bias=True).reshape(x.shape[1], -1).trace()


def test_whitening_of_the_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(t).toPandas()
    pdf = t.toPandas()
    x, e, w, trace = whitened(pdf.embedding.tolist())
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[pdf.vec_id].to_numpy()
    assert list(got.component.unique()) == list(range(1, 9)) and len(got) == 8 * len(pdf)
    assert np.abs(np.abs(mine) - np.abs(w)).max() < 1e-9
    sign = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine * sign - w).max() < 1e-9  # one sign for all rows
    n, s = len(x), x.astype(int).sum(axis=0)
    want = dict(zip(pdf.vec_id, ((n * x.astype(int) - s) ** 2).sum(axis=1), strict=True))
    assert all(want[r.vec_id] == r.deviation and r.n == n for r in got.itertuples())
    assert np.allclose(got.explained[:8], e / trace, rtol=1e-9) and got.identity_error.max() < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    good = [rng.normal(size=3).tolist() for _ in range(30)]
    good += [good[0], good[0]]
    rows = [(i % 29 if i else None, v) for i, v in enumerate(good)] + [(900 + i, v) for i, v in enumerate(ODD)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    _, e, w, trace = whitened(good)
    assert len(got) == 3 * len(good) and set(got.component) == {1, 2, 3} and not (got.vec_id >= 900).any() and got.vec_id.isna().sum() == 3
    assert np.allclose(sorted(got.explained.unique()), sorted(e / trace))
    assert np.allclose(np.sort(np.abs(got.whitened)), np.sort(np.abs(w).ravel()))
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 1.5])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]


def test_whitening_of_dependent_and_huge_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a), 7.0]) for i, a in enumerate(rng.integers(-5, 6, 40))]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert got.explained[:3].round(12).tolist() == [1.0, 0.0, 0.0] and got.whitened[got.component > 1].isna().all() and got.identity_error.max() < 1e-9
    big = [(i, [float(a) * 1e300, float(b)]) for i, (a, b) in enumerate(rng.integers(-5, 6, (40, 2)))]
    rows = whitening.whiten(frame(spark, big)).collect()
    assert len(rows) == 80 and all(r.deviation is None for r in rows) and rows[0].identity_error < 1e-4


def test_triangles_are_folded_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    good = [rng.normal(size=4).tolist() for _ in range(60)]
    got = whitening.whiten(frame(spark, list(enumerate(good))).repartition(9)).toPandas()
    assert np.allclose(np.sort(np.abs(got.whitened)), np.sort(np.abs(whitened(good)[2]).ravel()))


def brute(rows, k=5, every=50):
    """The nearest by cosine of every usable query."""
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and len(v) == 3 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for n, i, q in good:
        if i is not None and i % every == 0:
            scores = [(-float(q @ v / math.sqrt(q @ q) / math.sqrt(v @ v)), math.inf if j is None else j) for m, j, v in good if m != n]
            out[n] = sorted((round(s, 9), j) for s, j in scores)[:k]
    return sorted((rows[n][0], r + 1, j, -s) for n, found in out.items() for r, (s, j) in enumerate(found))


def found(df):
    return sorted((r.query_id, r.rank, math.inf if r.vec_id is None else r.vec_id, round(r.score, 9)) for r in df.collect())


def test_nearest_of_few_vectors_is_exact(spark):
    """One leaf holds all: null ids, repeated ids and rows, equal and scaled vectors, vectors that take no part."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[50][1]), (70, [2 * x for x in rows[0][1]]), (100, [0.0, 0.0, 0.0]), (150, [1e-160, 0.0, 1e-160])]
    rows += [(200 + 50 * i, v) for i, v in enumerate(ODD)]
    assert found(neighbours.nearest(frame(spark, rows))) == brute(rows)
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert found(neighbours.nearest(frame(spark, rows[:3]))) == brute(rows[:3])
    assert neighbours.nearest(frame(spark, [(0, [1.0, 2.0, 3.0])])).count() == 0


def test_equal_vectors_do_not_share_one_leaf(spark):
    """A third of the rows are one vector: the smallest ids among them are found, ids of others too."""
    rng = np.random.default_rng(9)
    same = [1.0, 2.0, 2.0]
    rows = [(i, same if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    got = found(neighbours.nearest(frame(spark, rows), leaf=16))
    want = brute(rows)
    assert [r for r in got if r[0] % 150 == 0] == [r for r in want if r[0] % 150 == 0]
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    scaled = np.array([same] * 500) * np.arange(1, 501)[:, None]
    parts = forest.tree(neighbours.unit(scaled), 16, 1)
    f = forest.joined([parts])
    assert np.bincount(forest.places(f, neighbours.unit(scaled), np.arange(500))[:, 0]).max() < 60


def test_recall_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = t.toPandas()
    x = np.array(pdf.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = neighbours.nearest(t).toPandas()
    by = got.groupby("query_id").vec_id.apply(set)
    hits = total = 0
    for i in np.flatnonzero(pdf.vec_id % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(set(pdf.vec_id.to_numpy()[np.argsort(-s)[:5]]) & by[pdf.vec_id[i]])
        total += 5
    assert hits >= 0.93 * total and len(got) == total
    score = {(a, b): s for a, b, s in zip(got.query_id, got.vec_id, got.score, strict=True)}
    row = dict(zip(pdf.vec_id, x, strict=True))
    assert all(abs(row[a] @ row[b] - s) < 1e-9 for (a, b), s in score.items())
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id").score.diff().dropna() <= 0).all()


def test_fewer_visits_on_clustered_vectors(spark, monkeypatch):
    """Vectors in tight clusters need a small part of the leaves for the same recall."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.05 * rng.normal(size=16)).tolist()) for i in range(6000)]
    seen = []
    needed = neighbours.visits_needed
    monkeypatch.setattr(neighbours, "visits_needed", lambda index, q, sent, *a: seen.append((needed(index, q, sent, *a), sent.value.leaves)) or seen[-1][0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, every=100).count() == 300
    assert seen[0][0] < 0.12 * seen[0][1]
