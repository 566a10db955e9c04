"""Top-k search by inner product against brute force, with odd rows and bounds that exclude annuli."""

from math import floor, inf, isfinite, nan

import numpy as np

from stackloom.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, rank string, pivot string"


def brute(rows, k, query=lambda i: i % 20 == 0):
    """Of rows of one length: (query_id, rank, vec_id, score)."""
    good = [(i, [floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and isfinite(x) for x in v)]
    best = {}
    for q, a in good:
        for c, b in good:
            if query(q) and q != c:
                score = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
                best[q, c] = max(score, best.get((q, c), score))
    out = []
    for q in {q for q, _ in best}:
        ranked = sorted(((-s, c) for (p, c), s in best.items() if p == q))[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, k):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    out = pivots.top_k(df, df.filter("vec_id % 20 = 0"), k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()))


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).round(1).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200, 260)]  # ties
    rows += rows[:30]  # repeated rows
    rows += [(40, [2.0, 2.0, -2.0, 1.0]), (41, [3.0, 1.0, 0.0, 0.0])]  # other vectors of an id
    odd = [(300, None), (320, [None, 1.0, 1.0, 1.0]), (340, [nan, 1.0, 1.0, 1.0]), (360, [inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (380, []), (400, [1e307] * 4), (420, [1.0, 1.0])]
    want = brute(rows + [(500, [0.0] * 4)], 7)
    assert found(spark, rows + [(500, [0.0] * 4)] + odd, 7) == want


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(i, [float(2**40 + i), 1.0 + i, 0.5]) for i in range(0, 60)] + [(100, [1e200, 1.0, 1.0]), (101, [-1e200, 0.0, 0.0])]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_few_or_no_rows(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [(0, [1.0, 2.0])], 5) == []
    assert found(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])], 5) == [(0, 1, 1, 64 * 64 * 3)]
    assert found(spark, [(1, [1.0, 2.0]), (2, [1.0, 1.0])], 5) == []


def test_many_small_annuli(spark, monkeypatch):
    """Clusters far apart, several rounds; rings are joined and split."""
    monkeypatch.setattr(pivots, "pivots_of", lambda n: 16)
    monkeypatch.setattr(pivots, "rows_of", lambda n: 40)
    rng = np.random.default_rng(2)
    middle = np.eye(16) * 30
    rows = [(i, (middle[i % 16] + rng.standard_normal(16) * 0.3).tolist()) for i in range(2000)]
    assert found(spark, rows, 20) == brute(rows, 20)
    x = np.floor(64 * np.array([v for _, v in rows]))
    cells = [type("Cell", (), {"pivot": 0, "ring": r, "n": 50, "low": 10.0 * r, "high": 10.0 * r + 9, "length": 100.0})() for r in range(10)]
    annuli, places = pivots.annuli_of(cells, x[:1], 120)
    assert [a for *_, a, _ in places] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4] and annuli.high[0] == 19
    assert pivots.annuli_of(cells, x[:1], 20)[1][1] == (0, 1, 3, 3)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((400, 8)) * 50)
    p = x[:5]
    d = pivots.distances(x, p)
    near = d.argmin(axis=1)
    cells = []
    for k in range(5):
        own = near == k
        cells.append(type("Cell", (), {"pivot": k, "ring": 0, "n": int(own.sum()), "low": d[own, k].min(), "high": d[own, k].max(), "length": np.square(x[own]).sum(axis=1).max()})())
    annuli, _ = pivots.annuli_of(cells, p, 10_000)
    assert (annuli.bounds(x)[:, near] >= x @ x.T).all()
