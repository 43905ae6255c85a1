import math

import numpy as np
import pytest

from postlytics.llm import topk

SCHEMA = "vec_id long, embedding array<float>, v string, ring string, id string"


def brute(rows, queries, k):
    ok = {}
    for i, e in rows:
        if i is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        ok.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in e])
    out = []
    for q in queries:
        if q in ok:
            mine = min(ok[q])
            s = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, vs in ok.items()
                       if i != q for v in vs)
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, queries, k, **kw):
    df = spark.createDataFrame([(i, e, None, "r", "z") for i, e in rows], SCHEMA)
    ask = df.filter(df.vec_id.isin(queries) if queries else "false")
    return sorted(map(tuple, topk.top_k(df, ask, k, **kw).collect()))


@pytest.mark.parametrize("seed,dim", [(1, 2), (2, 8)])
def test_against_brute_force(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "CHUNK", 4)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=dim) * 0.2]) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(60)]           # many ties
    rows += [(300, None), (301, []), (302, [float("nan")] * dim), (303, [float("inf")] * dim),
             (304, [None] * dim), (None, rows[0][1]), (5, rows[9][1]), (400, [0.0] * dim)]
    queries = [0, 7, 50, 210, 302, 400]
    assert run(spark, rows, queries, 5, pivots=6, n_rings=3) == brute(rows, queries, 5)


def test_few_rows_and_empty(spark):
    assert run(spark, [(1, [0.5, 1.0]), (2, [-0.5, 0.25])], [1, 2], 5) == [
        (1, 1, 2, 128 * -128 + 256 * 64), (2, 1, 1, 128 * -128 + 256 * 64)]
    assert run(spark, [(1, [0.5])], [1], 5) == []
    assert run(spark, [(1, None)], [1], 5) == []
    assert run(spark, [(1, [0.5]), (2, [1.0])], [], 5) == []


def test_every_length_is_served(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [0.5]), (1, [0.25, 0.5])]                        # short ones with small ids
    rows += [(i, [float(x) for x in rng.normal(size=4)]) for i in range(2, 40)]
    rows += [(i, [float(x) for x in rng.normal(size=2)]) for i in range(40, 60)]
    rows += [(60, [1.0] * 7)]
    queries = [0, 1, 2, 39, 40, 60]
    got = run(spark, rows, queries, 3, pivots=3, n_rings=2)
    want = []
    for n in (1, 2, 4, 7):
        some = [(i, v) for i, v in rows if len(v) == n]
        want += brute(some, [q for q in queries if q in dict(some)], 3)
    assert got == sorted(want) and {r[0] for r in got} == {1, 2, 39, 40}
