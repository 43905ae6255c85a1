import random
import re

import numpy as np
import pytest
import xxhash
from helpers import EDGE, docs_of, edge_docs, fold, no_docs, random_texts

from postlytics.llm import simhash
from postlytics.llm.components import components


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    if not w:
        return 0
    g = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def check(rows, got):
    fps = {t: slow_fingerprint(t) for _, t in rows}
    distinct = sorted(set(fps.values()))
    root = dict(zip(distinct, groups(len(distinct), lambda i, j: (distinct[i] ^ distinct[j]).bit_count() <= 4)))
    least = {}
    for d, t in rows:
        if d is not None:
            r = root[fps[t]]
            least[r] = min(least.get(r, d), d)
    want = sorted((str(d), f"{fps[t]:016x}", str(least.get(root[fps[t]]))) for d, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert {r.component_id for r in got if r.kept and r.component_id is not None} == set(least.values())


def test_near_groups(spark):
    check(EDGE, simhash.near_groups(edge_docs(spark)).collect())
    texts = random_texts(8, 150)
    check(list(enumerate(texts)), simhash.near_groups(docs_of(spark, texts)).collect())
    assert simhash.near_groups(no_docs(spark)).count() == 0


def test_keep_near(spark):
    docs = edge_docs(spark)
    got = simhash.keep_near(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids
    assert simhash.keep_near(no_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_links_find_all_pairs(seed):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    v = list(map(int, base))
    for _ in range(500):   # chains and dense groups
        x = rnd.choice(v)
        for _ in range(rnd.randint(1, 5)):
            x ^= 1 << rnd.randrange(64)
        v.append(x)
    v = np.unique(np.array(v, np.uint64))
    want = groups(len(v), lambda i, j: int(v[i] ^ v[j]).bit_count() <= 4)
    for leaf in (4, 64):
        up = list(range(len(v)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i
        for i, j in simhash.links(v, 4, 4, (), leaf):
            for a, b in zip(i.tolist(), j.tolist()):
                assert want[a] == want[b]
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(v))] == want
    assert simhash._flood(v, 4).tolist() == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    near = set(edges) | {(b, a) for a, b in edges}
    want = groups(len(nodes), lambda i, j: (nodes[i], nodes[j]) in near)
    assert got == {n: nodes[want[i]] for i, n in enumerate(nodes)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
