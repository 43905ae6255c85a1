import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, docs_of, edge_docs, no_docs

from postlytics.llm import suffix_dedup as op


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        spans = op.merged_spans((i, i + length) for i in range(len(t) - length + 1)
                                if seen[t[i:i + length]] > 1)
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + t[at:s], e
        out.append((len(t), sum(e - s for s, e in spans), len(spans),
                    hashlib.sha256(kept + t[at:]).hexdigest()))
    return out


def made_of(docs, **kw):
    return [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
            for r in op.remove_repeats(docs, **kw).collect()]


def passages(seed, n=60):
    rnd = random.Random(seed)
    abc = rnd.choice(["ab", "abcé", "abcdefghijklmnop "])
    word = lambda a, b: "".join(rnd.choice(abc) for _ in range(rnd.randint(a, b)))
    base, shared = [word(0, 150) for _ in range(12)], [word(17, 60) for _ in range(4)]
    out = []
    for _ in range(n):
        t = rnd.choice(base)
        for _ in range(rnd.randint(0, 3)):
            p, q = rnd.randint(0, len(t)), rnd.choice(shared)
            t = t[:p] + q[rnd.randint(0, 4):len(q) - rnd.randint(0, 4)] + t[p:]
        out.append("a" * rnd.randint(0, 90) if rnd.random() < 0.1 else t)
    return out


@pytest.mark.parametrize("seed,hot", [(1, op.HOT), (2, op.HOT), (3, 1), (4, 3)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(op, "GRAM", 6)
    texts = passages(seed)
    want = sorted((str(i), *w) for i, w in enumerate(brute(texts, 20)))
    assert sorted(made_of(docs_of(spark, texts), length=20, hot=hot)) == want


def test_default_length_and_edges(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdef ") for _ in range(900))
    rows = EDGE + [(20, long), (21, "x " + long[100:600] + " y"), (22, long[:399]), (23, long[500:899] + "!")]
    docs = edge_docs(spark).select("doc_id", "text", "id", "h", "m").unionByName(
        spark.createDataFrame([(d, t, None, "h", "m") for d, t in rows[len(EDGE):]],
                              "doc_id long, text string, id string, h string, m string"))
    want = sorted((str(d), *w) for (d, _), w in zip(rows, brute([t for _, t in rows], 400)))
    assert sorted(made_of(docs)) == want
    assert op.remove_repeats(no_docs(spark)).count() == 0


def test_suffix_order_is_lexicographic():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))).encode() for _ in range(300)]
    offsets = [rnd.randint(0, len(t) - 1) for t in texts]
    group = [rnd.randint(0, 5) for _ in texts]
    e = op.Extents(texts, offsets, group)
    right = e.sort(1).tolist()
    assert [(group[i], texts[i][offsets[i]:]) for i in right] == sorted(
        (group[i], texts[i][offsets[i]:]) for i in range(300))
    left = e.sort(-1).tolist()
    assert [(group[i], texts[i][:offsets[i]][::-1]) for i in left] == sorted(
        (group[i], texts[i][:offsets[i]][::-1]) for i in range(300))


def test_collisions_are_found_out(monkeypatch):
    # hashes that say nothing: every claim must be settled on bytes
    monkeypatch.setattr(op.Hashes, "of", lambda self, s, e: np.zeros(len(self.prefix[s]), np.uint64))
    e = op.Extents([b"xxabcdyy", b"zzabcdww"], [2, 2], [0, 0])
    assert {(i, lo, hi) for i, lo, hi in e.matches(4, np.array([True, True]))} == {(0, 0, 0), (1, 0, 0)}


def test_runs_tile_all_windows():
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    s0, s1, a, m, _ = op.runs(data, 100, 10)
    assert s0[0] == 0 and s1[-1] == 4900 and (s0[1:] == s1[:-1] + 1).all()
    assert (a >= s1).all() and (a <= s0 + 90).all()
