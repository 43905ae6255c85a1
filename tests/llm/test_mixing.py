import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from helpers import EDGE, edge_docs, no_docs

from postlytics.llm import mixing as op
from postlytics.llm.common import table


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """The contract step by step: share by weight, cut at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got = {s: 0.0 for s in names}
    excess = share * sum(sizes.values())
    while excess > 1e-9:
        free = [s for s in names if got[s] < cap * sizes[s]]
        if not free:
            break
        total = sum(w[s] for s in free)
        for s in free:
            got[s] += excess * w[s] / total
        excess = 0.0
        for s in free:
            if got[s] > cap * sizes[s]:
                excess += got[s] - cap * sizes[s]
                got[s] = float(cap * sizes[s])
    return got


def check(rows, got, near=1):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), n) for (d, _, _), n in zip(rows, size))
    of = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        of[s] += n
    target, taken = slow_targets(of), Counter()
    for r in got:
        assert r.source_size == of[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.times <= 2 and (r.size or not r.times)
        taken[r.source] += r.size * r.times
    for s, t in target.items():
        assert abs(taken[s] - t) < near, (s, taken[s], t)


def source_of(i):
    return [None, "web", "Ärzte", "books", "a"][min(i * i % 11 % 5, 4)]


def test_targets_and_sums(spark):
    for df in (table(spark, "/root/testdata/sf0.01", "documents"),):
        check([(r.doc_id, r.text, r.source) for r in df.collect()], op.mix(df).collect())


def test_edge_rows(spark):
    docs = edge_docs(spark)   # all of one source, null: taken once each, and half of the words again
    got = op.mix(docs).collect()
    whole = sum(r.size for r in got)
    assert {r.target for r in got} == {1.5 * whole}
    # half of the words: with the text of 30,000 words or all others, and those are nearer
    assert sum(r.size * r.times for r in got) == 2 * whole - 30_000
    assert op.mix(no_docs(spark)).count() == 0
    assert op.mixed(docs).columns == docs.columns
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.times) for r in op.mix(none).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("bucket,plan_rows", [(op.BUCKET, op.PLAN_ROWS), (3, 0)])
def test_hot_lengths_and_reruns(spark, monkeypatch, bucket, plan_rows):
    monkeypatch.setattr(op, "BUCKET", bucket)
    monkeypatch.setattr(op, "PLAN_ROWS", plan_rows)
    rnd = random.Random(3)
    # a source with one length only, one of many copies, small ones; ids and rows that repeat
    rows = [(i, " ".join(["w"] * 7) + f" {i}", "one") for i in range(400)]
    rows += [(i % 50, "same text", "copies") for i in range(200)]
    rows += [(1000 + i, " ".join(["x"] * rnd.randint(0, 90)), source_of(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op.mix(docs)
    first = got.collect()
    check(rows, first, near=9)   # "one" has words by eights only
    again = op.mix(docs.repartition(5, "text")).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    taken = Counter()
    for r in op.mixed(docs).collect():
        taken[r.doc_id, r.text, r.source] += 1
    want = Counter()
    hashes = {(r.doc_id, r.h): None for r in first}
    assert hashes
    for r in first:
        want[r.source] += r.times
    assert Counter({s: n for s, n in want.items() if n}) == Counter(
        s for (_, _, s), n in taken.items() for _ in range(n))
    # the draw is seeded: another seed, another mix of equal sums
    other = op.mix(docs, seed=1).collect()
    assert sorted(map(str, first)) != sorted(map(str, other))


def test_nearest_sum_is_the_best():
    rnd = random.Random(5)
    for _ in range(200):
        items = [(s, rnd.randint(1, 4)) for s in rnd.sample(range(1, 30), rnd.randint(1, 4))]
        want = rnd.randint(0, 60)
        sums = {sum(s * k for (s, _), k in zip(items, ks))
                for ks in product(*[range(c + 1) for _, c in items])}
        taken = op.nearest_sum(items, want)
        assert all(taken.get(s, 0) <= c for s, c in items)
        got = sum(s * k for s, k in taken.items())
        assert abs(got - want) == min(abs(x - want) for x in sums)


def test_fit_lengths():
    rnd = random.Random(6)
    for _ in range(50):
        sizes = sorted(rnd.sample(range(1, 3000), 40))
        counts = [rnd.randint(1, 300) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        want = rnd.randint(0, total)
        order = rnd.sample(range(40), 40)
        picks = op.fit_lengths(sizes, counts, want, order)
        assert all(0 <= p <= c for p, c in zip(picks, counts))
        assert abs(sum(s * p for s, p in zip(sizes, picks)) - want) <= 5
        # like the source: every length close to its share
        assert sum(abs(p - c * want / total) for p, c in zip(picks, counts)) < 120
    # a remainder of billions of copies stays small
    assert op.nearest_sum([(3, 10 ** 12)], 10) == {3: 3}
