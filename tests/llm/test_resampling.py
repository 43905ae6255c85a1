import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from helpers import EDGE, edge_docs, fold, no_docs, random_texts

from postlytics.llm import resampling as op


def features(text, orders, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                        for n in orders for i in range(len(words) - n + 1)]


def brute(rows, target, percent, orders, buckets, seed, least):
    made = [features(t, orders, buckets) for _, t in rows]
    s = Counter(b for _, f in made for b in f)
    t = Counter(b for x in target for b in features(x, orders, buckets)[1])
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b))) for k in range(buckets)]
    out = []
    for (d, _), (n, f) in zip(rows, made):
        w = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= least)
    return out, able[:percent * len(able) // 100]


@pytest.mark.parametrize("orders,buckets", [((1,), 10_000), ((1, 2, 3), 50)])
def test_against_brute_force(spark, orders, buckets):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(random_texts(3, 150))]
    docs = edge_docs(spark).select("doc_id", "text", "h", "n").unionByName(
        spark.createDataFrame([(d, t, "h", "n") for d, t in rows[len(EDGE):]],
                              "doc_id long, text string, h string, n string"))
    target = ["alpha beta the", "The quick brown fox", None, ""]
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, h int")
    how = dict(percent=30, orders=orders, buckets=buckets, seed=7, min_words=12)
    want, drawn = brute(rows, target, 30, orders, buckets, 7, 12)
    got = op.importance_scores(docs, aims, **how).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == sorted(
        (str(d), f, w, s) for d, _, f, w, s in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and drawn
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn
    kept = op.resample(docs, aims, **how)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in ranked)


def test_spans_are_overlapped_runs_of_words():
    words = op.collapsed("The  CAT,sat--on é1\x7f9")
    assert words == "the cat sat on é1 9".encode()
    assert [m[0].decode() for m in op.spans(words, 2)] == [
        "the cat", "cat sat", "sat on", "on é1", "é1 9"]
    assert [m.span() for m in op.spans(b"ab c", 1)] == [(0, 2), (3, 4)]
    assert not list(op.spans(b"ab c", 3)) and not list(op.spans(b"", 1))


def test_no_rows(spark):
    docs = edge_docs(spark)
    assert op.importance_scores(no_docs(spark), docs).count() == 0
    got = op.importance_scores(docs, no_docs(spark)).collect()
    assert len(got) == len(EDGE) and all(r.weight == 0 for r in got if r.n_features == 0)


def test_copies_of_one_row(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(5, text)] * 10 + [(None, text)] * 10, "doc_id long, text string")
    got = op.importance_scores(docs, docs, percent=50, min_words=10).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 11))
    assert op.resample(docs, docs, percent=50, min_words=10).count() == 10
