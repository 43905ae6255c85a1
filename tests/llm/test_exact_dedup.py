import hashlib
from collections import defaultdict

import pytest
from helpers import EDGE, docs_of, edge_docs, fold, no_docs, random_texts

from postlytics.llm import exact_dedup as op


def check(rows, got, pick):
    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t)].append(d)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(got) == len(rows)
    for norm, ids in groups.items():
        rs = by[hashlib.sha256(norm.encode()).hexdigest()]
        real = [i for i in ids if i is not None]
        keep = pick(real) if real else None
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rs)
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in rs)
        kept = [r.doc_id for r in rs if r.kept]
        assert kept == [keep]


@pytest.mark.parametrize("heavy", [False, True])
@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_groups(spark, monkeypatch, heavy, keep, pick):
    if heavy:  # every text that occurs twice is salted
        monkeypatch.setattr(op, "HEAVY_ROWS", 1)
    check(EDGE, op.exact_groups(edge_docs(spark), keep=keep).collect(), pick)
    texts = random_texts(3) + ["Hot Text"] * 200 + ["hot text"] * 100
    check(list(enumerate(texts)), op.exact_groups(docs_of(spark, texts), keep=keep).collect(), pick)


@pytest.mark.parametrize("heavy", [False, True])
def test_keep_rows(spark, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(op, "HEAVY_ROWS", 1)
    docs = edge_docs(spark)
    got = op.keep_exact(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({fold(t) for _, t in EDGE})
    assert {r.doc_id for r in rows if fold(r.text) == fold(EDGE[0][1])} == {2}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_empty_and_arguments(spark):
    assert op.exact_groups(no_docs(spark)).count() == 0
    assert op.keep_exact(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        op.exact_groups(no_docs(spark), keep="any")
