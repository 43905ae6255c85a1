"""Stages against plain versions, the registry, and the guard of the entry file."""
import os

import duckdb
import pytest
from helpers import edge_docs, fold, no_docs

import __spark_entry__
import corpus_pipeline
from postlytics.llm.common import stored, table
from postlytics.llm.queries import load_llm
from test_simhash import groups, slow_fingerprint

SF = "/root/testdata/sf0.001"
OPS = ["op1_pivot_top_k", "op2_token_output", "op3_simhash_near_dedup", "op4_line_dedup",
       "op5_quality_ranking", "op6_bpe_transducer", "op7_exact_dedup", "op8_pii_surrogates",
       "op9_suffix_dedup", "op10_best_fit_packing"]


def test_stages_against_plain_versions(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    kept = stored(stage["quality"](spark, docs, SF))
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < docs.count()
    exact = stored(stage["exact_dedup"](spark, kept, SF))
    best = {}
    for r in kept.collect():
        best[fold(r.text)] = max(best.get(fold(r.text), -1), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(best.values())
    near = stored(stage["near_dedup"](spark, exact, SF))
    rows = sorted((r.doc_id, slow_fingerprint(r.text)) for r in exact.collect())
    root = groups(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 4)
    assert {r.doc_id for r in near.collect()} == {rows[i][0] for i in set(root)}
    clean = stored(stage["pii"](spark, near, SF))
    assert clean.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    packed = stage["packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed.collect()))


def test_stages_stand_awkward_rows(spark):
    for docs in (edge_docs(spark), no_docs(spark)):
        now = docs.select(*corpus_pipeline.COLUMNS)
        for _, f in corpus_pipeline.STAGES[1:]:
            now = stored(f(spark, now, SF))
        scored = corpus_pipeline.quality(spark, docs, SF)
        assert scored.columns == corpus_pipeline.COLUMNS and scored.count() <= docs.count()
    assert now.count() == 0


def test_registered():
    qs = __spark_entry__.queries()
    assert [n for n in qs if n.startswith("op")] and set(OPS) | {"pipeline"} <= set(qs)
    assert set(load_llm()) == set(OPS)
    assert set(__spark_entry__.oracle_sql()) >= {"op1_pivot_top_k", "op4_line_dedup", "op7_exact_dedup"}


@pytest.mark.parametrize("name", [n for n, q in load_llm().items() if q.sql])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = load_llm()[name]
    got = q.build(spark, SF)
    res = con.execute(q.sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(res.fetchall())


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, names in os.walk(os.path.join(root, "postlytics")):
        if folder.endswith("llm"):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "postlytics.llm" not in open(os.path.join(folder, n)).read(), n
