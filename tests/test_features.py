"""Features (D3, D8, D10-D12), prompts (P) and embeddings (D5-D7, F)."""
import math

import pytest
from pyspark.sql import functions as F

from postlytics.functions import prompts as pr
from postlytics.operators import embed as em
from postlytics.operators import encode as en
from postlytics.operators import features as ft
from postlytics.operators import similarity as sm


def test_tfidf_golden(spark):
    df = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc")], "post_id long, text string")
    w, _ = ft.tfidf(df)
    got = {(r.post_id, r.term): round(r.tfidf, 6) for r in w.collect()}
    assert got == {(1, "aa"): 0.574962, (1, "bb"): 0.81818, (2, "bb"): 0.579739, (2, "cc"): 0.814802}


def test_weights_shuffle_texts_and_rare_terms_only(spark, monkeypatch):
    """rows of common terms stay with their id; ids may repeat or be null."""
    monkeypatch.setattr(ft, "HOT_TERMS", 2)
    monkeypatch.setattr(ft, "TEXT_BYTES", 16)
    rows = [(1, "aa bb bb"), (2, "bb cc"), (2, "bb dd"), (None, "aa cc"), (None, "ee"), (3, None), (4, "bb aa")]
    df = spark.createDataFrame(rows, "post_id long, text string")
    w, _ = ft.tfidf(df)
    vectors = ft.fit_term_vectors(df)
    for out in (w, vectors.weights(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(post_id" in plan
        assert not [x for x in plan.split("\n") if "hashpartitioning(post_id" in x and "ENSURE_REQUIREMENTS" in x]
    texts = {1: "aa bb bb", 2: "bb cc bb dd", None: "aa cc ee", 4: "bb aa"}
    n_docs, exp = {t: sum(t in x.split() for x in texts.values()) for t in ("aa", "bb", "cc", "dd", "ee")}, {}
    for i, x in texts.items():
        raw = {t: x.split().count(t) * (math.log((1 + len(rows)) / (1 + n_docs[t])) + 1) for t in set(x.split())}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        exp |= {(i, t): round(v / norm, 9) for t, v in raw.items()}
    got = [(r.post_id, r.term, round(r.tfidf, 9)) for r in w.collect()]
    assert len(got) == len(exp) and {(i, t): v for i, t, v in got} == exp
    term = {r.idx: r.term for r in vectors.terms.collect()}
    assert {(r.post_id, term[i]): round(v, 9) for r in vectors.weights(df).collect()
            for i, v in zip(r.indices, r["values"], strict=True)} == exp


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1, [1.0, 7.0]), (2, [3.0, 7.0]), (3, [5.0, 7.0])], "id long, v array<double>")
    got = [r.z for r in ft.standardize(df, "v", "z").orderBy("id").collect()]
    assert [round(x[0], 6) for x in got] == [-1.224745, 0.0, 1.224745]
    assert all(x[1] == 0.0 for x in got)


def test_encode_pad_truncate(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "id long, t array<string>")
    vocab = en.build_vocab(df, "t", 2)
    out = {r.id: (r.input_ids, r.attention_mask) for r in en.encode(df, "id", "t", vocab, 4).collect()}
    assert out[1] == ([2, 4, 5, 3], [1, 1, 1, 1])
    assert out[2] == ([2, 1, 3, 0], [1, 1, 1, 0])  # "c" is outside the 2-word vocabulary
    assert out[3] == ([2, 3, 0, 0], [1, 1, 0, 0])


def test_completion_mask_last_marker(spark):
    df = spark.createDataFrame([([5, 7, 8, 9, 7, 8, 1],), ([1, 2],)], "ids array<int>")
    got = [r[0] for r in df.select(en.completion_only_labels("ids", [7, 8])).collect()]
    assert got[0] == [-100] * 6 + [1]
    assert got[1] == [-100, -100]


def test_pack_blocks(spark):
    df = spark.createDataFrame([(i, 3) for i in range(5)], "id long, n int")
    rows = en.pack(df, "id", "n", block=6).orderBy("block_id", "id").collect()
    # 5 examples of 3+1 tokens = 20 tokens -> 3 full blocks of 6
    assert {r.block_id for r in rows} == {0, 1, 2}
    per_block = {}
    for r in rows:
        per_block[r.block_id] = per_block.get(r.block_id, 0) + r.n_tokens
    assert per_block == {0: 6, 1: 6, 2: 6}


def test_prompts_literal_braces(spark):
    df = spark.createDataFrame([("x {output} y", 2)], "text string, label int")
    got = df.select(pr.training_example(pr.MODELS[1], "text", "label")).first()[0]
    assert got.startswith("<s>[INST] \nClassify") and "x {output} y" in got
    assert got.endswith("### Sentiment:  [/INST]\n Positive </s>")
    with pytest.raises(KeyError):
        pr.finetuning_prompt("unknown", "text", "text")


def test_embedder_paths_agree(spark):
    df = spark.createDataFrame([(1, "#Hello"), (2, "world")], "id long, e string")
    emb = em.HashedNgramEmbedder()
    a = {r.id: r.embedding for r in emb.add_column(df, "e").collect()}
    b = {r.id: r.embedding for r in emb.embed_long(df, "id", "e").collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k])
        assert sum(x * x for x in a[k]) == pytest.approx(1.0)


def test_mean_similarity_empty_is_null(spark):
    df = spark.createDataFrame([(1, ["#cat", "#dog"]), (2, [])], "id long, tags array<string>")
    out = {r.id: r.s for r in sm.mean_similarity(df, "id", "cat", "tags", "s").collect()}
    assert out[2] is None and 0 < out[1] <= 1
