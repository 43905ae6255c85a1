"""Models (J), clustering (G) and segmentation (D9) on small fixtures."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlytics.operators import cluster as cl
from postlytics.operators import modeling as md
from postlytics.operators import segment as sg


def test_draw_trials_ranges():
    ts = md.draw_trials(md.FOREST_SPACE, 20, seed=1)
    assert all(50 <= t["n_estimators"] <= 500 and 0.1 <= t["max_features"] <= 1.0 for t in ts)
    assert md.draw_trials(md.LOGREG_SPACE, 3, 7) == md.draw_trials(md.LOGREG_SPACE, 3, 7)
    with pytest.raises(ValueError):
        md.draw_trials({"x": {"type": "bogus", "values": []}}, 1)


def _posts(spark, n=90):
    words = {0: "awful bad sad", 1: "plain table chair", 2: "great happy good"}
    rows = [(i, f"{words[i % 3]} item{i}", i % 3, "test" if i % 5 == 0 else "train") for i in range(n)]
    return spark.createDataFrame(rows, "post_id long, text string, label int, split string")


def test_experiment_grid_logreg(spark, tmp_path):
    mets = md.experiment_grid(_posts(spark), str(tmp_path / "grid"), methods=("tfidf",), models=("logreg",),
                              n_trials={"tfidf": 1})
    r = mets.first()
    assert r.model == "logreg" and r.accuracy > 0.9 and r.seconds > 0
    assert spark.read.parquet(str(tmp_path / "grid" / "predictions")).count() == 18


def test_kmeans_labels_are_nearest_centres(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    out, model = cl.kmeans(df, "v", 2)
    centres = np.asarray(model.clusterCenters())
    for r in out.collect():
        assert r.cluster == int(((centres - np.asarray(r.v)) ** 2).sum(axis=1).argmin())
    again = {r.id: r.cluster for r in cl.assign(df, "v", centres.tolist()).collect()}
    assert again == {r.id: r.cluster for r in out.collect()}


def test_meanshift_two_blobs(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.2, (40, 3)), rng.normal(6, 0.2, (40, 3))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    out, centres = cl.meanshift(df, "v", bandwidth=2.0)
    labels = {r.id: r.cluster for r in out.collect()}
    assert len(centres) == 2
    assert len({labels[i] for i in range(40)}) == 1 and len({labels[i] for i in range(40, 80)}) == 1
    assert labels[0] != labels[40]


def test_meanshift_keeps_a_seed_per_cell(spark, monkeypatch):
    # 2,500 places 3 bandwidths apart: more than one block of seeds, each place its own cluster
    df = spark.createDataFrame([(i, [3.0 * (i % 50), 3.0 * (i // 50)]) for i in range(2500)],
                               "id long, v array<double>")
    out, centres = cl.meanshift(df, "v", bandwidth=1.0)
    assert len(centres) == 2500 and out.select("cluster").distinct().count() == 2500
    rng = np.random.default_rng(2)
    some = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(0, 2, (80, 2)))],
                                 "id long, v array<double>")
    one = cl.meanshift(some, "v", bandwidth=1.5)[1]
    monkeypatch.setattr(cl, "SEED_BLOCK", 4)
    assert np.allclose(one, cl.meanshift(some, "v", bandwidth=1.5)[1])
    with pytest.raises(ValueError):
        cl.cluster_elements(df, "id", None)


def test_segment(spark):
    texts = spark.createDataFrame([("machine learning is fun",), ("learning machines",)], "text string")
    counts = sg.unigram_counts(texts)
    tags = spark.createDataFrame([("#MachineLearning",), ("#fun_learning",)], "tag string")
    got = {r.tag: r.segmented for r in sg.segment(tags, "tag", counts).collect()}
    assert got == {"#MachineLearning": "machine learning", "#fun_learning": "fun learning"}


def test_segment_equals_a_plain_dynamic_program(spark):
    import math
    import random
    rnd = random.Random(4)
    words = ["a", "ab", "abc", "bca", "cab", "ba", "c"]
    texts = spark.createDataFrame([(" ".join(rnd.choice(words) for _ in range(30)),) for _ in range(20)], "text string")
    counts = sg.unigram_counts(texts)
    known, total = {r.word: r.n for r in counts.collect()}, sum(r.n for r in counts.collect())
    tags = ["#" + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(60)] + [None, "#É_x"]

    def best(text, longest):
        ways = [(0.0, [])]
        for j in range(1, len(text) + 1):
            options = []
            for i in range(max(0, j - longest), j):
                w = text[i:j]
                p = known[w] / total if w in known else 10.0 / (total * 10.0 ** len(w))
                options.append((ways[i][0] + math.log(p), -i, ways[i][1] + [w]))
            top = max(options, key=lambda o: (o[0], o[1]))
            ways.append((top[0], top[2]))
        return " ".join(ways[-1][1])
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    for longest in (24, 2):
        got = {r.tag: r.segmented for r in sg.segment(df, "tag", counts, max_word=longest).collect()}
        for t in tags[:-2] + ["#É_x"]:
            assert got[t] == best(t.lower().replace("#", "").replace("_", ""), longest)


def test_embedding_features_of_long_texts(spark):
    """Embedding features are made by the form for long texts (no hash per occurrence in the JVM), equal to the
    staged expression; forests keep the nodes of rows instead of walking all rows down all trees per level."""
    from postlytics.operators import embed as em
    rows = [(i, t, i % 2, "x") for i, t in enumerate(["#Good day", "", None, "a", "Grüße ß", "long " * 500, "日本語のテキスト"])]
    df = spark.createDataFrame(rows, "post_id long, text string, label int, split string")
    emb = em.HashedNgramEmbedder()
    new = emb.add_long(df, "text", "e")
    assert new.columns == df.columns + ["e"]
    assert "md5" not in new._jdf.queryExecution().optimizedPlan().toString()
    want = {r.post_id: r.e for r in emb.add_column(df, "text", "e").collect()}
    assert {r.post_id: r.e for r in new.collect()} == want
    (got,), _ = md.featurize(df.where("text IS NOT NULL"), [], "embedding")
    assert {r.post_id: list(r.features) for r in got.collect()} == {i: e for i, e in want.items() if e is not None}
    forest = {"n_estimators": 3, "max_depth": 3, "min_samples_split": 0.1, "max_features": 0.5}
    assert md.make_estimator("forest", forest, 10).getCacheNodeIds()


def test_forest_takes_terms_that_can_split(spark):
    """Terms too rare to split a node are left out of a forest's rows, and the trees stay the same."""
    from pyspark.ml.linalg import SparseVector
    wide = 200_000
    rows = []
    for i in range(400):
        own = 1000 + i * 400   # terms of this row alone
        at = {i % 7: 1.0 + i % 3, 10 + i % 2: 1.0, own: 2.0, own + 5: 1.0} | ({50: 0.5} if i % 5 == 0 else {})
        rows.append((i, (i % 7 + i % 2) % 3, SparseVector(wide, dict(sorted(at.items())))))
    df = spark.createDataFrame(rows, ["post_id", "label", "features"]).coalesce(2)
    assert md.splitting_terms(df, 41) is None
    assert md.splitting_terms(df, 370) == [10, 11]
    params = {"n_estimators": 4, "max_depth": 4, "min_samples_split": 0.21, "max_features": 1.0}   # 42 rows a node
    model = md.fit_model(df, "forest", params, 400)
    assert model.stages[-1].numFeatures == len(md.splitting_terms(df, 42)) < 20
    narrow = spark.createDataFrame([(i, y, SparseVector(60, {k: x for k, x in zip(v.indices, v.values) if k < 60}))
                                    for i, y, v in rows], ["post_id", "label", "features"]).coalesce(2)
    plain = md.make_estimator("forest", params, 400).fit(narrow)   # the terms left out change nothing
    got = {r.post_id: list(r.probability) for r in model.transform(df).collect()}
    assert got == {r.post_id: list(r.probability) for r in plain.transform(narrow).collect()}
    assert len({tuple(p) for p in got.values()}) > 1
