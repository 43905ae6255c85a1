"""Folds, resumable trials, the experiment grid, term vectors, stored models."""
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from postlytics.operators import features as ft
from postlytics.operators import modeling as md
from postlytics.sources import io

SMALL_FOREST = {**md.FOREST_SPACE, "n_estimators": {"type": "int", "values": [3, 5]},
                "max_depth": {"type": "int", "values": [2, 4]}}


def posts(spark, n=90):
    words = {0: "awful bad sad", 1: "plain table chair", 2: "great happy good"}
    rows = [(i, f"{words[i % 3]} item{i}", i % 3, "test" if i % 5 == 0 else "train") for i in range(n)]
    return spark.createDataFrame(rows, "post_id long, text string, label int, split string")


def slow_folds(rows, k):
    """Rows (id, label) in order of id: the library rule, one row after the other."""
    rows = sorted(rows)
    names = []
    for _, y in rows:
        if y not in names:
            names.append(y)
    by_class = sorted(names.index(y) for _, y in rows)
    sizes = [[sum(c == j for c in by_class[i::k]) for j in range(len(names))] for i in range(k)]
    out = {}
    for j, y in enumerate(names):
        mine = [i for i, z in rows if z == y]
        folds = [f for f in range(k) for _ in range(sizes[f][j])]
        out |= dict(zip(mine, folds, strict=True))
    return out


@pytest.mark.parametrize("k", [2, 3, 5])
def test_stratified_folds(spark, k):
    rnd = random.Random(k)
    rows = [(i * 7 % 211, rnd.choice(["b", "a", "a", "c", None])) for i in range(211)]
    df = spark.createDataFrame(rows, "post_id long, label string").repartition(7)
    got = {r.post_id: r.fold for r in md.stratified_folds(df, k).collect()}
    assert got == slow_folds([(i, y) for i, y in rows], k)
    for y in {y for _, y in rows}:
        n = [sum(got[i] == f for i, z in rows if z == y) for f in range(k)]
        assert max(n) - min(n) <= 1
    with pytest.raises(ValueError):
        md.stratified_folds(df.limit(1), k)
    assert md.stratified_folds(df.limit(0), k).count() == 0


@pytest.fixture
def fits(monkeypatch):
    """Counts the models made; raises at the number in ``stop``."""
    made, lock, real = {"n": 0, "stop": None}, threading.Lock(), md.make_estimator

    def counted(*args, **kw):
        with lock:
            made["n"] += 1
            if made["n"] == made["stop"]:
                raise RuntimeError("stopped")
        return real(*args, **kw)
    monkeypatch.setattr(md, "make_estimator", counted)
    return made


def test_trials_go_on_where_they_stopped(spark, tmp_path, fits):
    (data,), _ = md.featurize(posts(spark), [])
    trials, store = md.draw_trials(md.LOGREG_SPACE, 4), str(tmp_path / "log")
    fits["stop"] = 5   # the second trial's second fold
    with pytest.raises(RuntimeError):
        md.optimize(data, "logreg", trials, store, "e", parallelism=1)
    assert [r.run_id for r in md.logged_trials(spark, store, "e").collect()] == [md.run_id("logreg", trials[0])]
    fits.update(n=0, stop=None)
    rows = md.optimize(data, "logreg", trials, store, "e", parallelism=3).orderBy("trial").collect()
    assert fits["n"] == 9   # three trials, three folds
    fits["n"] = 0
    again = md.optimize(data, "logreg", trials, store, "e").orderBy("trial").collect()
    assert again == rows and fits["n"] == 0
    more = md.optimize(data, "logreg", md.draw_trials(md.LOGREG_SPACE, 5), store, "e").orderBy("trial").collect()
    assert [r.score for r in more[:4]] == [r.score for r in rows] and fits["n"] == 3
    assert sum(r.best for r in rows) == 1 and max(r.score for r in rows) == next(r.score for r in rows if r.best)
    params = spark.read.parquet(store + "/params").where("run_id = %r" % rows[0].run_id).collect()
    assert {(p.param, p.value) for p in params} == {(k, str(v)) for k, v in trials[0].items()}
    # another experiment shares nothing
    assert md.logged_trials(spark, store, "f").count() == 0


def test_scores_equal_single_fits(spark, tmp_path):
    (data,), _ = md.featurize(posts(spark), [])
    trials = md.draw_trials(md.LOGREG_SPACE, 2)
    _, best, scores = md.cross_validate(data, "logreg", trials, store=str(tmp_path / "log"))
    folds = slow_folds([(r.post_id, r.label) for r in data.collect()], 3)
    ready = data.join(spark.createDataFrame(list(folds.items()), "post_id long, fold int"), "post_id")
    for t, s in zip(trials, scores):
        want = [md.fold_score(ready, "logreg", t, f, 90 - sum(x == f for x in folds.values())) for f in range(3)]
        assert s == pytest.approx(sum(want) / 3, abs=1e-6)
    assert best == max(scores)


def test_grid_is_restartable_and_its_metrics_follow_from_the_predictions(spark, tmp_path, fits):
    store, spaces = str(tmp_path / "grid"), {"logreg": md.LOGREG_SPACE, "forest": SMALL_FOREST}
    how = dict(n_trials={"tfidf": 1, "embedding": 2}, spaces=spaces)
    rows = md.experiment_grid(posts(spark), store, **how).collect()
    assert {(r.model, r.variant) for r in rows} == {(m, v) for m in ("logreg", "forest") for v in ("tfidf", "embedding")}
    assert fits["n"] == 2 * (3 + 1) + 2 * (6 + 1)
    fits["n"] = 0
    again = md.experiment_grid(posts(spark), store, **how).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows)) and fits["n"] == 0
    want = duckdb.sql(f"""
      WITH p AS (SELECT * FROM read_parquet('{store}/predictions/*/*/*.parquet', hive_partitioning = true)),
      c AS (SELECT model, variant, l, count(*) FILTER (y_true = l) AS t, count(*) FILTER (y_true = l AND y_pred = l) AS tp,
                   count(*) FILTER (y_pred = l) AS q
            FROM p, (SELECT DISTINCT y_true AS l FROM p) GROUP BY ALL)
      SELECT model, variant, sum(tp) / sum(t) AS accuracy, sum(t * 2 * tp / (t + q)) / sum(t) AS f1_weighted
      FROM c GROUP BY ALL""").fetchall()
    got = {(r.model, r.variant): r for r in rows}
    assert len(want) == 4
    for model, variant, accuracy, f1 in want:
        r = got[model, variant]
        assert r.accuracy == pytest.approx(accuracy) and r.f1_weighted == pytest.approx(f1) and r.seconds > 0
    # a pair whose result is missing is done again, with the trials that are logged
    assert io.exists(spark, store + "/results/experiment=logreg_tfidf")
    part = md.experiment_grid(posts(spark), store, methods=("tfidf", "count"), models=("logreg",),
                              n_trials={"tfidf": 1, "count": 1}).where("variant = 'count'")
    assert part.count() == 1 and fits["n"] == 4


def test_term_vectors_equal_the_long_form(spark, monkeypatch):
    monkeypatch.setattr(ft, "HOT_TERMS", 3)
    texts = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc éé aa"), (3, "!"), (4, None), (5, "zz bb")],
                                  "post_id long, text string")
    long, _ = ft.tfidf(texts)
    want = {(r.post_id, r.term): r.tfidf for r in long.collect()}
    model = ft.fit_term_vectors(texts)
    name = {r.idx: r.term for r in model.terms.collect()}
    assert [name[i] for i in range(model.size)] == ["aa", "bb", "cc", "zz", "éé"]
    got = {}
    for r in model.transform(texts).collect():
        assert r.features.size == 5
        got |= {(r.post_id, name[int(i)]): v for i, v in zip(r.features.indices, r.features.values)}
    assert got == pytest.approx(want)
    # a text of later terms and none
    other = model.transform(spark.createDataFrame([(9, "bb qq", 1), (8, "qq", 2)], "post_id long, text string, x int"))
    assert {r.post_id: (r.features.numNonzeros(), r.x) for r in other.collect()} == {9: (1, 1), 8: (0, 2)}


def test_stored_model(spark, tmp_path):
    p = posts(spark)
    (train, test), _ = md.featurize(p.where("split = 'train'"), [p.where("split = 'test'")])
    pred, _ = md.fit_predict(train, test, "logreg", {"C": 1.0, "penalty": "l2"})
    path = str(tmp_path / "model")
    md.save_model(md.make_estimator("logreg", {"C": 1.0, "penalty": "l2"}, train.count()).fit(train), path)
    assert sorted(md.score_with(test, path).collect()) == sorted(pred.collect())
    plan = md.score_with(test, path)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_terms_join(spark, monkeypatch):
    monkeypatch.setattr(ft, "HOT_TERMS", 2)
    rows = spark.createDataFrame([(i, t) for i in range(20) for t in "abc"[:1 + i % 3]] + [(99, "zz")], "id long, term string")
    terms = rows.where("term <> 'zz'").groupBy("term").agg(F.count("*").alias("df")).withColumn("v", F.upper("term"))
    got = sorted((r.id, r.term, r.v) for r in ft.join_terms(rows, terms).collect())
    assert got == sorted((i, t, t.upper()) for i in range(20) for t in "abc"[:1 + i % 3])
