"""Sampling (E1, E2): exact quotas, no duplicates, partition independence."""
from pyspark.sql import functions as F

from postlytics.operators import sampling as sp


def frame(spark, n=300):
    rows = [(i, 0 if i % 10 < 6 else (1 if i % 10 < 9 else 2)) for i in range(n)]
    return spark.createDataFrame(rows, "post_id long, label int")


def test_stratified_quotas_exact(spark):
    df = frame(spark)
    s = sp.stratified_sample(df, "label", 50)
    got = {r.label: r["count"] for r in s.groupBy("label").count().collect()}
    assert sum(got.values()) == 50
    assert got == sp.stratified_quotas({0: 180, 1: 90, 2: 30}, 50)
    assert s.select("post_id").distinct().count() == 50


def test_stratified_independent_of_partitioning(spark):
    df = frame(spark)
    a = {r.post_id for r in sp.stratified_sample(df.repartition(1), "label", 40).collect()}
    b = {r.post_id for r in sp.stratified_sample(df.repartition(7), "label", 40).collect()}
    assert a == b


def test_histogram_refinement_matches_window(spark, monkeypatch):
    df = frame(spark, 2000)
    monkeypatch.setattr(sp, "MAX_BOUNDARY_ROWS", 10)
    a = {r.post_id for r in sp.smallest_per_group(df, "label", {0: 37, 1: 5, 2: 80}, "post_id").collect()}
    monkeypatch.setattr(sp, "MAX_BOUNDARY_ROWS", 10**9)
    b = {r.post_id for r in sp.smallest_per_group(df, "label", {0: 37, 1: 5, 2: 80}, "post_id").collect()}
    assert a == b and len(a) == 122


def test_few_shot_k7(spark):
    s = sp.few_shot_sample(frame(spark), 7).collect()
    assert len(s) == 7 and len({r.post_id for r in s}) == 7
    per = {}
    for r in s:
        per[r.label] = per.get(r.label, 0) + 1
    assert all(v >= 2 for v in per.values())
    assert sorted(r.shot for r in s) == list(range(1, 8))


def test_few_shot_draw_leaves_texts_where_they_are(spark, monkeypatch):
    """the rows that one task ranks have no texts; those of the candidates come afterwards."""
    from postlytics.operators import sampling as sp
    seen = []
    ranked = sp.smallest_per_group

    def watched(df, *args, **kwargs):
        seen.append(df.columns)
        return ranked(df, *args, **kwargs)
    monkeypatch.setattr(sp, "smallest_per_group", watched)
    rows = [(i, f"text {i}", i % 3) for i in range(60)] + [(1, "text 1", 1)]
    df = spark.createDataFrame(rows, "post_id long, text string, label int")
    got = sp.few_shot_samples(df, [3, 7], keep=["text"])
    assert seen and all("text" not in c for c in seen)
    for k in (3, 7):
        one = sp.few_shot_sample(df.distinct(), k).orderBy("shot").collect()
        assert [(r["post_id"], r["label"], r["text"]) for r in got[k]] == [
            (r["post_id"], r["label"], r["text"]) for r in one]
