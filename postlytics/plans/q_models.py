"""Registered queries: segmentation (D9), clustering (G1-G5), models (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlytics.functions import text as tx
from postlytics.operators import cluster as cl
from postlytics.operators import embed as em
from postlytics.operators import features as ft
from postlytics.operators import modeling as md
from postlytics.operators import segment as sg
from postlytics.plans import derived as dv
from postlytics.plans.derived import with_ctes
from postlytics.plans.q_core import SQL_CLEAN, _r, sql_tokenize
from postlytics.plans.q_similarity import _long
from postlytics.plans.registry import register
from postlytics.sources import io

EMB = em.HashedNgramEmbedder()


def _distinct_tags(spark, sf):
    t = dv.tags(spark, sf)
    return (t.select(F.explode_outer("tags").alias("tag")).where(F.col("tag").isNotNull()).distinct())


def _counts(spark, sf):
    return sg.unigram_counts(io.read_table(spark, sf, "documents"))


SEGMENTED_SQL = [
    "dt AS (SELECT DISTINCT unnest(tags) AS tag FROM tags)",
    f"""uni AS (SELECT word, count(*) AS n FROM (SELECT unnest({sql_tokenize(SQL_CLEAN.format(x='text'))}) AS word
              FROM documents) GROUP BY word)""", *sg.sql_segmented()]


@register("d9_segment_tags", sql=with_ctes(["tags"], "SELECT tag, segmented FROM seg", extra=SEGMENTED_SQL,
                                           recursive=True))
def d9_segment_tags(spark, sf):
    """Every distinct hashtag split into words (corpus unigram model)."""
    return sg.segment(_distinct_tags(spark, sf), "tag", _counts(spark, sf))


@register("d7_mean_segmented_tag_embedding", sql=with_ctes(
    ["tags"], """SELECT post_id, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS value FROM (
                   SELECT post_id, unnest(e) AS v, unnest(range(len(e))) AS dim
                   FROM (SELECT post_id, unnest(tags) AS tag FROM tags) JOIN seg USING (tag) JOIN ee USING (segmented))
                 GROUP BY post_id, dim""",
    extra=SEGMENTED_SQL + ["ds AS (SELECT DISTINCT segmented FROM seg)"] + EMB.sql_ctes("ee", "ds", "segmented", "segmented"),
    recursive=True))
def d7_mean_segmented_tag_embedding(spark, sf):
    """Mean embedding of each post's hashtags, every tag segmented into words first."""
    words = sg.segmenter(sg.unigram_counts(dv.texts(spark, sf)))
    return _long(em.mean_embedding(dv.tags(spark, sf), "post_id", "tags", EMB, segmenter=words),
                 ["post_id"], "embedding")


@register("g1_cluster_hashtags")
def g1_cluster_hashtags(spark, sf):
    """G1: segment -> embed -> standardise -> KMeans(8) over all distinct hashtags."""
    out, _ = cl.cluster_elements(_distinct_tags(spark, sf), "tag", EMB, n_clusters=8,
                                 segmenter=sg.segmenter(_counts(spark, sf)))
    return out.select(F.col("element").alias("tag"), "cluster")


def _scaled_embeddings(spark, sf):
    e = io.read_table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return ft.standardize(e, "embedding", "scaled")


@register("g2_kmeans")
def g2_kmeans(spark, sf):
    """KMeans (k = 10) of the standardised embeddings."""
    out, _ = cl.kmeans(_scaled_embeddings(spark, sf), "scaled", 10)
    return out.select("vec_id", "cluster")


# mean distance to the nearest 30 % at sf0.01, every point counted (10.93 at sf0.1)
BANDWIDTH = 10.94


@register("g3_meanshift")
def g3_meanshift(spark, sf):
    """Flat-kernel mean shift of the standardised embeddings."""
    out, _ = cl.meanshift(_scaled_embeddings(spark, sf), "scaled", BANDWIDTH)
    return out.select("vec_id", "cluster")


@register("g4_assign_nearest")
def g4_assign_nearest(spark, sf):
    """Every embedding assigned to its nearest KMeans centre (with the
    distance to it), centres fitted on the same data."""
    sc = _scaled_embeddings(spark, sf)
    _, model = cl.kmeans(sc, "scaled", 10)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    return cl.assign(sc.select("vec_id", "scaled"), "scaled", centres).select("vec_id", "cluster")


CENTRES_SQL = ["""ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
                                unnest(range(len(embedding))) AS dim FROM embeddings)""",
               "mo AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM ex GROUP BY dim)",
               """z AS (SELECT vec_id, any_value(label) AS label, list(CASE WHEN s = 0 THEN 0.0 ELSE (x - m) / s END
                       ORDER BY dim) AS v FROM ex JOIN mo USING (dim) GROUP BY vec_id)""",
               """ce AS (SELECT v AS c, row_number() OVER (ORDER BY label) - 1 AS k FROM z
                         WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))""",
               """nearest AS (SELECT vec_id, v, CAST(arg_min(k, (d, k)) AS INTEGER) AS cluster FROM (
                    SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c),
                           lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM z, ce) GROUP BY vec_id, v)"""]


def _row_centres(spark, sf):
    """(standardised embeddings, the first one of every label as centres)."""
    sc = _scaled_embeddings(spark, sf)
    labels = io.read_table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    rows = sc.join(F.broadcast(labels), "vec_id").orderBy("label").collect()   # a row per label
    return sc, [list(r["scaled"]) for r in rows]


@register("g4_assign_to_rows", sql="WITH " + ",\n".join(CENTRES_SQL) + " SELECT vec_id, cluster FROM nearest")
def g4_assign_to_rows(spark, sf):
    """Every embedding assigned to the nearest of ten given centres."""
    sc, centres = _row_centres(spark, sf)
    return cl.assign(sc.select("vec_id", "scaled"), "scaled", centres).select("vec_id", "cluster")


@register("g5_search_among_rows", sql="WITH " + ",\n".join(CENTRES_SQL) + """,
      q AS (SELECT v AS qv, cluster AS qc FROM nearest WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
      hits AS (SELECT vec_id, cluster, list_dot_product(v, qv) / sqrt(list_dot_product(v, v) *
                      list_dot_product(qv, qv)) AS sim FROM nearest, q
               WHERE cluster = qc AND vec_id <> (SELECT min(vec_id) FROM embeddings))
    SELECT vec_id, cluster, round(sim, 6) AS similarity FROM hits WHERE sim >= 0.05""")
def g5_search_among_rows(spark, sf):
    """Vectors in the cluster of the first embedding (given centres), cosine >= 0.05."""
    sc, centres = _row_centres(spark, sf)
    query = sc.orderBy("vec_id").first()
    put = cl.assign(sc.select("vec_id", "scaled"), "scaled", centres).where(F.col("vec_id") != query["vec_id"])
    put = put.select(F.col("vec_id").alias("element"), "cluster", F.col("scaled").alias("embedding_scaled"))
    hits = cl.search_within_cluster(put, list(query["scaled"]), centres, threshold=0.05)
    return hits.select(F.col("element").alias("vec_id"), "cluster", _r(F.col("similarity"), "similarity"))


@register("g5_search_within_cluster")
def g5_search_within_cluster(spark, sf):
    """Hashtags in the cluster of the most mentioned tag, cosine >= 0.5."""
    from postlytics.operators import graph as gr
    tags = _distinct_tags(spark, sf)
    words = sg.segmenter(_counts(spark, sf))
    out, info = cl.cluster_elements(tags, "tag", EMB, n_clusters=8, segmenter=words)
    query = gr.popular_tags(dv.tags(spark, sf), "post_id", "tags", 1).first()["tag"]
    asked = words(spark.createDataFrame([(query,)], "element string"), "element", "segmented")
    qv = EMB.embed(asked, "segmented").first()["embedding"]
    qs = cl.scale_literal(qv, info["means"], info["stds"])
    hits = cl.search_within_cluster(out.where(F.col("element") != query), qs, info["centres"])
    return hits.select(F.col("element").alias("tag"), "cluster", _r(F.col("similarity"), "similarity"))


# --- J -------------------------------------------------------------------------

@register("j2_folds", sql=with_ctes(
    ["posts"], """SELECT post_id, label, CAST(('0x' || substr(md5(CAST(label AS VARCHAR) || ':' ||
                   CAST(post_id AS VARCHAR)), 1, 8))::BIGINT % 3 AS INTEGER) AS fold
                  FROM posts WHERE split IN ('train', 'validation')"""))
def j2_folds(spark, sf):
    """Cross-validation folds of train + validation (label-salted md5)."""
    p = dv.posts(spark, sf).where(F.col("split").isin("train", "validation"))
    return p.select("post_id", "label", md.fold_column("post_id", "label").alias("fold"))


FOLDS_SQL = with_ctes(["posts"], """
  SELECT r.post_id, r.label, CAST(count(*) FILTER (e.upto <= r.r) AS INTEGER) AS fold
  FROM r JOIN e USING (label) GROUP BY r.post_id, r.label""", extra=[
    "tv AS (SELECT post_id, label FROM posts WHERE split IN ('train', 'validation'))",
    """c AS (SELECT label, row_number() OVER (ORDER BY min(post_id)) AS c FROM tv GROUP BY label)""",
    """r AS (SELECT post_id, label, row_number() OVER (ORDER BY c, post_id) - 1 AS p,
             row_number() OVER (PARTITION BY label ORDER BY post_id) - 1 AS r FROM tv JOIN c USING (label))""",
    """e AS (SELECT label, f, sum(n) OVER (PARTITION BY label ORDER BY f) AS upto FROM (
             SELECT label, f, count(*) FILTER (p % 3 = f) AS n FROM r, range(3) x(f) GROUP BY label, f))"""])


@register("j2_stratified_folds", sql=FOLDS_SQL)
def j2_stratified_folds(spark, sf):
    """The unshuffled stratified folds that trials are scored on."""
    p = dv.posts(spark, sf).where(F.col("split").isin("train", "validation"))
    return md.stratified_folds(p.select("post_id", "label"))


def _features(spark, sf, method="tfidf"):
    p = dv.posts(spark, sf)
    tv = p.where(F.col("split").isin("train", "validation"))
    te = io.pick_split(p, "test")
    (a, b), _ = md.featurize(tv, [te], method)
    return a, b


@register("j3_tune_best_trial")
def j3_tune_best_trial(spark, sf, n_trials=md.N_TRIALS["tfidf"], store=None):
    """The reference's number of seeded logistic-regression trials, 3 folds each, on train +
    validation TF-IDF; one row per trial with its mean weighted F1. With a ``store`` of an
    earlier run, only trials that it lacks are fitted."""
    tv, _ = _features(spark, sf)
    trials = md.draw_trials(md.LOGREG_SPACE, n_trials)
    scored = md.optimize(tv, "logreg", trials, store or io.scratch_path(spark, "trials"), "logreg_tfidf")
    params = spark.createDataFrame([(i, float(t["C"]), t["penalty"]) for i, t in enumerate(trials)],
                                   "trial int, C double, penalty string")
    return (params.join(scored, "trial")
            .select("trial", "C", "penalty", F.col("score").alias("cv_f1_weighted"), "best"))


@register("j6_fit_predict")
def j6_fit_predict(spark, sf):
    """Logistic regression (C = 1, l2) fitted on train + validation
    TF-IDF, predictions for the test split."""
    tv, te = _features(spark, sf)
    pred, _ = md.fit_predict(tv, te, "logreg", {"C": 1.0, "penalty": "l2"})
    return pred


TERM_VECTOR_SQL = with_ctes(["texts"], """
  SELECT post_id, list(idx ORDER BY idx) AS indices, list(round(w / nr, 6) ORDER BY idx) AS "values" FROM (
    SELECT t.post_id, idx, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t.post_id)) AS nr
    FROM tf t JOIN v USING (term)) GROUP BY post_id""", extra=[
    r"""tf AS (SELECT post_id, term, count(*) AS tf FROM (
           SELECT post_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM texts)
         GROUP BY post_id, term)""",
    """v AS (SELECT term, CAST(row_number() OVER (ORDER BY encode(term)) - 1 AS INTEGER) AS idx,
             ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term)"""])


@register("j6_term_vectors", sql=TERM_VECTOR_SQL)
def j6_term_vectors(spark, sf):
    """The sparse vectors that models are fitted on, of all documents that have terms."""
    t = dv.texts(spark, sf)
    rounded = F.transform("values", lambda x: F.round(x, 6))
    return ft.fit_term_vectors(t).weights(t).select("post_id", "indices", rounded.alias("values"))


@register("j5_forest_predict")
def j5_forest_predict(spark, sf):
    """Random forest (reference space, one seeded trial) on hashed
    embeddings; test-split predictions."""
    tv, te = _features(spark, sf, "embedding")
    params = md.draw_trials(md.FOREST_SPACE, 1)[0]
    pred, _ = md.fit_predict(tv, te, "forest", params)
    return pred


@register("j7_experiment_grid")
def j7_experiment_grid(spark, sf, n_trials=None, store=None):
    """2 vectorisers x 2 models, tuned, fitted, scored: metrics, seconds and best parameters.
    Trials and spaces are the reference's."""
    return md.experiment_grid(dv.posts(spark, sf), store or io.scratch_path(spark, "grid"),
                              n_trials=n_trials or md.N_TRIALS, spaces=md.SPACES)


@register("j8_stored_model")
def j8_stored_model(spark, sf):
    """The model of j6 stored, loaded and applied to the test split."""
    tv, te = _features(spark, sf)
    path = io.scratch_path(spark, "model")
    md.save_model(md.make_estimator("logreg", {"C": 1.0, "penalty": "l2"}, tv.count()).fit(tv), path)
    return md.score_with(te, path)


def _length_rule_model():
    names = ["Negative", "Neutral", "Positive"]
    return lambda texts: [f"Sentiment: {names[len(t) % 3]}" for t in texts]


@register("j8_batch_score", sql=with_ctes(
    ["posts"], f"""SELECT post_id, raw, {dv.sql_parse_generation('raw')} AS y_pred FROM (
        SELECT post_id, 'Sentiment: ' || (['Negative','Neutral','Positive'])[length(text) % 3 + 1] AS raw
        FROM posts WHERE split = 'test')"""))
def j8_batch_score(spark, sf):
    """Batch scoring of the test posts by a user model (batches of 8),
    then parsing of its output."""
    t = io.pick_split(dv.posts(spark, sf), "test")
    scored = md.batch_score(t, "text", _length_rule_model)
    return scored.select("post_id", "raw", tx.parse_generation("raw").alias("y_pred"))
