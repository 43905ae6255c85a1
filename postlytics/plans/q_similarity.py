"""Registered queries: embeddings (D5-D8) and similarity."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from postlytics.operators import embed as em
from postlytics.operators import features as ft
from postlytics.operators import similarity as sm
from postlytics.plans import derived as dv
from postlytics.plans.derived import with_ctes
from postlytics.plans.q_core import _r
from postlytics.plans.registry import register
from postlytics.sources import io

EMB = em.HashedNgramEmbedder()
QUERY = "information"


def _long(df, key_cols, vec_col, name="value"):
    """Vector column -> ``(keys..., dim, value)`` rounded."""
    return (df.select(*key_cols, F.posexplode_outer(vec_col).alias("dim", "_v"))
            .where(F.col("dim").isNotNull())
            .select(*key_cols, F.col("dim").cast("int").alias("dim"), _r(F.col("_v"), name)))


def sql_cos(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE {dot} / ({na} * {nb}) END)"


def numpy_hashed_embedder(dim: int = 64, n: int = 3):
    """The hashed n-gram embedding as plain Python (a stand-in 'model' for
    the pandas embedder path; same numbers as the Spark expression)."""
    import numpy as np

    def f(texts):
        out = []
        for t in texts:
            s = " " + t.lower().removeprefix("#") + " "
            grams = [s] if len(s) < n else [s[i:i + n] for i in range(len(s) - n + 1)]
            v = np.zeros(dim)
            for g in grams:
                v[int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % dim] += 1
            out.append((v / np.sqrt((v * v).sum())).tolist())
        return out
    return f


@register("d5_embed_posts", sql=with_ctes(
    ["texts"], f"""SELECT t.post_id, CAST(d.dim AS INTEGER) AS dim, round(coalesce(c.n, 0) / nr, 6) AS value
        FROM texts t JOIN nr USING (post_id) CROSS JOIN (SELECT unnest(range({EMB.dim})) AS dim) d
        LEFT JOIN c ON c.post_id = t.post_id AND c.b = d.dim""",
    extra=["s AS (SELECT post_id, ' ' || lower(regexp_replace(text, '^#', '')) || ' ' AS s FROM texts)",
           """ch AS (SELECT post_id, unnest(string_split(s, '')) AS c,
                         generate_subscripts(string_split(s, ''), 1) AS i FROM s WHERE length(s) > 2)""",
           """gr AS (SELECT post_id, s AS gram FROM s WHERE length(s) <= 2 UNION ALL SELECT post_id, gram FROM (
                  SELECT post_id, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS gram FROM ch
                  WINDOW w AS (PARTITION BY post_id ORDER BY i)) WHERE gram IS NOT NULL)""",
           f"g AS (SELECT post_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % {EMB.dim} AS b FROM gr)",
           "c AS (SELECT post_id, b, count(*) AS n FROM g GROUP BY ALL)",
           "nr AS (SELECT post_id, sqrt(sum(n * n)) AS nr FROM c GROUP BY post_id)"]))
def d5_embed_posts(spark, sf):
    """Hashed character-trigram embeddings of all whole texts (long form)."""
    p = dv.texts(spark, sf)
    return _long(em.embed_column(p, "text", EMB, keep=["post_id"]), ["post_id"], "embedding")


@register("d6_embed_distinct_tags", sql=with_ctes(
    ["tags"], """SELECT post_id, CAST(pos AS INTEGER) AS pos, tag, CAST(dim AS INTEGER) AS dim,
                        round(v, 6) AS value FROM (
                   SELECT post_id, pos, tag, unnest(e) AS v, unnest(range(len(e))) AS dim
                   FROM ex JOIN ee USING (tag))""",
    extra=["ex AS (SELECT post_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM tags)",
           "dt AS (SELECT DISTINCT tag FROM ex)"] + EMB.sql_ctes("ee", "dt", "tag", "tag")))
def d6_embed_distinct_tags(spark, sf):
    """A Python embedder applied once per distinct tag, joined back to every mention."""
    t = (dv.tags(spark, sf).select("post_id", F.posexplode_outer("tags").alias("pos", "tag"))
         .where(F.col("pos").isNotNull()))
    model = em.PandasEmbedder(lambda: numpy_hashed_embedder(), dim=64)
    out = em.embed_distinct(t, "tag", model)
    return _long(out, ["post_id", F.col("pos").cast("int").alias("pos"), "tag"], "embedding")


@register("d7_mean_tag_embedding", sql=with_ctes(
    ["tags"], """SELECT post_id, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS value FROM (
                   SELECT post_id, unnest(e) AS v, unnest(range(len(e))) AS dim
                   FROM ex JOIN ee USING (tag)) GROUP BY post_id, dim""",
    extra=["ex AS (SELECT post_id, unnest(tags) AS tag FROM tags)",
           "dt AS (SELECT DISTINCT tag FROM ex)"] + EMB.sql_ctes("ee", "dt", "tag", "tag")))
def d7_mean_tag_embedding(spark, sf):
    """Mean embedding of each post's hashtags (repeats count)."""
    t = dv.tags(spark, sf)
    return _long(em.mean_embedding(t, "post_id", "tags", EMB), ["post_id"], "embedding")


@register("d8_standardize", sql="""WITH ex AS (
        SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
      st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM ex GROUP BY dim)
    SELECT vec_id, CAST(dim AS INTEGER) AS dim,
           round(CASE WHEN s = 0 THEN 0.0 ELSE (x - m) / s END, 6) AS value
    FROM ex JOIN st USING (dim)""")
def d8_standardize(spark, sf):
    """Standardise every embedding dimension (population std; constant -> 0)."""
    e = io.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _long(ft.standardize(e, "embedding", "z"), ["vec_id"], "z", "value")


@register("f1_cos_sim_pairs", sql="""WITH
      q AS (SELECT CAST(vec_id AS VARCHAR) AS a, CAST(vec_id AS INTEGER) AS a_pos,
                   CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id IN (0, 1)),
      b AS (SELECT CAST(vec_id AS VARCHAR) AS element, CAST(embedding AS DOUBLE[]) AS bv FROM embeddings)
    SELECT a_pos, a, element, round(""" + sql_cos("qv", "bv") + """, 6) AS cos_sim FROM q JOIN b ON true""")
def f1_cos_sim_pairs(spark, sf):
    """cosine of query vectors 0 and 1 against every embedding (a-major)."""
    e = io.read_table(spark, sf, "embeddings")
    table = e.select(F.col("vec_id").cast("string").alias("element"), "embedding")
    model = em.TableEmbedder(table, "element", "embedding")
    out = sm.cos_sim_pairs(spark, ["0", "1"], table.select("element"), "element", model)
    return out.select(F.col("a_pos").cast("int").alias("a_pos"), "a", "element",
                      _r(F.col("cos_sim"), "cos_sim"))


def _sql_col_sim(src: str, col: str, scalar: bool = False) -> list[str]:
    el = f"[{col}]" if scalar else col
    return [
        f"ex_{col} AS (SELECT post_id, unnest({el}) AS e FROM {src})",
        f"de_{col} AS (SELECT DISTINCT e AS el FROM ex_{col})",
    ] + EMB.sql_ctes(f"ee_{col}", f"de_{col}", "el", "el") + [
        f"""sc_{col} AS (SELECT post_id, avg({sql_cos('q', 'v')}) AS s FROM ex_{col}
                       JOIN (SELECT el AS e, e AS v FROM ee_{col}) USING (e), qv GROUP BY post_id)""",
    ]


_QV = f"qv AS (SELECT {EMB.sql(chr(39) + QUERY + chr(39))} AS q)"


@register("f2_mean_similarity", sql=with_ctes(
    ["tags"], "SELECT t.post_id, round(sc_tags.s, 6) AS tags_cos_sim FROM tags t LEFT JOIN sc_tags USING (post_id)",
    extra=[_QV] + _sql_col_sim("tags", "tags")))
def f2_mean_similarity(spark, sf):
    """mean cosine between the query 'information' and each post's hashtags."""
    t = dv.tags(spark, sf)
    out = sm.mean_similarity(t, "post_id", QUERY, "tags", "tags_cos_sim", EMB)
    return out.select("post_id", _r(F.col("tags_cos_sim"), "tags_cos_sim"))


@register("f3_compute_similarity", sql=with_ctes(
    ["tags"], """SELECT p.post_id, round(a.s, 6) AS tags_cos_sim, round(b.s, 6) AS source_cos_sim,
        round(CASE WHEN a.s IS NULL AND b.s IS NULL THEN NULL
                   ELSE (coalesce(a.s, 0) + coalesce(b.s, 0))
                        / ((CASE WHEN a.s IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b.s IS NULL THEN 0 ELSE 1 END)) END, 6)
          AS cos_sim
      FROM prof p LEFT JOIN sc_tags a USING (post_id) LEFT JOIN sc_source b USING (post_id)""",
    extra=["prof AS (SELECT t.post_id, t.tags, d.source FROM tags t JOIN documents d ON d.doc_id = t.post_id)",
           _QV] + _sql_col_sim("prof", "tags") + _sql_col_sim("prof", "source", scalar=True)))
def f3_compute_similarity(spark, sf):
    """mean similarity over a list column (tags) and a scalar column
    (source), then their row mean."""
    t = dv.tags(spark, sf)
    d = io.read_table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "source")
    prof = t.join(d, "post_id")
    out = sm.compute_similarity(prof, "post_id", QUERY, ["tags", "source"], EMB)
    return out.select("post_id", _r(F.col("tags_cos_sim"), "tags_cos_sim"),
                      _r(F.col("source_cos_sim"), "source_cos_sim"), _r(F.col("cos_sim"), "cos_sim"))
