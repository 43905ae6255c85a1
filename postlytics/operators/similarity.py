"""Cosine similarity.

The query side is always a short, user-given list of elements; their
vectors are computed once (constant-folded for expression embedders, one
bounded lookup otherwise) and enter the plan as literals. So there is no
join between the query and the data, let alone a cross join: every data
row is compared with the literal query vectors inside one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.operators.embed import Embedder, HashedNgramEmbedder, element_vectors
from postlytics.operators.frames import as_list, row_mean


def as_double_array(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays; a zero vector gives 0."""
    a = as_double_array(a)
    b = as_double_array(b)
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def vector_literal(vec: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vec])


def query_vectors(spark, queries: Sequence[str], embedder: Embedder) -> list[list[float]]:
    """Vectors of the (few) query elements, fetched once."""
    df = spark.createDataFrame([(q,) for q in queries], "element string")
    rows = {r["element"]: r["embedding"] for r in embedder.embed(df, "element").collect()}
    return [rows[q] for q in queries]


def cos_sim_pairs(spark, a: Sequence[str], b: DataFrame, b_col: str,
                  embedder: Embedder | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """cosine of every (a, b) pair, ``a`` a short list of query elements.

    Output ``(keep..., a, b_col, cos_sim)``; for every b row the a elements
    come in list order (a-major order is obtained with ``orderBy(a_pos)``).
    """
    emb = embedder or HashedNgramEmbedder()
    qv = query_vectors(spark, list(a), emb)
    bv = emb.add_column(b, b_col, "_bv")
    pairs = F.array(*[F.struct(F.lit(i).alias("a_pos"), F.lit(q).alias("a"),
                               cosine(vector_literal(v), F.col("_bv")).alias("cos_sim"))
                      for i, (q, v) in enumerate(zip(a, qv))])
    return (bv.select(*keep, b_col, F.explode_outer(pairs).alias("_p"))
            .select(*keep, F.col("_p.a_pos").alias("a_pos"), F.col("_p.a").alias("a"),
                    b_col, F.col("_p.cos_sim").alias("cos_sim")))


def mean_similarity(df: DataFrame, id_col: str, query: str, column: str, output_column: str,
                    embedder: Embedder | None = None) -> DataFrame:
    """mean cosine between ``query`` and the elements of ``column`` per row.

    Scalar columns are treated as one-element lists (by schema). A row with
    no elements gets NULL. The input frame is not modified; a new one is
    returned with ``output_column`` added.
    """
    return compute_similarity(df, id_col, query, [column], embedder, with_mean=False) \
        .withColumnRenamed(f"{column}_cos_sim", output_column)


def compute_similarity(df: DataFrame, id_col: str, query: str, columns: Sequence[str],
                       embedder: Embedder | None = None, with_mean: bool = True) -> DataFrame:
    """F2 for several columns (``<col>_cos_sim``) and their row mean ``cos_sim``.

    All columns are handled in one pass: their elements are exploded into
    one frame tagged with the column name, joined to the element vectors
    once, averaged per ``(row, column)`` and pivoted back.
    """
    emb = embedder or HashedNgramEmbedder()
    spark = df.sparkSession
    qv = vector_literal(query_vectors(spark, [query], emb)[0])
    parts = None
    for c in columns:
        ex = (df.select(id_col, F.lit(c).alias("_col"), F.explode_outer(as_list(df, c)).alias("element"))
              .where(F.col("element").isNotNull()))
        parts = ex if parts is None else parts.unionByName(ex)
    # element mentions feed both the distinct-element embedding and the join:
    # persisted so the posts are exploded once
    from pyspark import StorageLevel
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    vecs = element_vectors(parts.select(F.array("element").alias("e")), "e", emb)
    scored = parts.join(vecs, "element").withColumn("_s", cosine(qv, F.col("embedding")))
    means = (scored.groupBy(id_col).pivot("_col", list(columns)).agg(F.avg("_s")))
    out = df.join(means.select(id_col, *[F.col(f"`{c}`").alias(f"{c}_cos_sim") for c in columns]),
                  id_col, "left")
    if with_mean:
        out = out.withColumn("cos_sim", row_mean([f"{c}_cos_sim" for c in columns]))
    return out
