"""Operator 1, exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it: pivots and the ring
boundaries of each pivot come from a bounded sample, all vectors are indexed. The
vectors of a ring lie in blocks of at most ``BLOCK`` rows, each block one packed row.

For a query q and a ring of pivot p with distances lo..hi, the triangle inequality gives
|q - x| >= max(0, |q - p| - hi, lo - |q - p|) for its vectors x, and with
2 q.x = |q|^2 + |x|^2 - |q - x|^2 an upper bound of their scores; q.p + |q| hi is another.
Rings are expanded in descending order of the smaller bound: first every query's best
rings, then, in rounds, all rings whose bound reaches the k-th score found so far. A
query stops when no ring is left whose bound reaches its k-th score, so the result is
exact, ties included.

Queries and index meet as packed blocks (a bounded chunk of queries with a block), so no
group of equal vectors and no query set has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table

PIVOTS = 32
RINGS = 16        # rings of a pivot
SAMPLE = 20_000   # vectors that pivots and rings are fitted on
BLOCK = 2048      # vectors in a block
CHUNK = 512       # queries in a chunk
FIRST = 2         # rings of every query's first round
GROW = 8          # each later round expands so many times more rings


def quantized(embedding, scale: int = 256):
    """floor(scale * x) of every component x, as a double; null unless all are finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(
        embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Rings:
    """Pivots, ring boundaries and what is known of each ring; bounded by the parameters."""

    def __init__(self, sample, pivots: int, rings: int):
        import numpy as np

        x = np.asarray(sample, "float64")
        # farthest-first pivots: each the sample vector farthest from those before it
        chosen, d = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(x)) and d.max() > 0:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
        self.pivots = x[chosen]
        near, dist = self.nearest(x)
        self.cuts = [np.unique(np.quantile(dist[near == p], np.linspace(0, 1, rings + 1)[1:-1]))
                     if (near == p).any() else np.zeros(0) for p in range(len(chosen))]
        self.first = np.cumsum([0] + [len(c) + 1 for c in self.cuts])

    def nearest(self, x):
        import numpy as np

        d2 = ((x ** 2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots ** 2).sum(1)[None, :])
        near = d2.argmin(1)
        return near, np.sqrt(((x - self.pivots[near]) ** 2).sum(1))

    def ring(self, x):
        """(ring number, distance to its pivot) of each vector."""
        import numpy as np

        near, dist = self.nearest(x)
        ring = np.empty(len(x), "int64")
        for p in np.unique(near):
            ring[near == p] = self.first[p] + np.searchsorted(self.cuts[p], dist[near == p])
        return ring, dist


def _bounds(q, rings, known):
    """Upper bounds of the scores of queries (rows) with the vectors of each known ring."""
    import numpy as np

    pivots = rings.pivots[known["pivot"]]
    q2 = (q ** 2).sum(1)[:, None]
    qp = q @ pivots.T
    d = np.sqrt(np.maximum(0, q2 - 2 * qp + (pivots ** 2).sum(1)[None, :]))
    gap = np.maximum(0, np.maximum(d - known["hi"][None, :], known["lo"][None, :] - d) - 1e-6)
    by_distance = (q2 + known["norm2"][None, :] - gap ** 2) / 2
    by_pivot = qp + np.sqrt(q2) * known["hi"][None, :]
    return np.minimum(by_distance, by_pivot) * (1 + 1e-9) + 1e-3


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
          vec_col: str = "embedding", pivots: int = PIVOTS, n_rings: int = RINGS) -> DataFrame:
    """The ``k`` highest integer inner products of every query with the rows of ``vectors``
    of another id: query_id, rank (from 1), vec_id, score; ties go to the smaller id. Of
    several queries with one id the smallest vector asks.

    ``vectors`` and ``queries`` hold an id and floats; components x count as floor(256 x).
    Vectors that are null, empty or hold null or non-finite components and null ids take no
    part. A query meets the vectors of its own length; every length that is asked for has
    its index. Rows repeated with one id are all candidates. Fewer candidates than ``k``
    give fewer rows; an empty table none. Other columns are ignored.
    """
    def clean(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vec_col)).alias("v"))
                .filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"))

    every = stored(clean(vectors))
    asked = stored(clean(queries).groupBy("id").agg(F.min("v").alias("v")))
    n_by_dim = {r["dim"]: r["n"] for r in every.groupBy(F.size("v").alias("dim"))
                .agg(F.count("*").alias("n")).collect()}
    dims = sorted(r["dim"] for r in asked.select(F.size("v").alias("dim")).distinct().collect())
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for i, dim in enumerate([d for d in dims if d in n_by_dim]):
        of_dim = _top_k(every.filter(F.size("v") == dim), asked.filter(F.size("v") == dim),
                        dim, n_by_dim[dim], k, pivots, n_rings)
        out = out.unionByName(of_dim) if i else of_dim
    return out


def _top_k(every: DataFrame, asked: DataFrame, dim: int, total: int, k: int, pivots: int,
           n_rings: int) -> DataFrame:
    """``top_k`` of the queries ``asked`` (id, v) and ``total`` vectors of one length."""
    import numpy as np

    step = max(1, total // SAMPLE)
    sampled = (every.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(2 * SAMPLE)
               .toPandas())
    if sampled.empty:
        sampled = every.limit(SAMPLE).toPandas()
    sampled = sampled.sort_values("id")
    rings = Rings(np.stack(sampled["v"]), pivots, n_rings)

    def key(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"]).astype("float64")
                ring, dist = rings.ring(x)
                yield pdf.assign(ring=ring, dist=dist, norm2=(x ** 2).sum(1))

    # a ring's rows are dealt to blocks by a hash of their id, however many it holds
    keyed = stored(every.mapInPandas(key, "id long, v array<long>, ring long, dist double, norm2 double"))
    size = keyed.groupBy("ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"),
                                     F.max("dist").alias("hi"), F.max("norm2").alias("norm2"))
    known_rows = size.toPandas().sort_values("ring")      # at most pivots * n_rings rows
    pivot_of = np.searchsorted(rings.first, known_rows["ring"].to_numpy(), side="right") - 1
    known = {"pivot": pivot_of, "ring": known_rows["ring"].to_numpy(),
             "lo": known_rows["lo"].to_numpy(), "hi": known_rows["hi"].to_numpy(),
             "norm2": known_rows["norm2"].to_numpy()}
    parts = np.maximum(1, -(-known_rows["n"].to_numpy() // (BLOCK // 2)))
    known["parts"] = parts
    n_parts = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(known["ring"], parts)
                                          for x in pair]), F.col("ring"))

    def block(pdf):
        import pandas as pd

        x = np.stack(pdf["v"]).astype("<i8")
        return pd.DataFrame({"ring": [pdf["ring"].iloc[0]], "part": [pdf["part"].iloc[0]],
                             "ids": [pdf["id"].to_numpy("<i8").tobytes()], "x": [x.tobytes()]})

    blocks = stored(keyed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), n_parts))
                    .groupBy("ring", "part")
                    .applyInPandas(block, "ring long, part long, ids binary, x binary"))

    best = None      # (query_id, vec_id, score) of the rounds so far, k for each query
    lo, hi = 0, FIRST
    n_known = len(known["ring"])
    while lo < n_known:
        ask = asked.withColumn("bar", F.lit(None).cast("double"))
        if best is not None:
            bar = (best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("m"))
                   .select(F.col("query_id").alias("id"),
                           F.when(F.col("n") >= k, F.col("m").cast("double")).alias("bar")))
            ask = asked.join(bar, "id", "left")
        targets = stored(ask.mapInPandas(
            _targets(rings, known, lo, hi), "ring long, part long, id long, v array<long>"))
        if best is not None and targets.isEmpty():
            break
        chunks = (targets.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(
                      max(1, -(-asked.count() // CHUNK)))))
                  .groupBy("ring", "part", "chunk")
                  .applyInPandas(_chunk, "ring long, part long, qids binary, q binary"))
        found = chunks.join(blocks, ["ring", "part"]).mapInPandas(
            _score(dim, k), "query_id long, vec_id long, score long")
        found = found if best is None else found.unionByName(best)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = stored(found.withColumn("rank", F.row_number().over(order))
                      .filter(F.col("rank") <= k).drop("rank"))
        lo, hi = hi, hi * GROW
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def _targets(rings, known, lo: int, hi: int):
    """Each query with the blocks of the rings lo..hi-1 in its order whose bound reaches its bar."""
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            q = np.stack(pdf["v"]).astype("float64")
            bound = _bounds(q, rings, known)
            order = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
            reach = np.take_along_axis(bound, order, 1)
            bar = pdf["bar"].fillna(-np.inf).to_numpy("float64")
            i, j = np.nonzero(reach >= bar[:, None])
            ring = order[i, j]
            n = known["parts"][ring]
            i, ring = np.repeat(i, n), np.repeat(ring, n)
            part = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            for s in range(0, len(i), 4096):
                some = i[s:s + 4096]
                yield pd.DataFrame({"ring": known["ring"][ring[s:s + 4096]], "part": part[s:s + 4096],
                                    "id": pdf["id"].to_numpy()[some],
                                    "v": [pdf["v"].iloc[x] for x in some]})
    return run


def _chunk(pdf):
    import numpy as np
    import pandas as pd

    return pd.DataFrame({"ring": [pdf["ring"].iloc[0]], "part": [pdf["part"].iloc[0]],
                         "qids": [pdf["id"].to_numpy("<i8").tobytes()],
                         "q": [np.stack(pdf["v"]).astype("<i8").tobytes()]})


def _score(dim: int, k: int):
    """Integer inner products of a chunk of queries with a block; the k best for each query."""
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                q = np.frombuffer(row.q, "<i8").reshape(-1, dim)
                x = np.frombuffer(row.x, "<i8").reshape(-1, dim)
                qid, xid = np.frombuffer(row.qids, "<i8"), np.frombuffer(row.ids, "<i8")
                order = np.argsort(xid, kind="stable")
                x, xid = x[order], xid[order]
                # exact in doubles while every partial sum stays below 2^53
                small = max(np.abs(q).max(), 1) * max(np.abs(x).max(), 1) * dim < 1 << 53
                s = ((q.astype("f8") @ x.astype("f8").T).astype("i8") if small else q @ x.T)
                own = qid[:, None] == xid[None, :]
                s = np.where(own, np.iinfo("i8").min, s)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k] if not own.any() else \
                    np.argsort(np.where(own, np.iinfo("i8").max, -s), axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(qid)), top.shape[1])
                cols = top.ravel()
                real = ~own[rows, cols]
                yield pd.DataFrame({"query_id": qid[rows][real], "vec_id": xid[cols][real],
                                    "score": s[rows, cols][real]})
    return run


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@register("op1_pivot_top_k", OP1_SQL)
def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every embedding whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)
