"""Clustering of embedded elements.

* G2 KMeans: ``pyspark.ml.clustering.KMeans`` (k-means|| init, seeded).
* G3 MeanShift (flat kernel): every occupied cell of a grid of the bandwidth
  is a seed, however many there are. Seeds move independently of each other,
  so they are dealt to blocks of ``SEED_BLOCK`` that fit a task; each round,
  every partition sums the points within the bandwidth of each seed that
  still moves (numpy, Arrow batches) and one ``groupBy(seed)`` combines the
  partial sums. Only the seeds travel to the driver. Near-duplicate centres
  are merged, and every point goes to its nearest centre.
* G4: nearest centre of every vector (ties: lowest centre id).
* G5: search inside the query's cluster by cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.operators import features as ft
from postlytics.operators.similarity import cosine, vector_literal
from postlytics.session import cut_lineage

SEED_BLOCK = 2000  # seeds per pass over the points
BANDWIDTH_SAMPLE = 2000


def to_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(col)))


def kmeans(df: DataFrame, vec_col: str, k: int, seed: int = 42, max_iter: int = 100):
    """``(df + cluster, model)``; centres are ``model.clusterCenters()``."""
    from pyspark.ml.clustering import KMeans
    data = to_vector(df, vec_col, "_features")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="cluster", initMode="k-means||").fit(data)
    return model.transform(data).drop("_features"), model


CHUNK = 4096  # rows per distance block: memory is CHUNK x centres doubles


def _sqdist(pts: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of a block of points to all centres (matmul form)."""
    d = (pts * pts).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * pts @ c.T
    return np.maximum(d, 0.0)


def _blocks(pdf: pd.DataFrame, vec_col: str):
    for i in range(0, len(pdf), CHUNK):
        part = pdf[vec_col].iloc[i:i + CHUNK]
        yield np.stack(part.map(lambda v: np.asarray(v, dtype="float64")).to_numpy())


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, min(CHUNK, CHUNK * SEED_BLOCK // max(1, len(centres))))
    out = [_sqdist(points[i:i + step], centres).argmin(axis=1) for i in range(0, len(points), step)]
    return np.concatenate(out) if out else np.zeros(0, dtype="int64")  # ties: lowest id


def assign(df: DataFrame, vec_col: str, centres, out_col: str = "cluster") -> DataFrame:
    """Index of the nearest centre (squared Euclidean), ties -> lowest."""
    c = np.asarray(centres, dtype="float64")
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{out_col: pd.Series(dtype="int32")})
                continue
            pts = np.stack(pdf[vec_col].map(lambda v: np.asarray(v, dtype="float64")).to_numpy())
            yield pdf.assign(**{out_col: _nearest(pts, c).astype("int32")})

    return df.mapInPandas(run, schema)


def estimate_bandwidth(df: DataFrame, vec_col: str, quantile: float = 0.3,
                       sample: int = BANDWIDTH_SAMPLE, seed: int = 42) -> float:
    """Mean distance to the ``quantile * n``-th nearest neighbour, over a
    seeded sample of at most ``sample`` points: a help for choosing the
    bandwidth, which :func:`meanshift` doesn't call."""
    n = df.count()
    frac = min(1.0, sample / max(n, 1))
    pts = [np.asarray(r[0], dtype="float64")
           for r in df.select(vec_col).sample(False, frac, seed).limit(sample).collect()]
    if len(pts) < 2:
        return 1.0
    x = np.stack(pts)
    k = max(1, int(len(x) * quantile))
    d = np.sqrt(_sqdist(x, x))
    d.sort(axis=1)
    return float(d[:, min(k, len(x) - 1)].mean())


def _bin_seeds(points: DataFrame, vec_col: str, bandwidth: float) -> np.ndarray:
    """Centres of all occupied grid cells, in order."""
    cells = points.select(F.transform(vec_col, lambda x: F.round(x / bandwidth) + 0.0).alias("cell")).distinct()
    return np.asarray(sorted(list(r["cell"]) for r in cells.collect()), dtype="float64") * bandwidth


def _shifted(points: DataFrame, vec_col: str, s: np.ndarray, bw: float) -> tuple[np.ndarray, np.ndarray]:
    """(means of the points within ``bw`` of each seed, their numbers)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros_like(s)
        cnt = np.zeros(len(s))
        for pdf in batches:
            for pts in _blocks(pdf, vec_col):
                near = _sqdist(pts, s) <= bw * bw
                acc += near.T.astype("float64") @ pts
                cnt += near.sum(axis=0)
        yield pd.DataFrame({"seed": np.arange(len(s)), "n": cnt, "sum": list(acc)})

    part = points.mapInPandas(run, "seed long, n double, sum array<double>").cache()
    # combine the per-partition partial sums: (seed, dim) sums and (seed) counts
    sums_rows = (part.select("seed", F.posexplode("sum").alias("d", "x"))
                 .groupBy("seed", "d").agg(F.sum("x").alias("x")).collect())
    n_rows = part.groupBy("seed").agg(F.sum("n").alias("n")).collect()
    part.unpersist()
    new = np.zeros_like(s)
    for r in sums_rows:
        new[r["seed"], r["d"]] = r["x"]
    n = np.zeros(len(s))
    for r in n_rows:
        n[r["seed"]] = r["n"]
    new[n > 0] /= n[n > 0, None]
    return new, n


def meanshift(df: DataFrame, vec_col: str, bandwidth: float, max_iter: int = 300):
    """``(df + cluster, centres)`` by flat-kernel mean shift. Each seed stops for
    itself when a round moves it by less than a thousandth of the bandwidth, so the result
    doesn't depend on the blocks."""
    points = df.select(vec_col).cache()
    seeds = _bin_seeds(points, vec_col, bandwidth)
    ends = []
    for i in range(0, len(seeds), SEED_BLOCK):
        at = seeds[i:i + SEED_BLOCK].copy()
        moving = np.arange(len(at))
        alive = np.ones(len(at), dtype=bool)
        for _ in range(max_iter):
            new, n = _shifted(points, vec_col, at[moving], bandwidth)
            alive[moving[n == 0]] = False
            moving, new = moving[n > 0], new[n > 0]
            shift = np.sqrt(((new - at[moving]) ** 2).sum(axis=1))
            at[moving] = new
            moving = moving[shift >= 1e-3 * bandwidth]
            if not len(moving):
                break
        ends.append(at[alive])
    # seeds that ended at the same place are one
    centres = _merge_centres(points, vec_col, np.unique(np.concatenate(ends), axis=0), bandwidth) if ends else seeds
    points.unpersist()
    return assign(df, vec_col, centres), centres


def _merge_centres(points: DataFrame, vec_col: str, centres: np.ndarray, bw: float) -> np.ndarray:
    """Keep centres by descending support, dropping any within ``bw`` of a kept one."""
    sup = np.zeros(len(centres))
    for i in range(0, len(centres), SEED_BLOCK):
        c = centres[i:i + SEED_BLOCK]

        def run(batches: Iterator[pd.DataFrame], c=c) -> Iterator[pd.DataFrame]:
            cnt = np.zeros(len(c))
            for pdf in batches:
                for pts in _blocks(pdf, vec_col):
                    cnt += (_sqdist(pts, c) <= bw * bw).sum(axis=0)
            yield pd.DataFrame({"seed": np.arange(len(c)), "n": cnt})

        for r in points.mapInPandas(run, "seed long, n double").groupBy("seed").agg(
                F.sum("n").alias("n")).collect():
            sup[i + r["seed"]] = r["n"]
    order = sorted(range(len(centres)), key=lambda i: (-sup[i], tuple(centres[i])))
    kept = np.empty_like(centres)
    n = 0
    for i in order:
        if (np.sqrt(((centres[i] - kept[:n]) ** 2).sum(axis=1)) > bw).all():
            kept[n] = centres[i]
            n += 1
    return kept[:n]


def cluster_elements(df: DataFrame, element_col: str, embedder, n_clusters: int | None = None,
                     segmenter=None, seed: int = 42, bandwidth: float | None = None):
    """G1: segment (optional) -> embed -> standardise -> KMeans (``n_clusters``)
    or MeanShift (``bandwidth``); one of the two must be given. Returns ``(frame(element, cluster, embedding_scaled), info)``
    where ``info`` holds the model/centres and the scaler statistics."""
    if not n_clusters and not bandwidth:
        raise ValueError("give n_clusters or bandwidth")
    el = df.select(F.col(element_col).alias("element")).where(F.col("element").isNotNull()).distinct()
    text = "element"
    if segmenter is not None:
        el = segmenter(el, "element", "segmented")
        text = "segmented"
    # read by the statistics, by every pass of the clustering and by its result
    emb = cut_lineage(embedder.add_column(el, text, "embedding"))
    means, stds = ft.column_stats(emb, "embedding")
    scaled = ft.standardize(emb, "embedding", "embedding_scaled")
    if n_clusters:
        out, model = kmeans(scaled, "embedding_scaled", n_clusters, seed)
        centres = [list(map(float, c)) for c in model.clusterCenters()]
    else:
        out, c = meanshift(scaled, "embedding_scaled", bandwidth)
        centres, model = [list(map(float, x)) for x in c], None
    info = {"model": model, "centres": centres, "means": means, "stds": stds}
    return out.select("element", "cluster", "embedding_scaled"), info


def scale_literal(vec, means, stds):
    return [0.0 if s == 0 else (v - m) / s for v, m, s in zip(vec, means, stds)]


def search_within_cluster(clustered: DataFrame, query_vec_scaled, centres, k: int = -1,
                          threshold: float = 0.5) -> DataFrame:
    """Elements of the query's cluster (query itself excluded by the
    caller), cosine to the *scaled* query >= threshold, best first; ``k=-1``
    means all hits."""
    qc = int(_nearest(np.asarray([query_vec_scaled]), np.asarray(centres))[0])
    hits = (clustered.where(F.col("cluster") == qc)
            .withColumn("similarity", cosine(vector_literal(query_vec_scaled), F.col("embedding_scaled")))
            .where(F.col("similarity") >= threshold)
            .select("element", "cluster", "similarity"))
    ordered = hits.orderBy(F.col("similarity").desc(), F.col("element"))
    return ordered if k is None or k < 0 else ordered.limit(k)
