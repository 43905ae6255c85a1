"""Operator 11, importance resampling of documents towards a target distribution.

A text is lower-cased (A-Z only), and every run of separators becomes one space. Then an
overlapped scan with word-boundary lookarounds gives the span of every run of n words, and
the CRC-32 of the span's bytes, modulo ``BUCKETS``, is the feature's bucket. (UTF-8 bytes
serve as well as characters: all separators are ASCII, all other bytes belong to words.)

The logarithmic ratio of a bucket's smoothed shares in the target and in the documents is
its gain; a document's weight is the mean gain of its features. Keyed Gumbel noise on top
makes the largest scores a draw without replacement in proportion to exp(weight).

Texts are scanned once: the counts per bucket of each document are stored. Only bucket
totals (``BUCKETS`` rows, a parameter) reach the driver. The ranks come from a
range-partitioned sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table, whole_id, with_nulls
from postlytics.operators.encode import global_rank
from postlytics.session import ship_package

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10


def _separators() -> bytes:
    """Translation of bytes: A-Z to a-z, every other ASCII byte that is no a-z or 0-9 to a space."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in keep else 0x20 for c in range(256))


SEPARATED = _separators()


def collapsed(text: str) -> bytes:
    """The words of a text (null: none), one space between them."""
    import regex

    data = text.encode("utf-8", "surrogatepass").translate(SEPARATED)
    return regex.sub(rb" {2,}", b" ", data).strip(b" ")


def spans(words: bytes, n: int):
    """Matches of all runs of ``n`` words, one for each first word."""
    import regex

    more = rb"(?: [^ ]++){%d}" % (n - 1) if n > 1 else b""
    return regex.finditer(rb"(?<![^ ])[^ ]++" + more + rb"(?![^ ])", words, overlapped=True)


def feature_table(docs: DataFrame, orders: tuple[int, ...] = (1,), buckets: int = BUCKETS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_words, n_features, and the distinct ``buckets``
    of its features with their ``counts``."""
    ship_package(docs.sparkSession)

    def run(batches):
        import zlib

        import numpy as np

        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = collapsed(text) if text else b""
                found = [zlib.crc32(m[0]) % buckets for n in orders for m in spans(words, n)]
                at, times = np.unique(np.array(found, np.int64), return_counts=True)
                out.append((words.count(b" ") + 1 if words else 0, len(found), at, times))
            yield pdf[["doc_id", "no_id", "h"]].assign(
                n_words=[x[0] for x in out], n_features=[x[1] for x in out],
                buckets=[x[2] for x in out], counts=[x[3] for x in out])

    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    return with_nulls(rows.mapInPandas(
        run, "doc_id long, no_id boolean, h long, n_words long, n_features long, "
             "buckets array<int>, counts array<long>"))


def bucket_totals(features: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket over all rows (one number per bucket comes to the driver)."""
    out = [0] * buckets
    each = features.select(F.explode_outer(F.arrays_zip("buckets", "counts")).alias("f"))
    for r in (each.where("f IS NOT NULL").groupBy("f.buckets")
              .agg(F.sum("f.counts").alias("n")).collect()):
        out[r.buckets] = r.n
    return out


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(smoothed target share / smoothed source share)) of each bucket."""
    n = len(source)
    all_s, all_t = float(sum(source) + n), float(sum(target) + n)
    return [math.floor(1000 * math.log(((t + 1.0) * all_s) / ((s + 1.0) * all_t)))
            for s, t in zip(source, target, strict=True)]


def noise(seed: int, id_col: str = "doc_id") -> Column:
    """floor(1000 x) of standard Gumbel noise x, keyed by seed and id (null: no digits)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT,
                      orders: tuple[int, ...] = (1,), buckets: int = BUCKETS, seed: int = SEED,
                      min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                      target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, h, n_features, weight, score, rank (1 for the highest
    score; null if not drawn).

    Of the N rows with at least ``min_words`` words, floor(percent N / 100) are drawn: highest
    scores first, ties to the smaller id, null ids last, then by a hash of the text. Null and
    empty texts have no features and weight 0. Repeated rows are rows like others. Without any
    target text the target is uniform over the buckets. Other columns are ignored; an empty
    table gives an empty result.
    """
    feats = stored(feature_table(docs, orders, buckets, id_col, text_col))
    aims = feature_table(target.withColumn("_no", F.lit(0)), orders, buckets, "_no", target_col)
    gains = bucket_gains(bucket_totals(feats, buckets), bucket_totals(aims, buckets))

    @F.pandas_udf("long")
    def weight(at, counts, n):
        import numpy as np
        import pandas as pd

        of = np.array(gains, np.int64)
        # integer division goes down, also below zero
        return pd.Series([int(of[a] @ c) // k if k else 0
                          for a, c, k in zip(at, counts, n, strict=True)], dtype="int64")

    scored = (feats.withColumn("weight", weight("buckets", "counts", "n_features"))
              .withColumn("score", F.col("weight") + noise(seed))
              .select("doc_id", "h", "n_words", "n_features", "weight", "score"))
    enough = F.col("n_words") >= min_words
    drawn = percent * feats.where(enough).count() // 100
    ranked = global_rank(scored.where(enough),
                         [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("h")])
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", place).unionByName(rest).drop("n_words")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns; of rows repeated in full, as many as were drawn."""
    scores = importance_scores(docs, target, id_col=id_col, text_col=text_col, **how)
    # copies of one row differ in their rank only: the j-th row is drawn if j of them are
    drawn = (scores.where("rank IS NOT NULL").groupBy("doc_id", "h")
             .agg(F.count("*").alias("times")).alias("g"))
    rows = docs.withColumn("_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("d")
    met = rows.join(drawn, F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc_id"))
                    & (F.col("d._h") == F.col("g.h")))
    copies = met.groupBy(*[F.col(f"d.{c}") for c in docs.columns], "g.times").count()
    return copies.select(*docs.columns, F.explode(F.sequence(
        F.lit(1), F.least("times", "count"))).alias("_copy")).drop("_copy")


OP11_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
         CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
words AS (
  SELECT 'd' AS side, doc_id, x FROM (SELECT doc_id, text FROM documents) d,
    LATERAL (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x)
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT side, doc_id, unnest(x) AS w FROM words),
vocab AS (SELECT DISTINCT w, hex(encode(w)) AS hx FROM each),
bytes AS (
  SELECT w, list_transform(range(1, len(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT) AS b
  FROM vocab),
bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, v:
            xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS k
  FROM bytes, crc),
counts AS (
  SELECT i AS k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM range(10000) r(i) LEFT JOIN (SELECT * FROM each JOIN bucketed USING (w)) e ON e.k = i GROUP BY i),
gains AS (
  SELECT k, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
            / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM counts),
sums AS (
  SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g
  FROM each JOIN bucketed USING (w) JOIN gains USING (k) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
              / 4294967296))) AS BIGINT) AS noise
  FROM documents d LEFT JOIN sums USING (doc_id)),
ranked AS (
  SELECT *, weight + noise AS score, row_number() OVER (
    PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
       CAST(score AS BIGINT) AS score,
       CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN CAST(r AS BIGINT) END AS rank
FROM ranked
"""


@register("op11_importance_resampling", OP11_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored towards the texts of ``benchmark``; a tenth of those with 20 words drawn."""
    return importance_scores(table(spark, sf_dir, "documents"),
                             table(spark, sf_dir, "benchmark")).drop("h")
