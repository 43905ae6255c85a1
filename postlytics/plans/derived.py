"""Frames derived from the given tables, each with its SQL twin.

The given tables hold invented prose, not social posts, so the inputs the
operators expect are derived here, once, in Spark and (identically) in SQL
for the DuckDB oracle:

* ``posts``: labelled documents; ``label = quality + toxic`` (0/1/2) and a
  ``split`` from the md5 of the id (80 % train, 10 % validation, 10 % test).
* ``texts``: every document as ``(post_id, text)``, labelled or not.
* ``tags``: all documents with their derived hashtags: ``'#' +
  lower(word)`` for ASCII words of 12+ letters, in text order.
* ``predictions``: a model-output text per labelled post (right, wrong or
  unparseable by an md5 rule) and its parsed label.
* ``scores``: a compound score in [-1, 1] per event.
* ``run_metrics``: a metric history per user, logged twice (as the
  reference's run logs are).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions import text as tx
from postlytics.sources.io import read_table

# --- fixed values of the derivation ----------------------------------------
SPLIT_BUCKETS = "< 8 train, = 8 validation, else test"
OUTPUT_MARKER = " Sentiment: x\nSentiment: "
UNSURE_TEXT = "I cannot tell"
MIXED_TEXT = "not positive, rather negative"
SCORE_CENTER = 50.0
# ---------------------------------------------------------------------------


def md5_bucket(col, start: int = 1, mod: int = 10):
    """``int(md5(str(col))[start-1:start+7], 16) % mod``."""
    h = F.md5(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long") % mod


def posts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    labels = read_table(spark, sf, "labels")
    b = md5_bucket("doc_id")
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("post_id"), "text",
                    (F.col("quality") + F.col("toxic")).cast("int").alias("label"),
                    F.when(b < 8, "train").when(b == 8, "validation")
                     .otherwise("test").alias("split")))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("post_id"), tx.long_word_tags("text").alias("tags"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "text")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    names = F.array(*[F.lit(n) for n in tx.LABEL_NAMES])
    b = md5_bucket("post_id", start=9)
    answer = (F.when(b == 0, F.lit(UNSURE_TEXT))
              .when(b == 1, F.lit(MIXED_TEXT))
              .when(b <= 3, F.element_at(names, ((F.col("label") + 1) % 3 + 1).cast("int")))
              .otherwise(F.element_at(names, (F.col("label") + 1).cast("int"))))
    raw = F.concat(F.lit(OUTPUT_MARKER), answer, F.lit(" \n"))
    return p.select("post_id", "split", F.col("label").alias("y_true"), raw.alias("raw")) \
            .withColumn("y_pred", tx.parse_generation("raw"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0),
                          (F.col("value") - SCORE_CENTER) / SCORE_CENTER))
    return ev.select("event_id", compound.alias("compound"))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    metric = F.when(F.col("event_type").isin("click", "view", "purchase"),
                    F.concat(F.lit("eval_"), F.col("event_type"))) \
              .otherwise(F.concat(F.lit("train_"), F.col("event_type")))
    once = ev.select(F.lit("events").alias("experiment"),
                     F.col("user_id").cast("string").alias("run_id"),
                     metric.alias("metric"), "ts", "value",
                     F.floor(F.col("event_id") / 100).cast("long").alias("step"))
    twice = once.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    return once.unionByName(twice)


# --- SQL twins (DuckDB) ------------------------------------------------------
WS = (r"\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def sql_md5_bucket(expr: str, start: int = 1, mod: int = 10) -> str:
    return f"(('0x' || substr(md5(CAST({expr} AS VARCHAR)), {start}, 8))::BIGINT % {mod})"


SQL_LABEL_NAME = "(['Negative','Neutral','Positive'])[{x} + 1]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_output_to_label(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN contains(lower({x}), 'positive') THEN 2 "
            f"WHEN contains(lower({x}), 'negative') THEN 0 "
            f"WHEN contains(lower({x}), 'neutral') THEN 1 ELSE 3 END)")


def sql_parse_generation(x: str) -> str:
    return sql_output_to_label(f"(string_split({sql_strip(x)}, 'Sentiment: '))[-1]")


SQL_CTES = {
    "posts": f"""posts AS (
  SELECT d.doc_id AS post_id, d.text AS text, CAST(l.quality + l.toxic AS INTEGER) AS label,
         CASE WHEN {sql_md5_bucket('d.doc_id')} < 8 THEN 'train'
              WHEN {sql_md5_bucket('d.doc_id')} = 8 THEN 'validation' ELSE 'test' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "tags": r"""tags AS (
  SELECT doc_id AS post_id,
         list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'),
                                    lambda w: regexp_full_match(w, '[A-Za-z]{12,}')),
                        lambda w: '#' || lower(w)) AS tags
  FROM documents)""",
    "texts": "texts AS (SELECT doc_id AS post_id, text FROM documents)",
    "predictions": """predictions AS (
  SELECT post_id, split, y_true, raw, {parse} AS y_pred FROM (
    SELECT post_id, split, label AS y_true,
           ' Sentiment: x' || chr(10) || 'Sentiment: ' ||
           CASE WHEN {b2} = 0 THEN 'I cannot tell'
                WHEN {b2} = 1 THEN 'not positive, rather negative'
                WHEN {b2} <= 3 THEN {wrong}
                ELSE {right} END || ' ' || chr(10) AS raw
    FROM posts))""".format(parse=sql_parse_generation("raw"),
                            b2=sql_md5_bucket("post_id", 9),
                            wrong=SQL_LABEL_NAME.format(x="((label + 1) % 3)"),
                            right=SQL_LABEL_NAME.format(x="label")),
    "scores": """scores AS (
  SELECT event_id, greatest(-1.0, least(1.0, (value - 50.0) / 50.0)) AS compound FROM events)""",
    "run_metrics": """run_metrics AS (
  SELECT * FROM (
    SELECT 'events' AS experiment, CAST(user_id AS VARCHAR) AS run_id,
           CASE WHEN event_type IN ('click','view','purchase') THEN 'eval_' || event_type
                ELSE 'train_' || event_type END AS metric,
           ts, value, CAST(floor(event_id / 100) AS BIGINT) AS step FROM events)
  UNION ALL
  SELECT experiment, run_id, metric, ts + INTERVAL 1 SECOND, value, step FROM (
    SELECT 'events' AS experiment, CAST(user_id AS VARCHAR) AS run_id,
           CASE WHEN event_type IN ('click','view','purchase') THEN 'eval_' || event_type
                ELSE 'train_' || event_type END AS metric,
           ts, value, CAST(floor(event_id / 100) AS BIGINT) AS step FROM events))""",
}

_CTE_DEPS = {"predictions": ["posts"]}


def with_ctes(names, body: str, extra=(), recursive: bool = False) -> str:
    """``WITH [RECURSIVE] <derived ctes in dependency order>, <extra ctes> <body>``."""
    order: list[str] = []

    def add(n):
        for d in _CTE_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [SQL_CTES[n] for n in order] + list(extra)
    if not parts:
        return body
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" + body
