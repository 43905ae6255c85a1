"""Operator 7, exact dedup by content sort. DataFrame functions only.

Rows are range-partitioned by splitters that Spark samples from the normalised
bytes (the leading bytes and the byte length; equal texts agree in both). Each
partition is sorted externally by its full normalised texts, so that equal texts
lie side by side, and the window over equal texts compares each neighbour in full.
The range partitioning already clusters equal texts, so there is one shuffle.

A text held by very many rows would fill one partition. A cheap count by a
signature (constant on equal texts) names such groups beforehand, and their rows
are sorted under one of ``SALTS`` sub-keys. Only the survivors of these sub-groups
(at most ``SALTS`` for each heavy text) are sorted once more among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlytics.llm.common import fold_az, register, stored, table

PREFIX = 128   # leading characters in the range key; the sort still compares whole texts
SALTS = 64
HEAVY_SHARE = 256   # a signature of over 1/256 of the rows (and HEAVY_ROWS) is salted
HEAVY_ROWS = 1000


def _heavy_signatures(docs: DataFrame, sig: Column) -> list[int]:
    """Signatures that more than 1/HEAVY_SHARE of the rows share: below HEAVY_SHARE values."""
    bar = max(HEAVY_ROWS, docs.count() // HEAVY_SHARE)
    counts = docs.groupBy(sig.alias("sig")).agg(F.count("*").alias("n"))
    return [r.sig for r in counts.filter(F.col("n") > bar).select("sig").collect()]


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep: str = "largest", partitions: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they are.

    The same sort as ``exact_groups``; the columns travel with the text, so there is no join.
    """
    cols = docs.columns
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"),
                       F.struct(*[F.col(c) for c in cols if c != text_col],
                                F.col(text_col).isNull().alias("_none")).alias("rest"))
    heavy, key, ranged = _ranged(rows, partitions)
    best_first = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()

    def first_of(df, *parts):
        w = Window.partitionBy(*parts, "norm").orderBy(best_first)
        return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    kept = first_of(ranged.withColumn("norm", fold_az(F.col("raw"))), *key)
    if heavy:
        kept = stored(kept)
        again = first_of(kept.filter("salt >= 0").repartitionByRange("head", "size", "norm"),
                         "head", "size")
        kept = kept.filter("salt < 0").unionByName(again)
    return kept.select(*[
        F.when(~F.col("rest._none"), F.col("raw")).alias(c) if c == text_col
        else F.col("rest")[c].alias(c) for c in cols])


def _ranged(rows: DataFrame, partitions: int | None):
    """(heavy signatures, range key, rows range-partitioned by it) of rows (id, raw, ...)."""
    head = fold_az(F.substring("raw", 1, PREFIX))
    sig = F.xxhash64(head, F.octet_length("raw"))
    heavy = _heavy_signatures(rows, sig)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    keyed = rows.withColumns({
        "head": head, "size": F.octet_length("raw"),
        "salt": F.when(sig.isin(heavy), salt).otherwise(-1) if heavy else F.lit(-1)})
    # a constant in the key would be folded away and cost the window a second shuffle
    key = ["head", "size", "salt"] if heavy else ["head", "size"]
    ranged = (keyed.repartitionByRange(partitions, *key) if partitions
              else keyed.repartitionByRange(*key))
    return heavy, key, ranged


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "largest", partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` of the text after lower-casing A-Z.

    ``keep`` is "largest" or "smallest" identifier. Null texts count as empty; empty texts
    equal each other. A null id loses to every other id; a group of null ids only keeps
    one of its rows and has a null ``keep_id``. Of rows repeated with the same id just one
    is kept. Other columns are ignored; an empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    heavy, key, ranged = _ranged(rows, partitions)
    best_first = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    best = F.max if keep == "largest" else F.min
    same = Window.partitionBy(*key, "norm")
    out = (ranged.withColumn("norm", fold_az(F.col("raw"))).drop("raw")
           .withColumns({"rn": F.row_number().over(same.orderBy(best_first)),
                         "keep_id": best("id").over(same),
                         "group_size": F.count("*").over(same)})
           .withColumns({"sha": F.sha2("norm", 256)}))
    if not heavy:
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                          (F.col("rn") == 1).alias("kept"), F.col("sha").alias("text_sha256"))
    # first sort done once; the text stays only with the survivor of each salted sub-group
    first = stored(out.select(
        "id", "keep_id", "group_size", "rn", "sha", "salt",
        F.when((F.col("salt") >= 0) & (F.col("rn") == 1), F.col("norm")).alias("norm")))
    light = first.filter("salt < 0").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rn") == 1).alias("kept"),
        F.col("sha").alias("text_sha256"))
    # the second content sort, over the survivors of the salted sub-groups
    again = Window.partitionBy("norm")
    by_id = F.col("keep_id").desc_nulls_last() if keep == "largest" else F.col("keep_id").asc_nulls_last()
    merged = (first.filter(F.col("norm").isNotNull())
              .repartitionByRange(F.col("norm"))
              .select("salt", "sha", F.row_number().over(again.orderBy(by_id, "salt")).alias("rn2"),
                      best("keep_id").over(again).alias("keep2"),
                      F.sum("group_size").over(again).alias("size2")))
    heavy_rows = (first.filter("salt >= 0").drop("norm")
                  .join(merged, ["salt", "sha"])
                  .select(F.col("id").alias(id_col), F.col("keep2").alias("keep_id"),
                          F.col("size2").alias("group_size"),
                          ((F.col("rn") == 1) & (F.col("rn2") == 1)).alias("kept"),
                          F.col("sha").alias("text_sha256")))
    return light.unionByName(heavy_rows)


OP7_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@register("op7_exact_dedup", OP7_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies (A-Z lower-cased) of all documents; the largest doc_id of a group stays."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")
