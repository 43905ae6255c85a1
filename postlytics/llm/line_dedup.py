"""Operator 4, line dedup by content-defined chunks. DataFrame functions only.

Lines with anything but white space have a 64-bit hash. Those whose hash is divisible by
``divisor`` are boundaries, so a boundary depends on one line and comes back with it wherever
a passage is moved. A chunk reaches from a boundary to the next one, both included; its hash
rolls over its lines' hashes. Neighbouring chunks share a line, so that the repeated chunks
of a passage join up, and a match ends where the lines differ.

With the default of 1 every line is a boundary and every two neighbouring lines are a chunk:
passages of two lines and blocks of one repeated line are found as well. (With fewer
boundaries there are fewer chunks, but a passage loses the lines outside its whole chunks.)

A chunk that occurs again anywhere is removed, but for its first occurrence (smallest
document, then place): all lines that a later occurrence covers, with the blank ones
between them.

Candidates are found by chunk hashes alone (no text is shuffled for that); then the
texts of the candidate chunks meet by hash, and only groups whose bytes are all equal
(least and greatest text of the group are the same) are acted on. Chunks that very many
places share are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table

DIVISOR = 1
SALTS = 16
HOT_CHUNKS = 500    # at most so many chunks are salted, those with the largest shares of all places


def chunk_ends(hashes: Column, divisor: int) -> Column:
    """Places of the boundaries among the lines that aren't blank."""
    places = F.sequence(F.lit(0), F.size(hashes) - 1)
    every = F.when(F.size(hashes) > 0, places).otherwise(F.array().cast("array<int>"))
    return every if divisor == 1 else F.filter(every, lambda i: F.pmod(F.get(hashes, i), F.lit(divisor)) == 0)


def _chunked(docs: DataFrame, divisor: int) -> DataFrame:
    """Rows (id, h, full, hashes, ends) of (id, h, text); ``full`` holds (i, line) of the lines that
    aren't blank."""
    # each column is used more than once by the next step, which keeps the optimizer from
    # pasting them into the lambdas
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return (docs.withColumn("full", F.filter(numbered, lambda s: s.line.rlike(r"[^\x20\x09-\x0D]")))
            .withColumn("hashes", F.transform("full", lambda s: F.xxhash64(s.line)))
            .withColumn("ends", chunk_ends(F.col("hashes"), divisor)))


def _chunks(rows: DataFrame, *extra: str, texts: bool = False) -> DataFrame:
    """One row per chunk: id, h, start, stop (lines), n (lines that aren't blank), chash and,
    if asked for, its text."""
    full, ends = F.col("full"), F.col("ends")

    def one(e, k):
        n = F.get(ends, k + 1) - e + 1
        lines = F.transform(F.slice(full, e + 1, n), lambda s: s.line)
        made = [F.get(full, e).i.alias("start"), F.get(full, e + n - 1).i.alias("stop"), n.alias("n"),
                F.xxhash64(F.slice("hashes", e + 1, n)).alias("chash")]
        return F.struct(*made, *([F.array_join(lines, "\n").alias("chunk")] if texts else []))
    firsts = F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))
    found = rows.select("id", "h", *extra, F.transform(firsts, one).alias("made"))
    # explode() would have its inferred size filter evaluate the chunks below the scan once more
    return (found.select("id", "h", *extra, F.explode_outer("made").alias("c")).filter("c IS NOT NULL")
            .select("id", "h", *extra, "c.*"))


def _with(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``more`` on (id, h), null ids included; by a merge join at every size."""
    a, b = rows.alias("a"), more.hint("merge").alias("b")
    rest = [F.col(f"b.{c}") for c in more.columns if c not in ("id", "h")]
    return a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h")),
                  how).select("a.*", *rest)


def _of_chunk(places: DataFrame, chunks: DataFrame, hot: DataFrame) -> DataFrame:
    """``places`` joined with ``chunks`` (one row each) on (chash, n); rows of ``hot`` chunks, at most
    HOT_CHUNKS of them, meet under salts."""
    mark = F.broadcast(hot.select("chash", "n", F.lit(True).alias("hot")))
    salt = F.pmod(F.xxhash64("id", "h", "start"), F.lit(SALTS)).cast("int")
    left = places.join(mark, ["chash", "n"], "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = chunks.join(mark, ["chash", "n"], "left").withColumn("salt", F.explode(salts))
    return left.drop("hot").join(right.drop("hot"), ["chash", "n", "salt"]).drop("salt")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                divisor: int = DIVISOR) -> DataFrame:
    """Per row: ``id_col``, ``n_lines``, ``n_removed`` (lines) and ``kept`` (the text without
    repeated multi-line chunks).

    Null counts as the empty text, which is one empty line. The first occurrence is that of
    the smallest id (null ids come last; several texts of one id by a hash of the text).
    Rows repeated in full count as one and share the verdict. Other columns are ignored; an
    empty table gives an empty result. Two different chunks of equal hash are both kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "start")
    found = stored(_chunks(_chunked(rows, divisor)).distinct())
    repeated = stored(found.groupBy("chash", "n").agg(F.count("*").alias("times")).filter("times > 1"))
    total = repeated.agg(F.sum("times")).first()[0] or 0
    hot = repeated.filter(F.col("times") * HOT_CHUNKS > total)
    suspects = stored(_of_chunk(found, repeated, hot).drop("times"))
    # the byte comparison: texts of suspects only
    of_doc = suspects.groupBy("id", "h").agg(F.collect_set("start").alias("starts"))
    again = _chunks(_chunked(_with(rows, of_doc, "inner"), divisor), "starts", texts=True)
    verified = stored(
        again.filter(F.array_contains("starts", F.col("start")))
        .groupBy("chash", "n")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"), F.min(place).alias("first"))
        .filter("least = most").drop("least", "most"))
    removed = (_of_chunk(suspects, verified, hot).filter(place != F.col("first"))
               .groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")))
    gone = F.array_distinct(F.flatten(F.transform("cuts", lambda c: F.sequence(c.start, c.stop))))
    joined = (_with(rows, removed, "left")
              .withColumn("lines", F.split("text", "\n", -1))
              .withColumn("gone", F.coalesce(gone, F.array().cast("array<int>"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        F.col("id").alias(id_col), F.size("lines").alias("n_lines"), F.size("gone").alias("n_removed"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(kept).alias("kept"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
p AS (
  SELECT doc_id, i, line, lead(line) OVER w AS line2, lead(i) OVER w AS j FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i, j, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, i) AS turn
  FROM p WHERE j IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM r WHERE turn > 1)
SELECT l.doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(g.i) AS INT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""


@register("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without multi-line chunks that occurred before."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
