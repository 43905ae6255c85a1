"""Hashtag word segmentation (D9) with corpus unigram counts.

``#machinelearning`` -> ``machine learning``: the split that maximises the
sum of log word probabilities, ``P(w) = count(w) / N`` for known words and
``10 / (N * 10 ** len(w))`` for unknown ones (the usual unigram model of
word segmenters), words at most ``max_word`` characters long.

Unigram counts are a ``groupBy(token)``; the candidate substrings of every
*distinct* tag are joined to the counts (an equi-join: the vocabulary never
has to fit in memory), and a tag's dynamic program is a fold over its
positions, all in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.functions import text as tx
from postlytics.session import materialize

# --- fixed values (MAX_WORD: the default of a parameter) --------------------
MAX_WORD = 24
UNKNOWN_SCALE = 10.0
# ---------------------------------------------------------------------------


def unigram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over cleaned, tokenized texts."""
    return (texts.select(F.explode_outer(tx.tokenize(tx.clean_text(text_col))).alias("word"))
            .where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def normalise_tag(col) -> "F.Column":
    """Lower-case and keep letters and digits only (``#`` and ``_`` dropped)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _log_prob(word: Column, known: Column, total: float) -> Column:
    """Log probability of a word; ``known`` maps the known candidates to their counts."""
    n = F.element_at(known, word)
    unknown = F.lit(UNKNOWN_SCALE) / (F.lit(total) * F.pow(F.lit(10.0), F.length(word)))
    return F.when(n.isNotNull(), F.log(n / F.lit(total))).otherwise(F.log(unknown))


def best_ends(norm: Column, known: Column, total: float, max_word: int) -> Column:
    """For every position 0..n of ``norm`` the best split up to there, as (score, -start of its
    last word); equal scores prefer the longer last word."""
    def step(best, j):
        def last_word(i):
            score = F.get(best, i).s + _log_prob(F.substring(norm, i + 1, j - i), known, total)
            return F.struct(score.alias("s"), (-i).alias("b"))
        starts = F.sequence(F.greatest(j - max_word, F.lit(0)), j - 1)
        return F.concat(best, F.array(F.array_max(F.transform(starts, last_word))))
    first = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("b")))
    return F.when(F.length(norm) > 0, F.aggregate(F.sequence(F.lit(1), F.length(norm)), first, step))


def split_words(norm: Column, ends: Column) -> Column:
    """The words of the best split, from the last one back. ``ends`` rides in the state of the
    fold, so that it is worked out once and not in every step."""
    def step(state, _):
        start = -F.get(state.ends, state.at).b
        word = F.substring(norm, start + 1, state.at - start)
        more = F.struct(start.alias("at"), F.concat(F.array(word), state.words).alias("words"),
                        state.ends.alias("ends"))
        return F.when(state.at > 0, more).otherwise(state)
    begin = F.struct(F.length(norm).alias("at"), F.array().cast("array<string>").alias("words"),
                     ends.alias("ends"))
    words = F.aggregate(F.sequence(F.lit(1), F.length(norm)), begin, step, lambda state: state.words)
    return F.when(F.length(norm) > 0, F.array_join(words, " ")).otherwise("")


def segment(elements: DataFrame, col: str, counts: DataFrame, out_col: str = "segmented",
            max_word: int = MAX_WORD) -> DataFrame:
    """Add ``out_col`` (words joined by spaces) to a frame of elements.

    All joins are shuffled ones: counts, candidates and segmented tags grow with the corpus, and
    AQE, which sees compressed sizes, would send them through the driver."""
    counts = materialize(counts)  # read for the total and for the candidates
    total = float(counts.agg(F.sum("n")).first()[0] or 1.0)
    tags = elements.select(F.col(col).alias("_tag")).distinct()
    normed = tags.withColumn("_norm", normalise_tag("_tag"))
    L = F.length("_norm")
    subs = (normed.select("_tag", "_norm", F.explode_outer(F.sequence(F.lit(1), F.greatest(L, F.lit(1))))
                          .alias("_i"))
            .select("_tag", "_norm", "_i", F.explode_outer(F.sequence(
                F.lit(1), F.least(F.lit(max_word), F.greatest(L - F.col("_i") + 1, F.lit(1))))).alias("_k"))
            .select("_tag", F.substring("_norm", F.col("_i"), F.col("_k")).alias("word")))
    pair = F.struct("word", "n")
    known = subs.join(counts.hint("merge"), "word").select("_tag", pair.alias("_p"))
    # a row without a pair for every tag: those without known words stay
    every = known.unionByName(tags.select("_tag", F.lit(None).cast(known.schema["_p"].dataType).alias("_p")))
    cand = (every.groupBy("_tag").agg(F.map_from_entries(F.collect_set("_p")).alias("_known"))
            .withColumn("_norm", normalise_tag("_tag")))
    ends = cand.withColumn("_ends", best_ends(F.col("_norm"), F.col("_known"), total, max_word))
    seg = ends.select("_tag", split_words(F.col("_norm"), F.col("_ends")).alias(out_col))
    return elements.join(seg.hint("merge"), elements[col] == seg["_tag"], "left").drop("_tag")


def segmenter(counts: DataFrame, max_word: int = MAX_WORD):
    """A ``segmenter(df, col, out_col)`` callable for :func:`cluster_elements`; the counts are
    worked out at its first call, for all of them."""
    stored: list[DataFrame] = []

    def run(df: DataFrame, col: str, out: str) -> DataFrame:
        if not stored:
            stored.append(materialize(counts))
        return segment(df, col, stored[0], out, max_word)
    return run


def sql_segmented(max_word: int = MAX_WORD) -> list[str]:
    """The same as DuckDB CTEs: ``seg(tag, segmented)`` over ``dt(tag)`` and ``uni(word, n)``."""
    score = f"""CASE WHEN known[substr(norm, i + 1, j + 1 - i)] IS NOT NULL
                THEN ln(known[substr(norm, i + 1, j + 1 - i)] / total)
                ELSE ln({UNKNOWN_SCALE} / (total * pow(10.0, j + 1 - i))) END"""
    return [
        r"nt AS (SELECT tag, regexp_replace(lower(tag), '[^\p{L}\p{N}]', '', 'g') AS norm FROM dt)",
        f"""sb AS (SELECT DISTINCT tag, substr(norm, i, k) AS word FROM (
              SELECT tag, norm, i, unnest(range(1, least({max_word}, length(norm) - i + 1) + 1)) AS k
              FROM (SELECT tag, norm, unnest(range(1, length(norm) + 1)) AS i FROM nt)))""",
        """kn AS (SELECT tag, map_from_entries(list((word, n))) AS known FROM sb JOIN uni USING (word) GROUP BY tag)""",
        """st AS (SELECT tag, norm, coalesce(known, MAP {}::MAP(VARCHAR, BIGINT)) AS known,
                         (SELECT sum(n) FROM uni)::DOUBLE AS total FROM nt LEFT JOIN kn USING (tag))""",
        f"""dp AS (
              SELECT tag, norm, known, total, 0 AS j, [0.0::DOUBLE] AS s, [0::BIGINT] AS b FROM st
              UNION ALL
              SELECT tag, norm, known, total, j + 1, list_append(s, best.s), list_append(b, best.i) FROM (
                SELECT *, list_reduce(list_transform(range(greatest(j + 1 - {max_word}, 0), j + 1),
                         lambda i: {{'s': s[i + 1] + {score}, 'i': i}}),
                         lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END) AS best
                FROM dp WHERE j < length(norm)))""",
        """bt AS (
              SELECT tag, norm, b, length(norm)::BIGINT AS p, ''::VARCHAR AS said FROM dp WHERE j = length(norm)
              UNION ALL
              SELECT tag, norm, b, b[p + 1], substr(norm, b[p + 1] + 1, p - b[p + 1])
                     || CASE WHEN said = '' THEN '' ELSE ' ' || said END FROM bt WHERE p > 0)""",
        "seg AS (SELECT tag, said AS segmented FROM bt WHERE p = 0)"]
