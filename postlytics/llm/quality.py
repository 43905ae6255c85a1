"""Operator 5, quality scores by Bradley-Terry pairwise ranking.

A pair (better, worse) of labelled documents is won with probability
sigmoid(w . (f(better) - f(worse))); w minimises the logistic loss of these feature
differences. w . f then ranks documents; the threshold is a quantile of the training
scores: the share of worse documents among the labelled ones. The score is a sigmoid
that passes ``CUT`` at that quantile.

The fit uses at most ``TRAIN_ROWS`` labelled documents, drawn by a hash of the id, and
``PAIRS`` pairs. Scoring reads every document once, without a shuffle.
"""

from __future__ import annotations

from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, table

TRAIN_ROWS = 20_000
PAIRS = 60_000
CUT = 0.3
RIDGE = 1e-3
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)   # quantiles where a feature's weight may bend

NAMES = ("log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word",
         "repeats", "upper", "digits", "symbols", "stops", "line_length", "bare_words",
         "title_words")


def features(text: str | None) -> list[float]:
    """Numbers of a whole text that don't depend on its language; all zero without words."""
    from collections import Counter
    from math import log1p

    import numpy as np

    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8),
                        minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    digits, wide = int(count[48:58].sum()), int(count[128:].sum())
    stops = int(count[44] + count[46])
    blank = int(count[9:14].sum() + count[32])
    size = int(count.sum())
    solid = max(size - blank, 1)
    symbols = solid - upper - lower - digits - wide - stops
    length = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    return [log1p(n), float(length.mean()), float((length > 12).mean()),
            float((length <= 3).mean()), len(seen) / n, max(seen.values()) / n,
            sum(map(eq, words, words[1:])) / n, upper / max(upper + lower, 1), digits / solid,
            symbols / solid, stops / n, log1p(size / (1 + int(count[10]))),
            sum(not w.isalpha() for w in seen) / len(seen),
            sum(w.istitle() for w in seen) / len(seen)]


class Ranker:
    """Bradley-Terry weights over piecewise linear features."""

    def __init__(self, x, y, seed: int = 7):
        import numpy as np

        x = np.asarray(x, "float64").reshape(-1, len(NAMES))
        y = np.asarray(y)
        self.w = None
        good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        if not len(good) or not len(bad):
            return   # nothing to compare: every document scores the same
        self.knots = np.quantile(x, KNOTS, axis=0)
        z = self._expand(x)
        self.mean, self.scale = z.mean(0), z.std(0) + 1e-9
        z = (z - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        w = np.zeros(z.shape[1])
        for _ in range(30):   # Newton steps on the logistic loss
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff * p[:, None]).mean(0) + RIDGE * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff)
            step = np.linalg.solve(hess + RIDGE * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        rank = z @ w
        # between the scores on either side of the quantile, so that ties fall together
        at = len(bad) / len(y)
        self.threshold = float(np.quantile(rank, at, method="midpoint"))
        self.unit = float(max(np.abs(rank - self.threshold).mean(), 1e-9))

    def _expand(self, x):
        import numpy as np

        return np.concatenate([x, *(np.maximum(0, x - k) for k in self.knots)], axis=1)

    def score(self, x):
        """0 to 1; ``CUT`` at the threshold."""
        import numpy as np

        x = np.asarray(x, "float64").reshape(-1, len(NAMES))
        if self.w is None:
            return np.full(len(x), 0.5)
        rank = ((self._expand(x) - self.mean) / self.scale) @ self.w
        s = (rank - self.threshold) / self.unit * 3 + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", label_col: str = "quality") -> Ranker:
    """The ranker of the labelled documents that are not held out. Labels other than 0 and 1
    are ignored; a document labelled both ways counts as 0; a label without document is
    skipped; of several rows of one id the one with the least hash of its text counts. Without both labels every document will score 0.5."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()
                           & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).cast("long").alias("doc_id"))
             .agg(F.min(label_col).cast("int").alias("y")))
    every = max(1, -(-known.count() // TRAIN_ROWS))
    # at most about TRAIN_ROWS ids: small enough to send to every task
    chosen = (known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
              .limit(2 * TRAIN_ROWS))

    def measure(batches):
        for pdf in batches:
            yield pdf[["doc_id", "y", "h"]].assign(f=[features(t) for t in pdf["text"]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # one row per id reaches the driver, however often the id recurs
    got = (rows.join(F.broadcast(chosen), "doc_id")
           .select("doc_id", "y", F.xxhash64("text").alias("h"), "text")
           .mapInPandas(measure, "doc_id long, y int, h long, f array<double>")
           .groupBy("doc_id", "y").agg(F.min(F.struct("h", "f")).alias("least"))
           .select("doc_id", "y", F.col("least.f").alias("f"))
           .toPandas().sort_values(["doc_id", "y"], kind="stable"))
    return Ranker([list(f) for f in got["f"]], got["y"].to_numpy())


def score_documents(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least ``CUT``)
    in place of columns of these names. Null and empty texts score as texts without words."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(texts):
        import numpy as np
        import pandas as pd

        return pd.Series(ranker.score([features(t) for t in texts]) if len(texts) else np.zeros(0))

    return (docs.withColumn("score", score(F.col(text_col)))
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))


@register("op5_quality_ranking")
def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels that are not held out.
    SQL has no fit: the tests measure the accuracy on the held-out labels."""
    docs = table(spark, sf_dir, "documents")
    ranker = fit_ranker(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), ranker)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
