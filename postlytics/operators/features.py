"""Feature extraction (D1-D4, D8, C14) in long form: ``(id, term, weight)``.

The long form is what scales and what SQL can check: a term table instead of
a matrix, document frequencies by ``groupBy(term)``, the L2 norm by a window
over the rows of one document. The idf table is vocabulary-sized and joined;
a bounded number of its commonest terms is broadcast. Where weights are
computed, texts are dealt by id once and the rows of their terms stay there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlytics.functions import text as tx
from postlytics.session import cut_lineage


def term_counts(df: DataFrame, id_col: str = "post_id", text_col: str = "text") -> DataFrame:
    """``(id, term, tf)``: tokens of 2+ word characters, lower-cased."""
    return (df.select(id_col, F.explode_outer(tx.word_tokens(text_col)).alias("term"))
              .where(F.col("term").isNotNull())
              .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


TEXT_BYTES = 8 << 20  # text aimed at in a partition; its terms take some 20 times that in memory


def dealt_counts(df: DataFrame, id_col: str = "post_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """:func:`term_counts` with all rows of an id in one of so many partitions, and their number.
    Texts are shuffled, a third of the size of their terms; what follows by id needs no shuffle.
    Nothing is stored: the terms are ten times the texts, and a checkpoint forgets the partitions."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = -(-size // TEXT_BYTES) or 1
    return term_counts(df.select(id_col, text_col).repartition(parts, id_col), id_col, text_col), parts


@dataclass
class TfidfModel:
    """A fitted TF-IDF vocabulary: ``idf(term, df, idf)``, stored, and the corpus size."""
    idf: DataFrame
    n_docs: int
    id_col: str = "post_id"
    text_col: str = "text"

    def transform(self, df: DataFrame) -> DataFrame:
        """Weights for (unseen) text; terms outside the vocabulary are ignored."""
        counts, parts = dealt_counts(df, self.id_col, self.text_col)
        return _l2_normalise(join_terms(counts, self.idf, dealt=(parts, self.id_col)), self.id_col)


HOT_TERMS = 1 << 17  # the commonest terms, which every task of a join with a term table holds


def join_terms(rows: DataFrame, terms: DataFrame, term_col: str = "term",
               count_col: str = "df", dealt: tuple | None = None) -> DataFrame:
    """Inner join of rows with a table of one row per term (and its number of rows). Terms follow
    Zipf's law: at most ``HOT_TERMS`` of the commonest ones are broadcast, so that their rows stay
    where they are; only the rows of rarer terms are shuffled, and dealt back if ``rows`` are
    ``dealt`` to a number of partitions by a column. Both frames are read more than once;
    ``terms`` should be a stored one."""
    hot = F.broadcast(terms.where(F.col(count_col) >= _hot_count(terms, count_col)))
    rare = rows.join(hot.select(term_col), term_col, "left_anti").join(terms, term_col)
    if dealt is not None:
        rare = rare.repartition(*dealt)
    return rows.join(hot, term_col).unionByName(rare).drop(count_col)


def _hot_count(terms: DataFrame, count_col: str) -> int:
    """The least count that at most ``HOT_TERMS`` terms reach. One row per different count comes
    to the driver: no more than the root of twice the number of rows counted."""
    least, upto = 1 << 62, 0
    for r in sorted(terms.groupBy(F.col(count_col).alias("c")).count().collect(), key=lambda r: -r["c"]):
        upto += r["count"]
        if upto > HOT_TERMS:
            break
        least = r["c"]
    return least


def _smoothed(n: int):
    """ln((1 + n) / (1 + df)) + 1 of the column df."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0


def _idf(counts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) of (id, term) rows of ``n`` documents."""
    return (counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .select("term", "df", _smoothed(n).alias("idf")))


def _l2_normalise(weighted: DataFrame, id_col: str) -> DataFrame:
    """The window deals rows by id once; a norm of its own would take two more shuffles."""
    raw = weighted.select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return (raw.withColumn("_norm", norm)
            .select(id_col, "term", F.when(F.col("_norm") == 0, F.lit(0.0))
                    .otherwise(F.col("w") / F.col("_norm")).alias("tfidf")))


def fit_tfidf(df: DataFrame, id_col: str = "post_id", text_col: str = "text") -> TfidfModel:
    """D3 fit: smoothed idf ``ln((1 + n) / (1 + df)) + 1`` over the documents of ``df``."""
    n = df.count()
    counts, _ = dealt_counts(df, id_col, text_col)
    return TfidfModel(cut_lineage(_idf(counts, n)), n, id_col, text_col)


def tfidf(df: DataFrame, id_col: str = "post_id", text_col: str = "text"):
    """D3: fit on ``df`` and transform it; returns ``(weights, model)``.

    Texts are dealt and tokenized once for the fit, and once more for each branch of the join.
    """
    n = df.count()
    counts, parts = dealt_counts(df, id_col, text_col)
    model = TfidfModel(cut_lineage(_idf(counts, n)), n, id_col, text_col)
    return _l2_normalise(join_terms(counts, model.idf, dealt=(parts, id_col)), id_col), model


def extract_features(df: DataFrame, method: str = "tfidf", id_col: str = "post_id",
                     text_col: str = "text", embedder=None):
    """Dispatch to count / tfidf / embedding; returns ``(features, model)``."""
    if method == "count":
        return term_counts(df, id_col, text_col), None
    if method == "tfidf":
        return tfidf(df, id_col, text_col)
    if method == "embedding":
        from postlytics.operators.embed import HashedNgramEmbedder, embed_column
        emb = embedder or HashedNgramEmbedder()
        return embed_column(df, text_col, emb, keep=[id_col]), emb
    raise ValueError(f"method {method!r}: use 'count', 'tfidf' or 'embedding'")


@dataclass
class TermVectors:
    """D1 (ML form): ``terms(term, idx, idf)``, a stored table of ``size`` rows. Vectors
    are put together in the executors; neither table nor vocabulary comes to the driver."""
    terms: DataFrame
    size: int

    def weights(self, df: DataFrame, id_col: str = "post_id", text_col: str = "text") -> DataFrame:
        """``(id, indices, values)``: L2-normalised weights of the texts that have known terms."""
        counts, parts = dealt_counts(df, id_col, text_col)
        pair = F.struct("idx", (F.col("tf") * F.col("idf")).alias("w"))
        of_row = (join_terms(counts, self.terms, dealt=(parts, id_col)).select(id_col, pair.alias("p"))
                  .groupBy(id_col).agg(F.sort_array(F.collect_list("p")).alias("p"))
                  .withColumn("n", F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x.w * x.w))))
        return of_row.select(id_col, F.transform("p", lambda x: x.idx).alias("indices"), F.zip_with(
            F.transform("p", lambda x: x.w), F.array_repeat("n", F.size("p")), lambda w, n: w / n).alias("values"))

    def transform(self, df: DataFrame, id_col: str = "post_id", text_col: str = "text",
                  features_col: str = "features") -> DataFrame:
        """``df`` with its sparse vectors, written once to the shared folder (training reads them
        many times). ``id_col`` identifies a row; texts without known terms get the zero vector."""
        none = F.array()
        vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(self.size).alias("size"),
                          F.coalesce("indices", none.cast("array<int>")).alias("indices"),
                          F.coalesce("values", none.cast("array<double>")).alias("values"))
        met = df.join(self.weights(df, id_col, text_col), id_col, "left")
        return as_vectors(met.withColumn(features_col, vector).drop("indices", "values"), features_col)


def as_vectors(df: DataFrame, col: str) -> DataFrame:
    """``df`` stored with ``col``, a struct (type, size, indices, values), read back as ML vectors:
    Parquet holds them in just this form, so no Python function is needed."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    from postlytics.sources.io import scratch_path
    path = scratch_path(df.sparkSession, "vectors")
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == col else f.dataType)
                           for f in df.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path)


def fit_term_vectors(df: DataFrame, id_col: str = "post_id", text_col: str = "text",
                     use_idf: bool = True) -> TermVectors:
    """Index of all terms of ``df`` in code-point order, with the smoothed IDF of :func:`tfidf`
    (or 1): a range-partitioned sort gives every term its place."""
    from postlytics.operators.encode import global_rank
    n = df.count()
    dealt, _ = dealt_counts(df, id_col, text_col)
    counts = dealt.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = global_rank(counts, [F.col("term")], "idx")
    idf = _smoothed(n) if use_idf else F.lit(1.0)
    terms = ranked.select("term", F.col("idx").cast("int").alias("idx"), idf.alias("idf"),
                          "df")
    return TermVectors(terms, max(ranked.count(), 1))


# --- D8 ----------------------------------------------------------------------

def column_stats(df: DataFrame, vec_col: str):
    """Per-dimension mean and population std of an array column (one pass).

    The result has one row per dimension, so it is collected: its size is
    bounded by the vector length, not by the data.
    """
    stats = (df.select(F.posexplode_outer(vec_col).alias("dim", "x"))
               .where(F.col("dim").isNotNull())
               .groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
               .collect())
    stats = sorted(stats, key=lambda r: r["dim"])
    return [float(r["mean"]) for r in stats], [float(r["std"]) for r in stats]


def standardize(df: DataFrame, vec_col: str, out_col: str | None = None) -> DataFrame:
    """Zero mean, unit population std per dimension; constant dimension -> 0.

    One aggregation pass for the statistics, then a map-only expression:
    no shuffle of the vectors themselves.
    """
    means, stds = column_stats(df, vec_col)
    m = F.array(*[F.lit(v) for v in means])
    s = F.array(*[F.lit(v) for v in stds])
    z = F.transform(F.col(vec_col), lambda x, i: F.when(F.element_at(s, i + 1) == 0, F.lit(0.0))
                    .otherwise((x - F.element_at(m, i + 1)) / F.element_at(s, i + 1)))
    return df.withColumn(out_col or vec_col, z)


# --- C14 ---------------------------------------------------------------------
VADER_ALPHA = 15.0  # fixed value: compound = s / sqrt(s^2 + alpha)


def fit_lexicon(df: DataFrame, label_col: str = "label", id_col: str = "post_id",
                text_col: str = "text") -> DataFrame:
    """C14 lexicon from labelled posts: ``valence(token) = mean(label - 1)``
    over the posts that contain the token (each post counted once), and their number ``posts``."""
    toks = (df.select(id_col, label_col,
                      F.explode_outer(tx.preprocess_tokens(text_col)).alias("token"))
              .where(F.col("token").isNotNull()).distinct())
    return toks.groupBy("token").agg(F.avg(F.col(label_col) - 1.0).alias("valence"),
                                     F.count(F.lit(1)).alias("posts"))


def lexicon_scores(df: DataFrame, lexicon: DataFrame, id_col: str = "post_id",
                   text_col: str = "text") -> DataFrame:
    """C14: per post ``s = sum of valences`` (repeats count), ``compound =
    s / sqrt(s^2 + 15)``; posts without a lexicon token score 0.

    A lexicon with the column ``posts`` (as of :func:`fit_lexicon`) is joined like any table of
    terms; others (a given word list) plainly."""
    toks = (df.select(id_col, F.explode_outer(tx.preprocess_tokens(text_col)).alias("token"))
            .where(F.col("token").isNotNull()).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf")))
    if "posts" in lexicon.columns:
        met = join_terms(cut_lineage(toks), cut_lineage(lexicon), "token", "posts")
    else:
        met = toks.join(lexicon, "token")
    s = met.groupBy(id_col).agg(F.sum(F.col("tf") * F.col("valence")).alias("s"))
    out = df.select(id_col).join(s, id_col, "left").fillna(0.0, ["s"])
    return out.select(id_col, F.col("s").alias("sum_valence"),
                      (F.col("s") / F.sqrt(F.col("s") * F.col("s") + VADER_ALPHA)).alias("compound"))
