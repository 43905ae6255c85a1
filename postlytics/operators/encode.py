"""Training-data preparation (D10-D13): word-level encoding, masks, packing,
length grouping.

The vocabulary is built by Spark (``groupBy(token).count()``, whole unless
a size is asked for); ids are global ranks from a range-partitioned sort.
A vocabulary whose size is checked to be small is broadcast as a dictionary
and applied to the token arrays in place; of a larger one the most frequent
tokens are, and only the rest of each row's tokens is joined to it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlytics.session import cut_lineage
from postlytics.sources.io import stored

# --- fixed values: special token ids ---------------------------------------
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
IGNORE_INDEX = -100
RESPONSE_TEMPLATE = "### Sentiment:"
PACK_LENGTH = 2048
REST_ID = -1                 # a token that isn't in the dictionary, while ids are looked up
DICTIONARY_BYTES = 64 << 20  # as much of a vocabulary is held by every worker
# Prompt tokenizer: runs of word characters, or one other non-space character.
PROMPT_TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# ---------------------------------------------------------------------------


def prompt_tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(PROMPT_TOKEN_PATTERN), 0)


def global_rank(df: DataFrame, order: list, out_col: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in the given order (which must be
    total): a range-partitioned sort, written once, plus the sizes of the
    partitions before; no single task sees all rows."""
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("p")).count().collect()  # one row per partition
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        starts += [F.lit(r["p"]), F.lit(at)]
        at += r["count"]
    if not starts:
        return ranged.withColumn(out_col, F.lit(0).cast("long")).drop("_m")
    base = F.element_at(F.create_map(*starts), part)
    return (ranged.withColumn(out_col, (base + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long"))
            .drop("_m"))


def build_vocab(tokens_df: DataFrame, tokens_col: str, size: int | None = None) -> DataFrame:
    """``(token, id)`` of all tokens, or of the ``size`` most frequent ones (ties by token)."""
    counts = (tokens_df.select(F.explode_outer(tokens_col).alias("token"))
              .where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = global_rank(counts, [F.col("n").desc(), F.col("token")])
    if size is not None:
        ranked = ranked.where(F.col("rank") < size)
    return ranked.select("token", (F.col("rank") + FIRST_WORD_ID).cast("int").alias("id"))


def token_ids(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame,
              out_col: str = "ids", dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Map each row's tokens to ids (unknown -> UNK), order kept.

    A vocabulary of at most ``dictionary_bytes`` (its tokens, and 100 bytes for each) goes to the
    workers as a dictionary, and rows are mapped in place: no shuffle. Of a larger one, the most
    frequent tokens do, and the others are joined."""
    size, n = vocab.agg(F.sum(F.octet_length("token") + 100), F.count(F.lit(1))).first()
    if (size or 0) <= dictionary_bytes:
        return _ids_by_dictionary(df, tokens_col, vocab, out_col)
    # ids are frequency ranks: the most frequent tokens are the first ones
    held = vocab.where(F.col("id") < FIRST_WORD_ID + n * dictionary_bytes // size)
    return _ids_by_join(df, id_col, tokens_col, vocab, held, out_col)


def _ids_by_dictionary(df: DataFrame, tokens_col: str, vocab: DataFrame, out_col: str,
                       other: int = UNK_ID) -> DataFrame:
    rows = vocab.select("token", "id").toPandas()
    known = df.sparkSession.sparkContext.broadcast(dict(zip(rows["token"], rows["id"].tolist(), strict=True)))

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        get = known.value.get
        return pd.Series([[] if tokens is None else [get(t, other) for t in tokens] for tokens in lists])

    return df.withColumn(out_col, run(tokens_col))


def _ids_by_join(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, held: DataFrame,
                 out_col: str) -> DataFrame:
    """Ids from a dictionary of the tokens of ``held``, written once; only the other tokens, by
    Zipf's law a small part of a text, are joined with the vocabulary, once per row, and put
    into their places. Rows of the same id and tokens share them."""
    rest = F.array_distinct(F.filter(F.zip_with(tokens_col, "_ids", lambda t, i: F.when(i == REST_ID, t)),
                                     lambda t: t.isNotNull()))
    # the others are numbered -1, -2, ... within the row: the tokens themselves needn't be shuffled
    ids = F.zip_with(tokens_col, "_ids", lambda t, i: F.when(i != REST_ID, i).otherwise(
        F.coalesce(-F.array_position("_rest", t).cast("int"), F.lit(UNK_ID))))
    part = stored(_ids_by_dictionary(df, tokens_col, held, "_ids", REST_ID).withColumn("_rest", rest)
                  .withColumn("_ids", ids).withColumn("_h", F.xxhash64(tokens_col)))
    rare = part.select(F.col(id_col).alias("_id"), F.col("_h").alias("_hash"), F.explode("_rest").alias("token"))
    found = (rare.distinct().join(vocab.hint("merge"), "token").groupBy("_id", "_hash")
             .agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("_found")))
    met = part.join(found.hint("merge"), part[id_col].eqNullSafe(found["_id"]) & (F.col("_h") == F.col("_hash")), "left")
    ids = F.transform("_ids", lambda i: F.when(i >= 0, i).otherwise(
        F.coalesce(F.try_element_at("_found", F.get("_rest", -i - 1)), F.lit(UNK_ID))))
    empty = F.array().cast("array<int>")
    return met.select(*df.columns, F.coalesce(ids, empty).alias(out_col))


def pad_truncate(ids, max_length: int, special: bool = True):
    """``(input_ids, attention_mask)`` of fixed length: [CLS] ids [SEP], cut, padded."""
    c = F.col(ids) if isinstance(ids, str) else ids
    if special:
        body = F.slice(c, 1, max_length - 2)
        seq = F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)))
    else:
        seq = F.slice(c, 1, max_length)
    n = F.size(seq)
    input_ids = F.concat(seq, F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return input_ids, mask


def encode(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame,
           max_length: int = 128) -> DataFrame:
    """``(id, input_ids, attention_mask)`` padded/truncated to ``max_length``."""
    with_ids = token_ids(df.select(id_col, tokens_col), id_col, tokens_col, vocab)
    input_ids, mask = pad_truncate("ids", max_length)
    return with_ids.select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"))


def completion_only_labels(ids, template_ids) -> Column:
    """labels = ids, with every position up to the end of the **last**
    occurrence of the response template set to -100; template absent -> all -100."""
    c = F.col(ids) if isinstance(ids, str) else ids
    t = F.array(*[F.lit(int(x)) for x in template_ids])
    k = len(template_ids)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(c) - k + 1, F.lit(1))),
                      lambda i: F.slice(c, i, k) == t)
    last = F.array_max(starts)
    n = F.size(c)
    end = F.when(last.isNull(), n).otherwise(F.least(last + k - 1, n))  # masked prefix length
    # no lambda refers to ``end``: it is evaluated once per row
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), end), F.slice(c, end + 1, F.greatest(n - end, F.lit(0))))


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out_col: str = "offset",
               buckets: int = 1024) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_col`` order, computed
    without a single global window: range buckets (from approximate
    quantiles) get their totals summed over a small table, and the running
    sum inside each bucket is a window partitioned by bucket."""
    qs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(order_col, qs, 0.0001))) if buckets > 1 else []
    b = F.lit(0)
    if bounds:
        # bucket = number of bounds <= value
        arr = F.array(*[F.lit(float(x)) for x in bounds])
        v = F.col(order_col).cast("double")
        b = F.size(F.filter(arr, lambda x: x <= v))
    tagged = df.withColumn("_bucket", b)
    totals = tagged.groupBy("_bucket").agg(F.sum(value_col).alias("_tot"))
    wb = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    base = totals.select("_bucket", F.coalesce(F.sum("_tot").over(wb), F.lit(0)).alias("_base"))
    wi = (Window.partitionBy("_bucket").orderBy(order_col)
          .rowsBetween(Window.unboundedPreceding, -1))
    inner = tagged.withColumn("_in", F.coalesce(F.sum(value_col).over(wi), F.lit(0)))
    return (inner.join(F.broadcast(base), "_bucket")
            .withColumn(out_col, (F.col("_base") + F.col("_in")).cast("long"))
            .drop("_bucket", "_base", "_in"))


def pack(df: DataFrame, id_col: str, length_col: str, block: int = PACK_LENGTH,
         eos: bool = True) -> DataFrame:
    """Place examples, in ``id`` order, in a token stream cut into
    ``block``-token blocks (an end token after each example when ``eos``);
    the last incomplete block is dropped.

    Returns one row per (example, block) piece: ``(id, block_id, start,
    n_tokens)``; an example crossing a block border yields two or more pieces.
    """
    ln = (F.col(length_col) + (1 if eos else 0)).cast("long")
    with_len = cut_lineage(df.select(id_col, ln.alias("_len")))  # lengths are computed once
    placed = prefix_sum(with_len, id_col, "_len", "_off")
    total = with_len.agg(F.sum("_len")).first()[0] or 0
    n_blocks = total // block
    first_b = F.floor(F.col("_off") / block)
    last_b = F.floor((F.col("_off") + F.col("_len") - 1) / block)
    pieces = placed.where(F.col("_len") > 0).select(
        id_col, "_off", "_len", F.explode(F.sequence(first_b, last_b)).alias("block_id"))
    start = F.greatest(F.col("_off"), F.col("block_id") * block)
    end = F.least(F.col("_off") + F.col("_len"), (F.col("block_id") + 1) * block)
    return (pieces.where(F.col("block_id") < n_blocks)
            .select(id_col, F.col("block_id").cast("long").alias("block_id"),
                    (start - F.col("block_id") * block).cast("long").alias("start"),
                    (end - start).cast("long").alias("n_tokens")))


def group_by_length(df: DataFrame, id_col: str, length_col: str, batch_size: int) -> DataFrame:
    """Batches of examples of like length: ``batch_id`` is the global
    rank by ``(length, id)`` divided by ``batch_size``, so that only the last
    batch may be short, whatever the number of cores."""
    ranked = global_rank(df, [F.col(length_col), F.col(id_col)], "_rank")
    return (ranked.withColumn("batch_id", F.floor(F.col("_rank") / batch_size).cast("long"))
            .drop("_rank"))
