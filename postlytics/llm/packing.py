"""Operator 10, sum-of-squares packing of documents into sequences.

A piece goes where the sum over all gaps g of (open sequences with g free tokens)^2
becomes smallest: into an open sequence of some gap, or into a new one. Only the 2048
counts matter, so a choice costs one vector operation. Ties prefer the smaller gap.

Pieces are dealt by hash to shards of about ``SHARD`` pieces, packed independently and
in decreasing length; a shard leaves a few sequences part-filled, whatever its size.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table, whole_id, with_nulls
from postlytics.llm.tokens import text_encoder

CAPACITY = 2048
SHARD = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
HELD = PIECES.replace("piece", "no_id boolean, piece")   # as Python gets them


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids (whole text, then ``end_id``; null: empty): one, or
    for more than ``capacity`` ids full ones after a first that may be shorter."""
    def run(batches):
        import numpy as np
        import pandas as pd

        encode, end = text_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc, none, text in zip(pdf["doc_id"], pdf["no_id"], pdf["text"], strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                at, k, size = 0, 0, n if n <= capacity else n % capacity or capacity
                while at < n:
                    out.append((doc, none, k, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, k, size = at + size, k + 1, capacity
            yield pd.DataFrame(out, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"))
    return with_nulls(rows.mapInPandas(run, HELD))


def sum_of_squares(lengths, capacity: int):
    """(bin, offset) of each length, taken in the given order."""
    import numpy as np

    n = len(lengths)
    where, offset = np.empty(n, "int64"), np.empty(n, "int64")
    open_ = np.zeros(capacity + 1, "int64")         # gap -> open bins; a full bin isn't open
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, size in enumerate(map(int, lengths)):
        gaps = open_[size:]                          # gap g = size + index
        # change of the sum: -2 N(g) + 1 for the gap left, 2 N(g - size) + 1 for the gap made
        change = 2 * (open_[:capacity + 1 - size] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]                  # the bin becomes full
        change[gaps == 0] = np.iinfo("int64").max
        rest = capacity - size
        fresh = 2 * open_[rest] + 1 if rest else 0   # a new bin
        best = int(change.argmin())
        if change[best] <= fresh:
            g = size + best
            b = bins[g].pop()
            open_[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        where[i], offset[i] = b, capacity - g
        if g > size:
            bins[g - size].append(b)
            open_[g - size] += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD) -> DataFrame:
    """``pieces`` (columns of ``PIECES``, lengths 1..capacity) with ``sequence_id`` and
    ``offset``. Reads ``pieces`` twice: store it first."""
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(pdf):
        pdf = pdf.sort_values(["length", "no_id", "doc_id", "piece", "ids_crc32"],
                              ascending=[False, True, True, True, True], kind="stable")
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy("int64") << 32) + where,
                          offset=offset).drop(columns="shard")

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long")
    dealt = pieces.select(*whole_id(), *pieces.columns[1:], shard.alias("shard"))
    return with_nulls(dealt.groupBy("shard")
                      .applyInPandas(run, HELD + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents as pieces in sequences of at most ``capacity`` ids.

    Null and empty texts are the end id alone. Null or repeated ids are packed like any
    others; other columns are ignored; an empty table gives an empty result."""
    return pack(stored(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)), capacity)


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids by the sum of squares.
    SQL has no tokenizer: the tests check ids, gapless offsets and the number of sequences."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), 0)
