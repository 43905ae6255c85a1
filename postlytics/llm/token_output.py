"""Operator 2, token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by id, and every partition streams the ids of its
documents into one Arrow IPC file: record batches of fixed-size lists, ``ids``
(the narrowest unsigned type that holds the vocabulary) and ``mask`` (true for a
token, false for the filling at the end of the file). Row i holds tokens
i*length .. (i+1)*length, so a memory-mapped reader finds any token by division
and gets its sequence without a copy. An index (one row per document: file, place
in it, number of tokens) is written as Parquet along with it.

A file is written under a name of its own for each task attempt and moved to its
place when whole; the index names the attempt that counts, so repeated or lost
tasks leave at most an unused file.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, scratch_folder, stored, table, whole_id, with_nulls
from postlytics.llm.tokens import text_encoder

SEQUENCE = 1024   # tokens in a sequence
ROWS = 256        # sequences in a record batch

INDEX = "doc_id long, no_id boolean, file string, shard int, place long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class SequenceWriter:
    """Streams ids into an Arrow IPC file; holds one record batch."""

    def __init__(self, sink, dtype: str, sequence: int, rows: int):
        import pyarrow as pa

        self.sequence, self.rows, self.dtype = sequence, rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)),
                                 ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.place = [], 0, 0

    def add(self, ids) -> int:
        """Appends ids; the place of the first one."""
        at = self.place
        self.held.append(ids)
        self.n_held += len(ids)
        self.place += len(ids)
        if self.n_held >= self.sequence * self.rows:  # whole batches: a reader finds rows by division
            self._flush(self.n_held // (self.sequence * self.rows) * self.rows)
        return at

    def _flush(self, full: int) -> None:
        """Writes ``full`` sequences, the last one filled up if the ids end in it."""
        import numpy as np
        import pyarrow as pa

        ids, step = np.concatenate(self.held), self.sequence * self.rows
        whole, real = full * self.sequence, len(ids)
        if real < whole:
            ids = np.concatenate([ids, np.zeros(whole - real, self.dtype)])
        for lo in range(0, whole, step):
            hi = min(lo + step, whole)
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(ids[lo:hi]), self.sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(np.arange(lo, hi) < real), self.sequence)],
                schema=self.schema))
        self.held = [ids[whole:]] if real > whole else []
        self.n_held = max(0, real - whole)

    def close(self) -> None:
        if self.n_held:
            self._flush(-(-self.n_held // self.sequence))
        self.out.close()


class SequenceReader:
    """Random access to the tokens of one file; local files are memory-mapped, so that
    sequences and ranges within a batch are views."""

    def __init__(self, uri: str, rows: int = ROWS):
        import pyarrow as pa

        fs, path = _filesystem(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.rows, self.at = rows, -1

    def batch(self, i: int):
        if i != self.at:
            got = self.file.get_batch(i)
            self.ids = got.column(0).flatten().to_numpy(zero_copy_only=True)
            self.valid, self.at = got.column(1), i
        return self.ids

    def sequence_at(self, row: int):
        """(ids, mask) of a sequence."""
        ids, r = self.batch(row // self.rows), row % self.rows
        return (ids[r * self.sequence:(r + 1) * self.sequence],
                self.valid[r].values.to_numpy(zero_copy_only=False))

    def tokens(self, place: int, n: int) -> Iterator:
        """The ids from ``place`` on, a view for every batch touched."""
        size = self.rows * self.sequence
        while n > 0:
            lo = place % size
            part = self.batch(place // size)[lo:lo + n]
            yield part
            place, n = place + len(part), n - len(part)

    def close(self) -> None:
        self.source.close()


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, folder: str,
                    id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
                    partitions: int | None = None) -> DataFrame:
    """Encodes whole texts (null: empty) and writes their ids, each document closed by
    ``end_id``, in ascending id order (null ids first; rows of one id by a hash of the text) to ``folder``.

    Returns the stored index (doc_id, file, shard, place, n_tokens). Shards are in id
    order. An empty table writes no file. Other columns are ignored.
    """
    def write(batches):
        import os

        import numpy as np
        from pyspark import TaskContext

        encode = text_encoder(tokenizer)
        dtype = "uint16" if max(encode.vocab_size, end_id + 1) <= 1 << 16 else "uint32"
        end = np.array([end_id], dtype)
        ctx = TaskContext.get()
        shard = ctx.partitionId()
        name = f"ids-{shard:06d}-{ctx.taskAttemptId()}.arrow"
        fs, base = _filesystem(folder)
        writer = None
        for pdf in batches:
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(posixpath.join(base, "." + name))
                writer = SequenceWriter(sink, dtype, sequence, ROWS)
            places, counts = [], []
            for text in pdf["text"]:
                ids = np.frombuffer(encode(text), "<u4").astype(dtype)
                places.append(writer.add(ids))
                writer.add(end)
                counts.append(len(ids) + 1)
            yield pdf[["doc_id", "no_id"]].assign(file=os.path.join(folder, name), shard=shard,
                                                  place=places, n_tokens=counts)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(posixpath.join(base, "." + name), posixpath.join(base, name))

    # the hash in the key keeps an id that many rows share, or null, from filling one partition
    key = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = (rows.repartitionByRange(partitions, *key) if partitions
              else rows.repartitionByRange(*key))
    ordered = ranged.sortWithinPartitions(*key, "text").select(*whole_id(), "text")
    return stored(with_nulls(ordered.mapInPandas(write, INDEX)))


def read_digests(index: DataFrame) -> DataFrame:
    """Reads every document back from the files: doc_id, start, n_tokens, ids_crc32."""
    # one row per file; the places of the files in the whole are running sums over them
    sums = sorted(index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n")).collect(),
                  key=lambda r: r.shard)
    starts, total = {}, 0
    for r in sums:
        starts[r.file] = total
        total += r.n

    def read(batches):
        import numpy as np

        name, reader = None, None
        for pdf in batches:
            out_start, out_crc = [], []
            for file, place, n in zip(pdf["file"], pdf["place"], pdf["n_tokens"], strict=True):
                if file != name:
                    if reader:
                        reader.close()
                    name, reader = file, SequenceReader(file)
                crc = 0
                for part in reader.tokens(int(place), int(n)):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                out_start.append(starts[file] + place)
                out_crc.append(crc)
            yield pdf[["doc_id", "no_id", "n_tokens"]].assign(
                start=np.array(out_start, "int64"), ids_crc32=np.array(out_crc, "int64"))[
                ["doc_id", "no_id", "start", "n_tokens", "ids_crc32"]]

    return with_nulls(index.select(*whole_id(), "file", "place", "n_tokens").mapInPandas(
        read, "doc_id long, no_id boolean, start long, n_tokens long, ids_crc32 long"))


@register("op2_token_output")
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as equal-length id sequences in Arrow files, read back per document.
    SQL has no tokenizer: checked against the library on whole tables by the tests."""
    import public_tokenizers

    index = write_sequences(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("word_bpe_49k.json"), 2,
                            scratch_folder(spark))
    return read_digests(index)
