"""Small helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class LlmQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


QUERIES: dict[str, LlmQuery] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        QUERIES[name] = LlmQuery(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, deleted when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: work done
    once, and kept when executors are lost."""
    path = os.path.join(scratch_folder(df.sparkSession), "t")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_id(id_col: str = "doc_id") -> list[Column]:
    """The id as two columns without nulls: pandas turns a long column that holds a null
    into floats, which have no room for ids above 2^53."""
    doc = F.col(id_col).cast("long")
    return [F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("no_id")]


def with_nulls(df: DataFrame) -> DataFrame:
    """The inverse of ``whole_id``."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def fold_az(text: Column) -> Column:
    """``text`` with A-Z (and nothing else) in lower case; null counts as empty.

    ``lower`` does just that to pure ASCII; other texts get one ``replace`` per letter,
    which is several times faster than ``translate``."""
    text = F.coalesce(text, F.lit(""))
    out = text
    for ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out = F.replace(out, F.lit(ch), F.lit(ch.lower()))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(out)
