"""Sources and sinks (A1-A4): the labelled post corpus and prediction files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.session import ensure_checkpoint_dir

POSTS_SCHEMA = T.StructType([
    T.StructField("post_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("split", T.StringType(), True),
])

SPLITS = ("train", "validation", "test")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: smaller than a checkpoint,
    for large frames that are read more than once."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_posts(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType = POSTS_SCHEMA, **options) -> DataFrame:
    """A1: load the labelled corpus, all splits.

    ``path`` is a folder laid out as ``split=<name>/...`` (Hive style) or
    files that carry a ``split`` column. The schema is given, never
    inferred, so all formats read the same columns (those that a file lacks are null).
    """
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def pick_split(posts: DataFrame, split: str) -> DataFrame:
    """A2: one split. On a ``split``-partitioned folder this prunes files."""
    return posts.where(F.col("split") == F.lit(split))


def assemble_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    """A3: re-assemble per-split frames into one frame with a ``split`` column."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_predictions(df: DataFrame, path: str, partition_cols=("model", "variant"),
                      fmt: str = "parquet") -> None:
    """A4: prediction sink; overwrites only the partitions present in ``df``.

    Dynamic partition overwrite keeps other models' results in place (the
    reference overwrites one JSON file per model/variant).
    """
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols)
       .format(fmt)
       .save(path))
