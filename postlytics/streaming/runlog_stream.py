"""Run-log analytics as Structured Streaming queries.

New metric files (``<root>/<experiment>/<run>/metrics/<name>``, one
``<epoch ms> <value> <step>`` line per observation) are picked up as they
land; observations are parsed as in the batch reader, de-duplicated per
(run, metric, step) within a watermark (the same value is logged twice by
two loggers), and the best step per run and eval metric is kept as
streaming aggregation state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.sources.runlog import EVAL_PREFIX, parse_metrics


def metric_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``run_metrics`` rows from a run-log folder tree."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_metrics(reader.load(root), root)


def dedupe_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A8 (streaming): drop repeated (run, metric, step) observations that
    arrive within ``delay`` of each other (state is bounded by the watermark)."""
    return (stream.withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["experiment", "run_id", "metric", "step"]))


def best_step_stream(stream: DataFrame, maximize: bool = True) -> DataFrame:
    """A5 + A9 (streaming): per (run, eval metric) the best value and its
    step (ties: lowest step), updated as observations arrive."""
    ev = stream.where(F.startswith(F.col("metric"), F.lit(EVAL_PREFIX)))
    v = F.col("value") if maximize else -F.col("value")
    best = F.max(F.struct(v.alias("k"), (-F.col("step")).alias("s"), F.col("value").alias("v")))
    return (ev.groupBy("experiment", "run_id", "metric").agg(best.alias("_b"))
            .select("experiment", "run_id", "metric", (-F.col("_b.s")).alias("best_step"),
                    F.col("_b.v").alias("best_value")))


def start_best_step(spark: SparkSession, root: str, checkpoint: str, out: str,
                    available_now: bool = False):
    """Run :func:`best_step_stream` into the Parquet folder ``out``, written anew by every
    trigger (one row per run and metric); ``checkpoint`` must be a reliable (shared) folder."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (best_step_stream(dedupe_stream(metric_stream(spark, root)))
         .writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q
    return q.start()
