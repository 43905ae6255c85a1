"""Run-log reading (A7), dedupe (A8), best step (A9), sinks (A4, A10) and
the streaming form."""
import os
import tempfile

from pyspark.sql import functions as F

from postlytics.sources import io
from postlytics.sources import runlog as rl
from postlytics.streaming import runlog_stream as rs


def write_tree(root):
    hist = {("1", "r1", "eval_f1"): [(1000, 0.5, 10), (1001, 0.5, 10), (2000, 0.7, 20), (2001, 0.7, 20),
                                      (3000, 0.7, 30)],
            ("1", "r1", "system/gpu_0_memory"): [(1000, 12.5, 0)],
            ("1", "r2", "eval_loss"): [(1000, 0.9, 5), (2000, 0.4, 15)]}
    for (exp, run, metric), obs in hist.items():
        path = os.path.join(root, exp, run, "metrics", metric)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("".join(f"{a} {b} {c}\n" for a, b, c in obs))
    # files that are no metrics, as a real tree has them
    for rel in ("1/meta.yaml", "1/r1/meta.yaml", "1/r1/tags/mlflow.user", "1/r1/artifacts/model/metrics/x"):
        path = os.path.join(root, *rel.split("/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("name: 1 2 3\n")
    p = os.path.join(root, "1", "r1", "params", "num_train_epochs")
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write("5")


def test_read_dedupe_best(spark):
    root = tempfile.mkdtemp(prefix="run log+%20-")   # a blank and signs that URIs encode
    write_tree(root)
    with open(os.path.join(root, "1", "r1", "metrics", "odd"), "w") as f:
        f.write("\nno number\n")
    odd = rl.read_metrics(spark, root).where("metric = 'odd'").collect()
    assert [(r.ts, r.value, r.step) for r in odd] == [(None, None, None)]
    os.remove(os.path.join(root, "1", "r1", "metrics", "odd"))
    m = rl.read_metrics(spark, root)
    assert m.count() == 8
    assert {r.metric for r in m.collect()} == {"eval_f1", "system/gpu_0_memory", "eval_loss"}
    d = rl.dedupe_history(m)
    assert d.count() == 6
    best = {(r.run_id, r.metric): (r.best_step, r.best_value)
            for r in rl.best_step(rl.eval_only(d)).collect()}
    assert best[("r1", "eval_f1")] == (20, 0.7)  # tie at 0.7 -> lowest step
    low = {r.metric: r.best_step for r in rl.best_step(rl.eval_only(d), maximize=False).collect()}
    assert low["eval_loss"] == 15
    params = rl.read_params(spark, root).collect()
    assert [(p.param, p.value) for p in params] == [("num_train_epochs", "5")]


def test_streaming_best_step(spark):
    root = tempfile.mkdtemp(prefix="runlog-")
    write_tree(root)
    ck = tempfile.mkdtemp(prefix="ck-")
    out = os.path.join(tempfile.mkdtemp(prefix="best-"), "t")
    q = rs.start_best_step(spark, root, ck, out, available_now=True)
    q.awaitTermination(120)
    got = {(r.run_id, r.metric): r.best_step for r in spark.read.parquet(out).collect()}
    assert got[("r1", "eval_f1")] == 20 and got[("r2", "eval_loss")] == 5


def test_predictions_sink_dynamic_overwrite(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="preds-"), "p")
    a = spark.createDataFrame([(1, 0, "m1", "k0"), (2, 1, "m2", "k0")], "post_id long, y int, model string, variant string")
    io.write_predictions(a, out)
    b = spark.createDataFrame([(3, 2, "m1", "k0")], "post_id long, y int, model string, variant string")
    io.write_predictions(b, out)
    got = sorted((r.post_id, r.model) for r in spark.read.parquet(out).collect())
    assert got == [(2, "m2"), (3, "m1")]
    assert rl.timed(spark.range(1000)) >= 0


def test_observations_keep_eval_only(spark):
    df = rl.observations(spark, "e", "r", {"eval_f1": 0.5, "loss": 1.0}, step=3, ts_ms=0)
    assert [(r.metric, r.step) for r in df.collect()] == [("eval_f1", 3)]


def test_load_posts_partitioned_formats(spark):
    rows = [(1, "a", 0, "train"), (2, "b", 1, "test"), (3, "c", 2, "train")]
    df = spark.createDataFrame(rows, "post_id long, text string, label int, split string")
    for fmt in ("parquet", "json"):
        path = os.path.join(tempfile.mkdtemp(prefix="posts-"), "p")
        df.write.partitionBy("split").format(fmt).save(path)
        posts = io.load_posts(spark, path, fmt=fmt)
        got = sorted(r.post_id for r in io.pick_split(posts, "train").collect())
        assert got == [1, 3], fmt
    parts = io.assemble_splits({"train": df.where("split = 'train'").drop("split"),
                                "test": df.where("split = 'test'").drop("split")})
    assert sorted((r.post_id, r.split) for r in parts.collect()) == [(1, "train"), (2, "test"), (3, "train")]


def test_write_and_read_a_tree(spark):
    root = tempfile.mkdtemp(prefix="tree-")
    rows = [("e", f"r{i % 3}", m, f"2024-01-01 00:00:{i:02d}", i / 7, i) for i in range(30)
            for m in ("eval_f1", "system/gpu_0", "with blank")]
    rows.append(("e", "r0", "eval_f1", "2024-01-01 00:00:00", 0.1, 2 ** 60 + 1))
    history = (spark.createDataFrame(rows, "experiment string, run_id string, metric string, ts string, "
                                           "value double, step long")
               .withColumn("ts", F.col("ts").cast("timestamp")))
    files = {r.file: r.n for r in rl.write_metrics(history, root).collect()}
    assert len(files) == 9 and sum(files.values()) == 91 and files["e/r0/metrics/eval_f1"] == 11
    cols = ["experiment", "run_id", "metric", "ts", "value", "step"]
    back = rl.read_metrics(spark, root).select(cols)
    assert sorted(back.collect()) == sorted(history.select(cols).collect())
    with open(os.path.join(root, "e/r1/metrics/eval_f1")) as f:
        steps = [int(x.split()[2]) for x in f]
    assert steps == sorted(steps)
    assert rl.write_metrics(history.limit(0), root + "/none").count() == 0


def test_scan_lists_and_reads_in_tasks(spark, monkeypatch):
    """No list of files on the driver (a scan by Spark's text source keeps one), pieces of large files
    read by tasks of their own, names that Spark's scan passes over passed over."""
    root = tempfile.mkdtemp(prefix="runlog-")
    write_tree(root)
    for rel in ("1/r1/metrics/.eval_f1.crc", "1/r1/metrics/_half", "1/.trash/metrics/x", "1/r3/metrics", "_tmp/r/metrics/x"):
        path = os.path.join(root, *rel.split("/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("1 2 3\n")
    os.makedirs(os.path.join(root, "1", "r4", "metrics"))
    open(os.path.join(root, "1", "r4", "metrics", "empty"), "w").close()
    ends = ["\n", "\r\n", "\r", "\n\n"]
    with open(os.path.join(root, "1", "r4", "metrics", "long=1"), "w", newline="") as f:
        f.write("﻿" + "".join(f"{1000 + i} {i / 2} {i}{ends[i % 4]}" for i in range(500)) + "9999 1.5 500")
    old = rl.parse_metrics(spark.read.option("recursiveFileLookup", "true").text(root), root)
    want = sorted(map(tuple, old.collect()))
    assert len(want) == 8 + 501
    for piece, text in ((1 << 26, 1 << 20), (64, 16), (7, 3), (1, 4)):
        monkeypatch.setattr(rl, "PIECE_BYTES", piece)
        monkeypatch.setattr(rl, "TEXT_BYTES", text)
        with open(os.path.join(root, "1", "r4", "metrics", "long=1"), "rb") as f:
            size = len(f.read())
            lines = []
            for start in range(0, size, piece):
                f.seek(0)
                lines += [x for t in rl._lines(f, start, min(start + piece, size))
                          for x in t.replace(b"\r", b"\n").split(b"\n") if x]
        assert lines == [b"%d %s %d" % (1000 + i, str(i / 2).encode(), i) for i in range(500)] + [b"9999 1.5 500"], piece
    monkeypatch.setattr(rl, "PIECE_BYTES", 64)
    new = rl.read_metrics(spark, root)
    assert sorted(map(tuple, new.collect())) == want
    assert "FileScan text" not in new._jdf.queryExecution().toString()
