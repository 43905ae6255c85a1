import zlib

import duckdb
import numpy as np
from helpers import EDGE, edge_docs, no_docs

from postlytics.llm import quality
from postlytics.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op5_quality_ranking(spark, sf).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == h for d, h in zip(got["doc_id"], got["held_out"]))
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    m = got[got["held_out"]].merge(labels, on="doc_id")
    assert (m["predicted"] == m["quality"]).mean() > 0.98
    # held-out labels play no part
    docs, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    a = quality.fit_ranker(docs, known)
    b = quality.fit_ranker(docs, known.withColumn(
        "quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 0).otherwise(
            quality.F.col("quality"))))
    assert np.array_equal(a.w, b.w) and a.threshold == b.threshold


def test_edges(spark):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (9, 0), (9, 1), (None, 1), (6, None), (77, 0), (8, 0), (13, 1)],
        "doc_id long, quality int")
    ranker = quality.fit_ranker(edge_docs(spark), labels)
    got = quality.score_documents(edge_docs(spark), ranker).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    same = {r.text: r.score for r in got}
    assert same[None] == same[""]
    none = quality.fit_ranker(edge_docs(spark), labels.limit(0))
    assert {r.score for r in quality.score_documents(edge_docs(spark), none).collect()} == {0.5}
    assert quality.score_documents(no_docs(spark), ranker).count() == 0
    assert quality.fit_ranker(no_docs(spark), labels).w is None


def test_a_repeated_id_counts_once(spark):
    texts = [(i, f"word{i} " * (i + 3) + ("!" * i)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    schema = "doc_id long, text string"
    once = quality.fit_ranker(spark.createDataFrame(texts, schema), labels)
    often = quality.fit_ranker(spark.createDataFrame(texts + texts[3:4] * 200, schema), labels)
    assert np.array_equal(once.w, often.w) and once.threshold == often.threshold
    mixed = texts + [(3, f"other text {i}") for i in range(50)]
    a = quality.fit_ranker(spark.createDataFrame(mixed, schema), labels)
    b = quality.fit_ranker(spark.createDataFrame(mixed[::-1], schema), labels)
    assert np.array_equal(a.w, b.w) and a.threshold == b.threshold
