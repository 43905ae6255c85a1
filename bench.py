"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Every query is computed in full through the ``noop`` sink (no collect), and
timed; one JSON line is printed:
{"metric": "total_query_time", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlytics.plans.registry import load_all  # noqa: E402
from postlytics.session import local_session  # noqa: E402

HEADLINE = [
    "c8_remove_stopwords",
    "c10_preprocess",
    "d3_tfidf",
    "d3_top_terms_per_label",
    "d4_transform_unseen",
    "d10_encode",
    "d12_pack",
    "c14_lexicon_score",
    "e1_stratified_sample",
    "i1_metrics_per_split",
    "a8_dedupe_metrics",
    "a9_best_checkpoint",
    "p8_few_shot_sweep",
    "d5_embed_posts",
    "d7_mean_tag_embedding",
    "f3_compute_similarity",
    "h0_cooccurrence_graph",
    "h3_top_similar",
    "h5_recommend",
    "d9_segment_tags",
    "g2_kmeans",
    "j6_fit_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")))
    qs = load_all()
    # untimed warm-up: JVM, Python workers, file listing
    spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).select("doc_id").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        df = qs[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
