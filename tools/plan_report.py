"""Summarise the physical plan of every registered query (after execution,
so AQE decisions are final): scans, pushed filters, read schemas, shuffles
and join strategies. usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postlytics.plans.registry import load_all  # noqa: E402
from postlytics.session import local_session  # noqa: E402

SKIP = {"h4_communities", "j3_tune_best_trial", "j5_forest_predict", "g1_cluster_hashtags",
        "g3_meanshift", "g5_search_within_cluster"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    print(f"# Physical plans of the registered queries ({sf})\n")
    print("Counted on the executed AQE plans (final plans; cached sub-plans are printed inside")
    print("their scans, so the scan count is an upper bound). `python` = Arrow-batched Python nodes.\n")
    print("| query | scans | pushed filters | shuffles | broadcast joins | sort-merge joins | python |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, q in load_all().items():
        if name in SKIP:
            continue
        try:
            df = q.build(spark, sf)
            df.write.format("noop").mode("overwrite").save()
        except ValueError:
            continue
        plan = df._jdf.queryExecution().executedPlan().toString()
        # keep the final AQE plans only (the initial ones are printed too)
        plan = "\n".join(part.split("== Initial Plan ==")[0] for part in plan.split("== Final Plan =="))
        scans = len(re.findall(r"FileScan parquet", plan))
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)) - {""})
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan))
        bhj = plan.count("BroadcastHashJoin")
        smj = plan.count("SortMergeJoin")
        py = len(re.findall(r"MapInPandas|ArrowEvalPython|PythonMapInArrow", plan))
        print(f"| {name} | {scans} | {'; '.join(pushed)[:80]} | {shuffles} | {bhj} | {smj} | {py} |")
    spark.stop()


if __name__ == "__main__":
    main()
