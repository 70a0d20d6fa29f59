"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from breaklens.plans import catalogue
from breaklens.session import local_session

HEADLINE = [
    "signature_counts",
    "chi2_individual",
    "chi2_pairwise",
    "chi2_triplet",
    "lift_report",
    "jaccard_matrix",
    "cooccurrence_networks",
    "network_insights",
    "transactions",
    "frequent_itemsets",
    "association_rules",
    "rule_stability",
    "multi_hot",
    "row_stats",
    "impute_median",
    "label_encode",
    "standard_scale",
    "qcut_items",
    "split_stratified",
    "split_kfold",
    "sample_balanced",
    "m_auc",
    "m_report",
    "m_field",
    "precision_at_recall",
    "sequence_windows",
    "rolling_stats",
    "hist_change_freq",
    "txn_graph_edges",
    "txn_similarity_edges",
    "neighbour_aggregate",
    "greedy_rule_list",
    "shared_rules",
    "explain_text",
    "drift_metrics",
    "clf_naive_bayes",
    "clf_tree",
    "clf_knn",
    "stack_oof",
    "tree_rules",
    "unified_explain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up (JVM, code generation, Python workers) is not part of any query
    catalogue.QUERIES["signature_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
