"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Inputs that several queries share (splits, vocabulary, models, scored tables) are
timed as entries of their own, named make_*; a query's time is what it adds. Every
query runs whole, into a sink that reads all its rows.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from classgauge.plans import queries as q
from classgauge.session import local_session

SHARED = (
    q.split_texts,
    q.train_vocabulary,
    q.centroid_model,
    q.bayes_model,
    q.centroid_scored,
    q.bayes_scored,
    q.split_embeddings,
    q.dense_head,
    q.dense_scored,
    q.dense_cells,
    q.dense_runs,
    q.text_runs,
)
QUERIES = (
    "labelled_scan",
    "new_texts_from_csv",
    "typed_lines",
    "prepared_rows",
    "arabic_normalized",
    "arabic_terms",
    "generic_terms",
    "term_counts",
    "document_frequency",
    "tfidf_fit_weights",
    "tfidf_vectors",
    "split_quotas",
    "dense_logits",
    "scored_new_texts",
    "scored_new_texts_by_join",
    "per_class_metrics",
    "overall_text_metrics",
    "reliability_table",
    "roc_points",
    "auc_per_class",
    "macro_auc_interpolated_text",
    "bootstrap_interval",
    "baseline_report",
    "model_pair_report",
    "text_introspection",
    "top_terms",
    "logreg_grid",
    "logreg_test_predictions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    timed("warm_up", lambda: q.table(spark, folder, "documents").write.format("noop").mode("overwrite").save())
    for make in SHARED:
        timed(f"make_{make.__name__}", lambda: make(spark, folder))
    for name in QUERIES:
        timed(name, lambda: q.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
