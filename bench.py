"""Timed headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import derived as D  # noqa: E402
from checks.catalogue import QUERIES  # noqa: E402
from rankwell.session import build_session  # noqa: E402

# The first four make what the others share, so each cost is counted once.
STAGES = {
    "make_splits": lambda spark, folder: D.splits(spark, folder),
    "make_neighbours": lambda spark, folder: D.neighbours(spark, folder),
    "make_candidates": lambda spark, folder: [D.candidates(spark, folder, s) for s in ("val", "test")],
    "make_scores": lambda spark, folder: [D.scores(spark, folder, s) for s in ("val", "test")],
}
NAMES = [
    "flagship_popularity_ranking", "a1_read_reviews_jsonl", "b6_word_count", "c2_restrict_to_core", "c12_item_cooccurrence",
    "d2_dataset_stats", "d12_profile_report", "e1_kcore", "e4_build_id_map", "e6_random_split", "g1_bpr_triples",
    "h1_user_sequences", "h2_next_item_samples", "h4_previous_item", "i2_item_text_profile", "j7_normalise_adjacency",
    "j9_propagate", "k4_item_cosine", "k6_itemknn_score", "k8_itemknn_recommend", "k9_itemknn_rating",
    "k20_transition_ranker", "l4_evaluate_ranking", "l9_evaluate_calibrated", "m2_minmax_by_user", "m6_grid_search",
    "m11_two_stage_metrics", "m14_component_metrics", "n6_split_quality_report", "k10_latent_factor_ranker",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__driver__host="127.0.0.1")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d1_frequency_counts"](spark, "/root/testdata/sf0.001").count()  # start the engine
    wanted = sys.argv[1:]
    times: dict[str, float] = {}
    for name, make in STAGES.items():
        start = time.time()
        make(spark, folder)
        times[name] = round(time.time() - start, 3)
    for name in wanted or NAMES:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
